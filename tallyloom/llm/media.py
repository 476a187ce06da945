"""Media columns: any bytes as progressive JPEG files, and files as full-resolution RGB tensors.

A file's unit is the quantized coefficient: one byte of the payload is one coefficient, so nothing is
lost, whatever the inverse transform makes of it. FREQUENT bytes get small coefficients, which the
format writes in few bits; the others follow in ascending order. All quantities are 1. The payload's
length stands in the file's comment, and coefficients beyond it are zero. How scans are written and
accumulated is told in jpeg.py.

Files are written to a table in the shared folder and read back from there: a task that is lost reads
or writes its part again. Each task codes about STEP bytes of texts at once; a longer text stands
alone, and its blocks are coded in parts.

Defined results: a null text is empty; a payload is never empty (at least UNIT bytes of 255). Repeated
rows and null ids stay, each with its own file. An empty table gives an empty result. Ids may be of any
type; other columns are ignored. Equal texts give equal files, tensors and features. Bytes that are no
progressive JPEG of the kind read here raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bytewords, jpeg
from tallyloom.llm.common import materialize, read_table, ship

#: A payload's length is a multiple of this; its end is filled with FILL.
UNIT, FILL = 576, 255
#: Bytes that texts hold most, most frequent first.
FREQUENT = b" en\xfftaiorshdlucmgpbfvwyzkjqx.,\n"
#: Bytes of texts that are coded together.
STEP = 1 << 20


def _byte_values() -> np.ndarray:
    """The coefficient of each byte: 2, -2, 3, -3, ... by rank, and at last -128, 0, 1 and -1, whose bits cost most."""
    values = [s * v for v in range(2, 128) for s in (1, -1)] + [-128, 0, 1, -1]
    ranked = [*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]
    out = np.zeros(256, np.int16)
    out[ranked] = values
    return out


VALUE = _byte_values()
BYTE = np.zeros(256, np.uint8)
BYTE[VALUE + 128] = np.arange(256)


def payloads(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts filled up to a positive multiple of UNIT bytes each, their lengths)."""
    size = np.diff(offsets)
    full = np.maximum(-(-size // UNIT), 1) * UNIT
    out = np.full(int(full.sum()), FILL, np.uint8)
    out[jpeg.ranges(np.cumsum(full) - full, size)] = raw[offsets[0] : offsets[-1]]
    return out, full


def to_files(data: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A file for each payload."""
    mcus = -(-size // 384)
    wide = np.minimum(mcus, jpeg.ROW)
    places = jpeg.Places(wide, -(-mcus // wide))
    coefs = np.zeros(64 * int(places.base[-1]), np.int16)
    coefs[jpeg.ranges(64 * places.base[:-1], size)] = VALUE[data]
    return jpeg.encode(coefs.reshape(-1, 64), places, [b"%d" % n for n in size.tolist()])


def from_files(files: list[bytes]) -> tuple[list[bytes], np.ndarray, jpeg.Places]:
    """(payload of each file, samples by MCU of all of them, where they stand)."""
    coefs, places, heads = jpeg.decode(files)
    flat, base = coefs.ravel(), 64 * places.base
    parts = [BYTE[flat[base[d] : base[d] + int(h.comment)] + 128].tobytes() for d, h in enumerate(heads)]
    return parts, jpeg.tensors(coefs, places, heads), places


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = bytewords.texts_of(batch.column("text"))
        for a, b in bytewords.steps(raw, offsets, STEP):
            data, size = payloads(raw, offsets[a : b + 1])
            n = pa.array(np.diff(offsets[a : b + 1]).astype(np.int64))
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), n, pa.array(size), pa.array(to_files(data, size), pa.binary())], names=["doc_id", "n_bytes", "payload_bytes", "media"])


def _groups(files: list[bytes]) -> Iterator[tuple[int, int]]:
    yield from bytewords.steps(np.zeros(0, np.uint8), np.concatenate(([0], np.cumsum([len(f) for f in files]))), STEP // 2)


def _decode(keep: list[str], made: Callable[[bytes, bytes, np.ndarray], tuple], names: list[str], types: list[pa.DataType]):
    """keep: columns that stay; made: what a file, its payload and its tensor give for the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("media").to_pylist()
            for a, b in _groups(files):
                found, samples, places = from_files(files[a:b])
                at = np.concatenate(([0], np.cumsum(places.mcus)))
                rows = [made(f, p, jpeg.tensor(samples[at[d] : at[d + 1]], int(places.wide[d]), int(places.high[d]))) for d, (f, p) in enumerate(zip(files[a:b], found, strict=True))]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.record_batch([*(batch.column(k).slice(a, b - a) for k in keep), *columns], names=[*keep, *names])

    return run


def media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and media, a file for each text, in a written table."""
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text").mapInArrow(bytewords.tidy(_encode), f"doc_id {kind}, n_bytes long, payload_bytes long, media binary")
    return materialize(rows, "media")


def rgb(files: DataFrame) -> DataFrame:
    """files' doc_id with height, width and rgb, the samples row by row, three bytes each; and payload, the bytes that the coefficients hold."""
    ship(files.sparkSession)
    kind = files.schema["doc_id"].dataType.simpleString()
    made = lambda _, payload, t: (t.shape[0], t.shape[1], t.tobytes(), payload)
    run = _decode(["doc_id"], made, ["height", "width", "rgb", "payload"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])
    return files.select("doc_id", "media").mapInArrow(bytewords.tidy(run), f"doc_id {kind}, height int, width int, rgb binary, payload binary")


def _digest(file: bytes, payload: bytes, samples: np.ndarray) -> tuple:
    means = samples.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 100 // (samples.size // 3)
    shown = "x".join(map(str, samples.shape)) + " " + " ".join(f"{m // 100}.{m % 100:02d}" for m in means.tolist()) + f" {zlib.crc32(samples.tobytes()):08x}"
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), shown


def features(files: DataFrame) -> DataFrame:
    """Digests of each file and of the payload read from it, and its tensor's shape, mean colour and checksum; tensors stay in the task."""
    ship(files.sparkSession)
    kind = files.schema["doc_id"].dataType.simpleString()
    run = _decode(["doc_id", "n_bytes", "payload_bytes"], _digest, ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])
    return files.mapInArrow(bytewords.tidy(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(media(read_table(spark, sf_dir, "documents")))
