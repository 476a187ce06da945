"""WARC archives: a writer with revisit records, and a salvage reader for damaged files.

Each record is written as a gzip member of its own. A payload of at least `least` bytes that several records
share is stored once, in the record of the largest page_id; the others are revisit records that
refer to it, and their block holds the HTTP header alone, with the full payload's length.

The reader takes a file as a stream. Where a member fails its checks (its deflate data, its CRC, the
record's version line, its Content-Length, its block digest) or where plain records do, it searches
on from the next byte for a member that can be valid or a version line, goes on there, and logs
the bytes between as a quarantined gap. What it holds is one record and a chunk. A member may hold
several records: all have its offset, and where it is damaged those that end before the damage stay.

Defined results
  null html      an empty payload
  null url       the URI urn:none
  null page_id   written as a response of its own that nobody refers to
  repeated page_id and payload  every row with the group's largest page_id is a response
  ties           none: the largest page_id is unique within a group but for repeated rows
  empty table    no files, no rows
  foreign files  folded header lines are joined, headers that aren't UTF-8 are Latin-1; a revisit
                 whose payload digest is no SHA-1 in base 32 or hex, or whose length is no number, has
                 null there
  very long html written as it is: a record may be longer than any text that Spark holds
  extra columns  ignored
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bytewords
from tallyloom.llm.common import materialize, partitions_for, read_table, shared_path, ship
from tallyloom.llm.store import open_file, write_file

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
#: Bytes after which a writer starts another file.
FILE_BYTES = 32 << 20
CHUNK = 1 << 20
LEVEL = 3
#: A member or plain record larger than this is taken as damaged: more than the longest text that Spark holds, with its headers.
MOST = (1 << 31) + (1 << 20)
#: Payloads that several pages have, at most (about 80 bytes each), that are broadcast to the scan of the pages.
BROADCAST_LEADERS = 100_000
_END = b"\r\n\r\n"
_VERSION = b"WARC/1."
_MEMBER = b"\x1f\x8b\x08"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def payload(self) -> bytes:
        """Of an HTTP response: what follows its header; else the block."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(_END)[2]
        return self.block

    def http(self) -> dict[str, str]:
        lines = self.block.partition(_END)[0].decode("latin-1").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def sha1_hex(said: str) -> str | None:
    """The lower-case hex form of a SHA-1 digest in base 32 or hex; None if it is of another kind, or can't be read."""
    kind, _, value = said.partition(":")
    if kind.strip().lower() not in ("sha1", "sha-1"):
        return None
    value = value.strip()
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + _END


def member(data: bytes, level: int = LEVEL) -> bytes:
    return gzip.compress(data, level, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit where refers_to is given. digest: lower-case hex SHA-1 of the payload."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        headers += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record_bytes(headers, http if refers_to is not None else http + payload)


@dataclass
class _Window:
    """A stream with a buffer that starts at `base`."""

    stream: BinaryIO
    base: int = 0
    data: bytearray = field(default_factory=bytearray)
    over: bool = False

    def need(self, n: int) -> bool:
        while len(self.data) < n and not self.over:
            chunk = self.stream.read(CHUNK)
            self.over = not chunk
            self.data += chunk
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.base += n


class Damage(Exception):
    pass


def _parse(data: bytes | bytearray, at_end: bool) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, length) of the plain record at the start of data; None if more bytes are needed."""
    if not data.startswith(_VERSION):
        if len(data) < len(_VERSION) and _VERSION.startswith(bytes(data)) and not at_end:
            return None
        raise Damage("no version line")
    head = data.find(_END)
    if head < 0:
        if at_end or len(data) > 1 << 16:
            raise Damage("no end of headers")
        return None
    try:
        text = bytes(data[:head]).decode("utf-8")
    except UnicodeDecodeError:
        text = bytes(data[:head]).decode("latin-1")  # older crawlers write URIs so
    headers, k = {}, ""
    for line in text.split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and k:  # a folded line goes on with the header before it
            headers[k] = f"{headers[k]} {line.strip()}".strip()
            continue
        k, colon, v = line.partition(":")
        if not colon:
            raise Damage("malformed header")
        k = k.strip().lower()
        headers[k] = v.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or int(length) > MOST:
        raise Damage("no valid Content-Length")
    stop = head + 4 + int(length)
    if len(data) < stop + 4:
        if at_end:
            raise Damage("record is cut short")
        return None
    if data[stop : stop + 4] != _END:
        raise Damage("no end of record where Content-Length says")
    block = bytes(data[head + 4 : stop])
    said = headers.get("warc-block-digest")
    if said and said.startswith("sha1:") and said != _sha1(block):
        raise Damage("block digest differs")
    return headers, block, stop + 4


def _sound(tool, data: bytes) -> bytes:
    """What deflate data gives before it goes wrong."""
    out = bytearray()
    for step in (4096, 1):
        while data:
            before = tool.copy()
            try:
                out += tool.decompress(data[:step])
            except zlib.error:
                tool = before
                break
            data = data[step:]
    return bytes(out)


def _member_at(w: _Window) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of the gzip member at the start of the window, which moves on behind them.

    A record is given once another begins after it; the last, once the member's CRC is found right.
    """
    tool, out, at, done, rest, full, held = zlib.decompressobj(31), bytearray(), 0, 0, b"", False, None
    while not tool.eof:
        if not rest and not full:
            if at >= len(w.data) and not w.need(at + 1):
                raise Damage("member is cut short")
            rest = bytes(w.data[at : at + CHUNK])
            done, at = at, at + len(rest)
        before, wrong = tool.copy(), None
        try:
            piece = tool.decompress(rest, CHUNK)
            rest, full = tool.unconsumed_tail, len(piece) == CHUNK
        except zlib.error as e:
            piece, wrong = _sound(before, rest), Damage(f"member is damaged: {e}")
        out += piece
        while out:
            if len(out) >= len(_VERSION) and not out.startswith(_VERSION):
                raise Damage("member holds no record" if held is None else "member holds more than records")
            found = _parse(out, tool.eof and not wrong)
            if found is None:
                break
            if held is not None:
                yield held
                # What lies before the piece at hand isn't needed again; damage found later starts a gap here.
                w.drop(done)
                at, done = at - done, 0
            held = found[:2]
            del out[: found[2]]
        if wrong:
            raise wrong
        if len(out) > MOST:
            raise Damage("member is too large")
    if held is None:
        raise Damage("member holds no record")
    w.drop(at - len(tool.unused_data))
    yield held


def _plain_at(w: _Window) -> tuple[dict[str, str], bytes, int]:
    size = 1 << 16
    while True:
        full = w.need(size)
        found = _parse(w.data, not full)
        if found is not None:
            return found
        size = len(w.data) + CHUNK


def _next_start(w: _Window) -> int | None:
    """Where from byte 1 on the next member or version line can begin; None at the end."""
    at = 1
    while True:
        found = [p for p in (w.data.find(_MEMBER, at), w.data.find(_VERSION, at)) if p >= 0]
        if found:
            return min(found)
        at = max(1, len(w.data) - len(_VERSION) + 1)
        if len(w.data) > 4 * CHUNK:
            return -at  # so far searched: drop it, stay in the gap
        if not w.need(len(w.data) + 1):
            return None


def salvage(stream: BinaryIO) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of an archive, in order."""
    w = _Window(stream)
    gap, reason = -1, ""
    while w.need(1):
        try:
            if w.need(3) and w.data[:3] == _MEMBER:
                start = w.base
                for headers, block in _member_at(w):
                    if gap >= 0:
                        yield Gap(gap, start - gap, reason)
                        gap = -1
                    yield Record(headers, block, start)
                continue
            w.need(len(_VERSION))
            headers, block, length = _plain_at(w)
        except Damage as e:
            if gap < 0:
                gap, reason = w.base, str(e)
            step = _next_start(w)
            if step is None:
                w.drop(len(w.data))
                break
            while step is not None and step < 0:
                w.drop(-step)
                w.need(len(_VERSION))
                step = 0 if w.data.startswith((_MEMBER, _VERSION)) else _next_start(w)
            if step is None:
                w.drop(len(w.data))
                break
            w.drop(step)
            continue
        if gap >= 0:
            yield Gap(gap, w.base - gap, reason)
            gap = -1
        yield Record(headers, block, w.base)
        w.drop(length)
    if gap >= 0:
        yield Gap(gap, w.base - gap, reason)


def _write(root: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, parts, size, files, records = TaskContext.get().partitionId(), [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, size, files, records
            path = f"{root}/part-{partition:06d}-{files:05d}.warc.gz"
            written = write_file(path, parts)
            out = pa.record_batch([pa.array([path]), pa.array([records], pa.int64()), pa.array([written], pa.int64())], names=["path", "n_records", "n_bytes"])
            parts, size, files, records = [], 0, files + 1, 0
            return out

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True)
            for page_id, url, html, digest, refers_to in rows:
                if len(html or "") > MOST // 4 and len(html.encode()) > MOST - (1 << 20):
                    raise ValueError(f"page {page_id} is larger than a record may be ({MOST} bytes)")
                parts.append(member(page_record(page_id, url, (html or "").encode(), digest, refers_to)))
                size, records = size + len(parts[-1]), records + 1
                if size >= file_bytes:
                    yield flush()
        if parts:
            yield flush()

    return run


def write(pages: DataFrame, root: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes page_id, url, html as archives under root; returns the manifest (path, n_records, n_bytes), a written table."""
    ship(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    large = rows.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    leaders = large.groupBy("digest", "size").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    leaders = materialize(leaders, "leaders")
    if leaders.count() <= BROADCAST_LEADERS:
        joined = rows.join(F.broadcast(leaders), ["digest", "size"], "left")
        leader = F.when(F.col("page_id").isNotNull(), F.col("leader"))
    else:  # whole pages are shuffled by their own ids then, never by a payload that many have
        revisits = large.select("page_id", "digest", "size").join(leaders, ["digest", "size"]).select("page_id", "digest", "leader").distinct()
        joined, leader = rows.join(revisits, ["page_id", "digest"], "left"), F.col("leader")
    out = joined.select("page_id", "url", "html", "digest", F.when(leader != F.col("page_id"), leader).alias("refers_to"))
    return materialize(out.mapInArrow(bytewords.tidy(_write(root, file_bytes)), "path string, n_records long, n_bytes long"), "manifest")


_SCHEMA = "path string, offset long, gap_length long, gap_reason string, record_id string, record_type string, uri string, payload_bytes long, payload_digest string, refers_to string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    types = [kinds[x.split()[1]] for x in _SCHEMA.split(", ")]
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        nonlocal rows
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        rows = []
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open_file(path) as stream:
                for x in salvage(stream):
                    if isinstance(x, Gap):
                        rows.append((path, x.offset, x.length, x.reason, *(None,) * 6))
                        continue
                    h = x.headers
                    if x.kind == "revisit":
                        said = x.http().get("content-length", "0")
                        digest, size = sha1_hex(h.get("warc-payload-digest", "")), int(said) if said.isascii() and said.isdigit() and len(said) < 19 else None
                    else:
                        payload = x.payload()
                        digest, size = hashlib.sha1(payload, usedforsecurity=False).hexdigest(), len(payload)
                    rows.append((path, x.offset, None, None, h.get("warc-record-id"), x.kind, h.get("warc-target-uri"), size, digest, h.get("warc-refers-to")))
                    if len(rows) >= 5000:
                        yield out()
    yield out()


def read(paths: DataFrame) -> DataFrame:
    """Records and gaps of the archives in column `path`: of a record gap_length is null, of a gap record_id."""
    ship(paths.sparkSession)
    files = paths.select("path").repartition(partitions_for(paths.count(), 2, 1), "path")
    return files.mapInArrow(bytewords.tidy(_read), _SCHEMA)


def audit(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, n_records, n_read, n_gaps, gap_bytes of every file of a manifest: what was written, and what read() found of it."""
    gap = F.col("gap_length").isNotNull()
    read_ = found.groupBy("path").agg(F.count_if(~gap).alias("n_read"), F.count_if(gap).alias("n_gaps"), F.coalesce(F.sum("gap_length"), F.lit(0)).alias("gap_bytes"))
    counts = ("n_read", "n_gaps", "gap_bytes")
    return manifest.select("path", "n_records").join(read_, "path", "left").select("path", "n_records", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that was written, read back; a file that lost one, or has a gap, is an error here and not a missing row."""
    manifest = write(read_table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    found = materialize(read(manifest), "records")
    lost = audit(manifest, found).where("n_read <> n_records OR n_gaps > 0").limit(5).collect()
    if lost:
        raise RuntimeError(f"records were lost between writing and reading: {lost}")
    return found.where(F.col("gap_length").isNull()).select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)").alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(regexp_extract(refers_to, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)").alias("refers_to"),
    )


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), g AS (
  SELECT html, max(page_id) AS leader FROM p WHERE payload_bytes >= 1000 GROUP BY html
)
SELECT p.page_id, p.payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.leader IS NOT NULL AND g.leader <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.leader <> p.page_id THEN g.leader END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html AND p.payload_bytes >= 1000
"""
