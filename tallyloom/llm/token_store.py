"""Token ids on disk, Re-Pair compressed by shard, with random access to each document.

Re-Pair replaces frequent pairs of neighbouring symbols by new symbols (nonterminals), again and
again, until no pair occurs LEAST times without overlap. Here a round counts all pairs of a shard and
replaces them together, the more frequent pair first where two overlap, a run of one pair from left
to right. The next round counts pairs of what is left, new symbols included.

File (little-endian): magic, counts, then arrays
  documents: key, doc_id, whether it is null, and number of ids of each, in ascending order of keys
  alphabet:  the ids that occur; symbol i is the i-th of them
  rules:     left and right symbol of each nonterminal; nonterminal i is symbol len(alphabet) + i
  lengths:   how many ids each nonterminal expands to
  index:     ids before each block of BLOCK symbols, so that any id is found by one bisection
  symbols:   what is left of the shard
Rules, lengths and symbols are packed to as many bits each as the largest of them needs.

Defined results
  null or empty text  the end id alone
  null or repeated doc_id, repeated rows  each row is a document of its own, in (doc_id nulls first, text) order
  empty table         no files, no rows
  very long text      a shard of its own
  extra columns       ignored
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import bytewords
from tallyloom.llm.common import keyed, materialize, partitions_for, read_table, shared_path
from tallyloom.llm.store import read_file, write_file
from tallyloom.llm.tokens import default_vocabulary, encoder, grouped

END = 0
MAGIC = b"TLRP0003"
BLOCK = 1024
#: Ids after which a shard ends.
SHARD_IDS = 2_000_000
#: The least count of a pair that is replaced.
LEAST = 2
TEXTS = 2048
BYTES_PER_TASK = 24 << 20
_BINS = 22
_HEAD = struct.Struct("<8sIIQQQBBB")
#: Numbers packed at once; a multiple of 8, so that each lot ends with a whole byte.
_CHUNK = 1 << 18


@dataclass
class Shard:
    keys: np.ndarray
    doc_ids: np.ndarray
    nulls: np.ndarray
    counts: np.ndarray
    alphabet: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    index: np.ndarray


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs at positions `at` (ascending) stay: taken by rank, each unless a neighbour that overlaps it was taken before."""
    here = np.arange(len(at), dtype=np.int32)
    near = at[1:] == at[:-1] + 1
    # From the best of its neighbourhood outward, every second one is taken; where two slopes meet, the last needs both sides free.
    left = here - np.maximum.accumulate(np.where(np.concatenate(([False], near & (rank[1:] > rank[:-1]))), 0, here))
    right = np.minimum.accumulate(np.where(np.concatenate((near & (rank[:-1] > rank[1:]), [False])), len(at), here)[::-1])[::-1] - here
    return (left | right) & 1 == 0


def _pick(code: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs `code` at positions `at` (ascending): those that occur `least` times, the most frequent first; which
    positions are replaced (they don't overlap); the index of the pair at each of these; which positions to count again."""
    none = np.zeros(0, np.int64)
    # Of a run of one pair (aaa) every second counts, from the left.
    live = np.ones(len(code), bool)
    same = np.flatnonzero((code[1:] == code[:-1]) & (at[1:] == at[:-1] + 1))
    if len(same):
        head = np.concatenate(([True], same[1:] != same[:-1] + 1))
        turn = np.arange(len(same)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        live[same[turn % 2 == 0] + 1] = False
    ordered = np.sort(code[live])
    new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(new, append=len(ordered))
    often = np.flatnonzero(counts >= least)
    if not len(often):
        return ordered[:0], none, none, none
    pairs = ordered[new[often]]
    pairs = pairs[np.argsort(-counts[often], kind="stable")]
    # A table of bins finds a position's pair; of pairs that share a bin the more frequent one stays for this round.
    wide, width = min(_BINS, len(pairs).bit_length() + 3), 8 * code.itemsize
    bins = lambda x: ((x * (np.uint32(2654435769) if width == 32 else np.uint64(0x9E3779B97F4A7C15))) >> x.dtype.type(width - wide)).astype(np.uint32)
    places = bins(pairs)
    _, first = np.unique(places, return_index=True)
    first.sort()
    pairs, places = pairs[first], places[first]
    table = np.full(1 << wide, -1, np.int32)
    table[places] = np.arange(len(pairs), dtype=np.int32)
    rank = table[bins(code)]
    again = rank >= 0  # a pair elsewhere is seldom, and will be: its count only falls
    hit = np.flatnonzero(again & live & (pairs[rank] == code))
    rank = rank[hit]
    stay = _apart(at[hit], rank)
    # The first pair loses nothing to others; one that is left too few places waits, and is counted again in the next round.
    enough = np.bincount(rank[stay], minlength=len(pairs)) >= least
    stay &= enough[rank]
    return pairs[enough], hit[stay], (np.cumsum(enough) - 1)[rank[stay]], again


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, rules, lengths, symbols) of one shard. Symbol i is an id of the alphabet, or nonterminal i - len(alphabet).

    After the first round only positions next to a new symbol, and those of pairs that were frequent
    and stayed, can hold a frequent pair: no others are counted.
    """
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(seen)
    narrow = np.zeros(len(seen), np.uint32)
    narrow[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    symbols = narrow[ids]
    half = 16 if len(alphabet) <= 1 << 16 else 32
    rules: list[np.ndarray] = []
    lengths = np.ones(len(alphabet), np.int64)
    place = np.arange(max(len(symbols) - 1, 0), dtype=np.int32)
    while len(place):
        kind = np.uint32 if half == 16 else np.uint64
        code = (symbols[place].astype(kind) << kind(half)) | symbols[place + 1].astype(kind)
        pairs, hit, r, again = _pick(code, place, least)
        if not len(pairs):
            break
        rules.append(np.stack((pairs >> kind(half), pairs & kind((1 << half) - 1)), axis=1).astype(np.int64))
        at = place[hit]
        symbols[at] = (len(lengths) + r).astype(np.uint32)
        lengths = np.concatenate((lengths, lengths[rules[-1]].sum(axis=1)))
        keep, count = np.ones(len(symbols), bool), np.zeros(len(symbols), bool)
        keep[at + 1] = False
        count[place[again]] = count[at] = count[np.maximum(at - 1, 0)] = True
        symbols, place = symbols[keep], np.flatnonzero(count[keep][:-1]).astype(np.int32)
        if half == 16 and len(lengths) > 1 << 16:
            half = 32
    every = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return alphabet.astype(np.uint32), every.astype(np.uint32), lengths[len(alphabet) :].astype(np.uint32), symbols.astype(np.uint32)


def _narrow(numbers: np.ndarray, width: int) -> bytes:
    """numbers of `width` bits each, the highest first, end to end."""
    parts = []
    for i in range(0, len(numbers), _CHUNK):
        part = numbers[i : i + _CHUNK].astype(">u4")
        parts.append(np.packbits(np.unpackbits(part.view(np.uint8)).reshape(len(part), 32)[:, 32 - width :]).tobytes())
    return b"".join(parts)


def _widen(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for i in range(0, n, _CHUNK):
        many = min(_CHUNK, n - i)
        bits = np.zeros((many, 32), np.uint8)
        bits[:, 32 - width :] = np.unpackbits(data[i * width // 8 :], count=many * width).reshape(many, width)
        out[i : i + many] = np.packbits(bits).view(">u4")
    return out


def pack_shard(keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, doc_ids: np.ndarray | None = None, nulls: np.ndarray | None = None) -> list[bytes]:
    """The parts of a shard's file. doc_ids: the keys if not given."""
    doc_ids = keys if doc_ids is None else doc_ids
    nulls = np.zeros(len(keys), bool) if nulls is None else nulls
    alphabet, rules, lengths, symbols = compress(ids)
    sizes = np.concatenate((np.ones(len(alphabet), np.int64), lengths.astype(np.int64)))
    blocks = -(-len(symbols) // BLOCK)
    index = np.concatenate(([0], np.cumsum(np.add.reduceat(sizes[symbols], np.arange(0, len(symbols), BLOCK)))))[:blocks] if blocks else np.zeros(0, np.int64)
    wide = [int(x.max(initial=0)).bit_length() for x in (rules, lengths, symbols)]
    head = _HEAD.pack(MAGIC, len(alphabet), len(rules), len(keys), len(symbols), len(index), *wide)
    return [head, keys.astype("<i8").tobytes(), doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), counts.astype("<u4").tobytes(), alphabet.astype("<u4").tobytes(), index.astype("<u8").tobytes(), *(_narrow(x.ravel(), w) for x, w in zip((rules, lengths, symbols), wide, strict=True))]


def parse_shard(data: bytes) -> Shard:
    magic, n_ids, n_rules, n_docs, n_symbols, n_index, *wide = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    keys, doc_ids, nulls, counts, alphabet, index = take("<i8", n_docs), take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<u4", n_docs), take("<u4", n_ids), take("<u8", n_index)
    rules, lengths, symbols = (_widen(take("u1", -(-n * w // 8)), n, w) for n, w in zip((2 * n_rules, n_rules, n_symbols), wide, strict=True))
    return Shard(keys, doc_ids, nulls, counts, alphabet, rules.reshape(-1, 2), lengths, symbols, index)


def _pool(s: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expansions of all symbols laid end to end, with where each starts and its size."""
    size = np.concatenate((np.ones(len(s.alphabet), np.int64), s.lengths.astype(np.int64)))
    ends = np.cumsum(size)
    kind = np.int32 if not len(ends) or ends[-1] < 1 << 31 else np.int64
    start, size = (ends - size).astype(kind), size.astype(kind)
    pool = np.zeros(int(size.sum(dtype=np.int64)), np.uint32)
    pool[: len(s.alphabet)] = s.alphabet
    # A rule refers to earlier symbols only: rules up to the first that refers to one of them are filled together.
    latest, i = s.rules.max(axis=1, initial=0).astype(np.int64) - len(s.alphabet), 0
    while i < len(latest):
        later = latest[i:] >= i
        j = i + int(later.argmax()) if later.any() else len(latest)
        at = int(start[len(s.alphabet) + i])
        part = expand(s, s.rules[i:j].ravel(), (pool, start, size))
        pool[at : at + len(part)] = part
        i = j
    return pool, start, size


def expand(s: Shard, symbols: np.ndarray, pool: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    data, start, size = pool
    n = size[symbols]
    ends = np.cumsum(n, dtype=np.int64)
    if not len(ends):
        return np.zeros(0, np.uint32)
    kind = np.int32 if max(int(ends[-1]), len(data)) < 1 << 31 else np.int64
    return data[np.repeat((start[symbols] - (ends - n)).astype(kind), n) + np.arange(ends[-1], dtype=kind)]


def descend(s: Shard, symbols: np.ndarray, base: int, low: int, high: int) -> np.ndarray:
    """ids low to high of what symbols expand to, whose first id is number `base`: level by level, and at each level only the symbols whose expansions overlap the range."""
    n = len(s.alphabet)
    size = np.concatenate((np.ones(n, np.int64), s.lengths.astype(np.int64)))
    symbols = symbols.astype(np.int64)
    while True:
        ends = base + np.cumsum(size[symbols])
        within = (ends > low) & (ends - size[symbols] < high)
        if not within.any():
            return np.zeros(0, np.uint32)
        base = int((ends - size[symbols])[within.argmax()])
        symbols = symbols[within]
        rule = symbols >= n
        if not rule.any():
            return s.alphabet[symbols]
        many = 1 + rule
        at = (np.cumsum(many) - many)[rule]
        pairs = s.rules[symbols[rule] - n]
        symbols = np.repeat(symbols, many)
        symbols[at], symbols[at + 1] = pairs[:, 0], pairs[:, 1]


def document(s: Shard, i: int, pool: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Random access: ids of the i-th document of a shard. Without a pool of all expansions (made once where many documents are read), rules are followed down by their lengths, for that document alone."""
    low = int(s.counts[:i].astype(np.int64).sum())
    high = low + int(s.counts[i])
    if low == high:
        return np.zeros(0, np.uint32)
    first = int(np.searchsorted(s.index, low, side="right")) - 1
    last = int(np.searchsorted(s.index, high, side="left"))
    symbols, base = s.symbols[first * BLOCK : last * BLOCK], int(s.index[first])
    return descend(s, symbols, base, low, high) if pool is None else expand(s, symbols, pool)[low - base : high - base]


def _writer(root: str, vocabulary: str, end: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, partition = encoder(vocabulary), TaskContext.get().partitionId()
        docs: list[pa.Table] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = shards = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, counts, parts, held, shards
            path = f"{root}/part-{partition:06d}-{shards:05d}.tlrp"
            table = pa.concat_tables(docs)
            names = table.column("doc_id").combine_chunks()
            packed = pack_shard(table.column("_key").to_numpy(), np.concatenate(counts), np.concatenate(parts), names.cast(pa.int64()).fill_null(0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False))
            size = write_file(path, packed)
            out = pa.record_batch([pa.array([path]), pa.array([partition], pa.int32()), pa.array([shards], pa.int32()), pa.array([table.num_rows], pa.int64()), pa.array([held], pa.int64()), pa.array([size], pa.int64())], names=["path", "part", "shard", "n_docs", "n_ids", "n_bytes"])
            docs, counts, parts, held, shards = [], [], [], 0, shards + 1
            return out

        for part in grouped(batches, TEXTS):
            docs.append(part.select(["_key", "doc_id"]))
            n, ids = tool.flat(part.column("_text"))
            lined = np.full(len(ids) + len(n), end, np.uint32)
            inside = np.ones(len(lined), bool)
            inside[np.cumsum(n + 1) - 1] = False
            lined[inside] = ids
            counts.append(n + 1)
            parts.append(lined)
            held += len(lined)
            if held >= shard_ids:
                yield flush()
        if docs:
            yield flush()

    return run


def write(documents: DataFrame, root: str, vocabulary: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes all documents to files under root. Returns the manifest: path, part, shard, n_docs, n_ids, n_bytes, start (ids before the file).

    documents: _key, doc_id (an integer), text. Parts hold ascending ranges of keys, and shards follow within a part.
    """
    sc = documents.sparkSession.sparkContext
    docs = documents.select("_key", "doc_id", F.col("text").alias("_text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, as the planner knows it
    if size > 1 << 55:  # it doesn't
        size = docs.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    ranged = docs.repartitionByRange(partitions_for(size, BYTES_PER_TASK, sc.defaultParallelism), "_key").sortWithinPartitions("_key")
    run = _writer(root, vocabulary or default_vocabulary(), end, shard_ids)
    manifest = materialize(ranged.mapInArrow(bytewords.tidy(run), "path string, part int, shard int, n_docs long, n_ids long, n_bytes long"), "manifest")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # a row for each task
    parts = parts.select("part", before(Window.orderBy("part")).alias("_before"))
    return manifest.join(F.broadcast(parts), "part").withColumn("start", F.col("_before") + before(Window.partitionBy("part").orderBy("shard"))).drop("_before")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            s = parse_shard(read_file(path))
            pool = _pool(s)
            ids = expand(s, s.symbols, pool)
            ends = np.cumsum(s.counts.astype(np.int64))
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.record_batch([pa.array(s.keys), pa.array(s.doc_ids, mask=s.nulls), pa.array(start + ends - s.counts), pa.array(s.counts.astype(np.int64)), pa.array(crcs, pa.int64())], names=["_key", "doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """_key, doc_id, start, n_tokens, ids_crc32 of every document, from the files; a task reads one file at a time."""
    files = manifest.select("path", "start").repartition(partitions_for(manifest.count(), 4, 1), "path")
    return files.mapInArrow(bytewords.tidy(_read), "_key long, doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_repair_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    manifest = materialize(write(docs, shared_path(spark, "tokens")), "manifest")
    return read(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
