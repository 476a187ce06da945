"""Removal of repeated byte strings: positions whose longest previous factor (LPF) reaches a length.

A byte goes if some string of `length` bytes that covers it also starts earlier: in a smaller
doc_id, or in the same document before. Strings are judged on the input.

One suffix array over a corpus can't be built in one place, so suffix space is split by content:
each string of `length` bytes is keyed by the smallest-hashed 20-byte gram inside it, which equal
strings share. The strings keyed by one occurrence of a gram are consecutive, and form a segment.
A gram that stands in very many different segments (a common line that is shorter than `length`)
would bring them all to one task: its strings are keyed by where the gram stands in them, in steps
of STRETCH places, and by the bytes that all strings of such a step have in common. Where a passage of
many texts begins or ends, those bytes are alike while the few beside them differ; such a step's strings
are keyed one by one, by all their bytes.
  1. Of documents with equal bytes the first stands for all; the others go whole.
  2. Segments with equal bytes keep their first; the others go whole. This needs no text. A task finds
     equal ones among HELD of its own first, so that a passage of all texts comes to the task of its key
     once for each HELD segments of the corpus.
  3. Where segments that differ share a key (the ends of repeated passages), the first of each are
     brought together. Their suffixes are sorted to depth `length`; the previous and the next
     smaller position in suffix order, with the common prefixes that lie between, give each
     position's LPF (to that depth) and source. A position goes if its LPF reaches `length`.
A document's spans meet once more with its text, which is cut there.

Equality is that of MD5 in step 1, and of a 64-bit hash of segments with the same 64-bit key in
step 2; step 3 compares bytes.

Defined results
  null or empty text     0 bytes, nothing removed, the checksum of no bytes
  fewer than `length`    nothing removed
  null doc_id            ordered before all others (see common.keyed)
  repeated doc_id, rows  ordered by text; of rows that are repeated whole one is the first
  very long text         one step of its own; memory grows with the single text only
  empty table            no rows
  extra columns          ignored by dedup(); cut_documents() passes them through
  a cut within a character   dedup() counts and hashes bytes; cut_documents(), whose texts are strings,
                         drops what is left of that character as well
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import bytewords
from tallyloom.llm.common import keyed, materialize, packed, partitions_for, read_table

LENGTH = 100
GRAM = 20
BYTES_PER_TASK = 24 << 20
#: Up to so many ids (12 MB) of copies are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_500_000
SEGMENTS_PER_TASK = 40_000
#: A gram is hot if so many different segments have it, and one in so many of all: there are no more hot grams than
#: HOT_SHARE (8 MB to broadcast) at any scale, and no other gram has more segments than that.
HOT_LEAST, HOT_SHARE = 1000, 1_000_000
#: Segments (16 to 36 bytes each) that a task holds at once.
HELD = 1_000_000
#: Places of a hot gram that one key takes together.
STRETCH = 8

_NAMES = ["kind", "gram", "same", "_key", "start", "size"]
_SCHEMA = "kind int, gram long, same long, _key long, start int, size int"
#: kind of a row: bytes that go; a segment whose text is needed; a segment.
SPAN, NEED, SEGMENT = range(3)
_LOW = np.uint64((1 << 24) - 1)


def longest_previous_factors(data: bytes) -> list[int]:
    """The LPF array of data: at each position, the longest match that starts earlier.

    The suffix array comes by prefix doubling; the previous and next smaller positions in suffix
    order by a stack, with the common prefixes that lie between (the plain form, for small data).
    """
    n = len(data)
    rank, k = list(data), 1
    order = list(range(n))
    while True:
        key = [(rank[i], rank[i + k] if i + k < n else -1) for i in range(n)]
        order.sort(key=key.__getitem__)
        new = [0] * n
        for a, b in zip(order, order[1:], strict=False):
            new[b] = new[a] + (key[a] != key[b])
        rank, k = new, 2 * k
        if n == 0 or rank[order[-1]] == n - 1 or k > 2 * n:
            break

    def common(i: int, j: int) -> int:
        m = 0
        while max(i, j) + m < n and data[i + m] == data[j + m]:
            m += 1
        return m

    lpf = [0] * n
    for run in (order, order[::-1]):  # previous smaller, then next smaller
        stack: list[int] = []
        for p in run:
            while stack and stack[-1] > p:
                stack.pop()
            if stack:
                lpf[p] = max(lpf[p], common(p, stack[-1]))
            stack.append(p)
    return lpf


def _among(values: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if known is None or not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _segments(raw: np.ndarray, offsets: np.ndarray, length: int, hot: np.ndarray | None = None, fine: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(key, fingerprint, text, start in text, size, whether a hot gram's) of the segments of texts laid end to end, by text and start.

    hot: sorted grams whose strings are keyed by stretches; fine: sorted keys of stretches whose strings are keyed one by one.
    """
    n, window = len(raw), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none.astype(bool)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(bytewords._TABLE[raw] * bytewords._powers("base", bytewords._BASE, n), out=sums[1:])
    inverse = bytewords._powers("inverse", bytewords._INVERSE, n)
    gram = bytewords.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    # The smallest gram of each window by doubling; the low bits hold its place, so that of equal ones the first wins.
    wide = n > int(_LOW)
    if wide:
        low = _least_of_long(gram, window)
    else:
        least, have = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64), 1
        while have < window:
            step = min(have, window - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        low = (least & _LOW).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    first, last = offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    valid = np.cumsum(inside[: len(low)]) > 0
    new = valid.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    heads = first[(first < len(low)) & (last > first)]
    new[heads] = True
    end = valid.copy()
    end[:-1] &= ~valid[1:] | new[1:]
    start, stop = np.flatnonzero(new), np.flatnonzero(end) + length
    place = low[start]
    key = gram[place]
    split = _among(key, hot)
    if split.any():
        # Stretch b of a gram holds the strings that start STRETCH * b to STRETCH * (b + 1) - 1 places before it.
        far, near = np.where(split, (place - start) // STRETCH, 0), np.where(split, (place - (stop - length)) // STRETCH, 0)
        many = far - near + 1
        owner = np.repeat(np.arange(len(start)), many)
        b = far[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
        split, key, at = split[owner], key[owner], place[owner] - STRETCH * b
        first, last = np.maximum(start[owner], at - STRETCH + 1), np.minimum(stop[owner] - length, at)
        start, stop = np.where(split, first, start[owner]), np.where(split, last + length, stop[owner])
        at, to = np.where(split, at, 0), np.where(split, at - STRETCH + 1 + length, 0)
        shared = bytewords.mix((sums[to] - sums[at]) * inverse[at])
        key = np.where(split, bytewords.mix(shared ^ (key + b.astype(np.uint64) * bytewords._BASE)), key)
        alone = split & _among(key, fine)
        if alone.any():
            many = np.where(alone, stop - start - length + 1, 1)
            owner = np.repeat(np.arange(len(start)), many)
            alone, split, key = alone[owner], split[owner], key[owner]
            start = start[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
            stop = np.where(alone, start + length, stop[owner])
            key = np.where(alone, bytewords.mix((sums[stop] - sums[start]) * inverse[start] + bytewords._INVERSE), key)
    same = bytewords.mix((sums[stop] - sums[start]) * inverse[start])
    text = np.searchsorted(offsets, start, side="right") - 1
    return key, same, text, start - offsets[text], stop - start, split


def _least_of_long(gram: np.ndarray, window: int) -> np.ndarray:
    """As the doubling in _segments(), block by block, for a text too long for the low bits."""
    block, out = 1 << 23, []
    for at in range(0, len(gram) - window + 1, block):
        part = gram[at : at + block + window - 1]
        least, have = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64), 1
        while have < window:
            step = min(have, window - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        out.append((least & _LOW).astype(np.int64) + at)
    return np.concatenate(out)


def _rows(kind: int, gram, same, key, start, size) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(key), kind, np.int32)), pa.array(gram.view(np.int64)), pa.array(same.view(np.int64)), pa.array(key), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=_NAMES)


def _crowded(length: int, hot: Broadcast | None = None):
    """Keys that two or more different segments of a task's run of HELD segments have, and how many; all segments of the run at gram 0. With hot grams: keys of their stretches only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            gram, same = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64),) * 2
            held.clear()
            order = np.lexsort((same, gram))
            gram, same = gram[order], same[order]
            gram = gram[np.concatenate(([True], (gram[1:] != gram[:-1]) | (same[1:] != same[:-1])))[: len(gram)]]
            new = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))[: len(gram)])
            n = np.diff(new, append=len(gram))
            many = n > 1
            yield pa.record_batch([pa.array(np.append(gram[new][many].view(np.int64), 0)), pa.array(np.append(n[many], len(gram)))], names=["gram", "n"])

        for batch in batches:
            raw, offsets = bytewords.texts_of(batch.column("_text"))
            for a, b in bytewords.steps(raw, offsets):
                gram, same, *_, split = _segments(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, hot and hot.value)
                held.append((gram[split], same[split]) if hot else (gram, same))
                if sum(len(g) for g, _ in held) > HELD:
                    yield from flush()
        yield from flush()

    return run


def _cut_up(length: int, hot: Broadcast, fine: Broadcast):
    """Each text's segments. Of equal ones among HELD that a task holds at once, the first stays and the others are spans. hot, fine: sorted arrays, see _segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            gram, same, key, start, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((start, key, same, gram))
            g, s = gram[order], same[order]
            again = np.zeros(len(order), bool)
            again[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
            repeat = np.zeros(len(order), bool)
            repeat[order[again]] = True
            k, at, to = key[repeat], start[repeat], (start + size)[repeat]  # by text and start: spans that touch become one
            if len(k):
                head = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (at[1:] > to[:-1]))))
                tail = np.append(head[1:], len(k)) - 1
                yield from _in_parts(SPAN, gram[repeat][head], same[repeat][head], k[head], at[head], to[tail] - at[head])
            keep = ~repeat
            yield from _in_parts(SEGMENT, gram[keep], same[keep], key[keep], start[keep], size[keep])

        for batch in batches:
            raw, offsets = bytewords.texts_of(batch.column("_text"))
            keys = batch.column("_key").to_numpy()
            for a, b in bytewords.steps(raw, offsets):
                gram, same, text, start, size, _ = _segments(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, hot.value, fine.value)
                held.append((gram, same, keys[a:b][text], start, size))
                if sum(len(h[0]) for h in held) > HELD:
                    yield from flush()
        yield from flush()

    return run


def _in_parts(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 100_000):
        yield _rows(kind, *(c[i : i + 100_000] for c in columns))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Segments by their gram; spans, which need meet nothing, by their place: a passage that all texts have is no key."""
    return rows.repartition(parts, F.when(F.col("kind") == SEGMENT, F.col("gram")).otherwise(F.xxhash64("_key", "start")))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of one gram together: those that repeat an earlier one become spans; of grams with several, the first of each is needed."""
    batches = list(batches)
    table = pa.Table.from_batches(batches) if batches else None
    if table is None or not table.num_rows:
        return
    kind, gram, same, key, start, size = (table.column(c).to_numpy() for c in _NAMES)
    done = kind == SPAN
    if done.any():
        yield _rows(SPAN, gram[done], same[done], key[done], start[done], size[done])
    order = np.lexsort((start, key, same, gram))
    order = order[~done[order]]
    if not len(order):
        return
    gram, same, key, start, size = (x[order] for x in (gram, same, key, start, size))
    new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
    first = new_gram | np.concatenate(([True], same[1:] != same[:-1]))
    group = np.cumsum(new_gram) - 1
    mixed = np.bincount(group[first], minlength=group[-1] + 1) > 1
    for kind, chosen in ((SPAN, ~first), (NEED, first & mixed[group])):
        yield from _in_parts(kind, *(c[chosen] for c in (gram, same, key, start, size)))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments wanted of each text."""
    for batch in batches:
        raw, offsets = bytewords.texts_of(batch.column("_text"))
        wanted = batch.column("wanted")
        flat = wanted.flatten()
        n = np.diff(wanted.offsets.to_numpy())
        start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
        begin = np.repeat(offsets[:-1], n) + start
        keys = np.repeat(batch.column("_key").to_numpy(), n)
        grams = flat.field("gram").to_numpy()
        for i in range(0, len(begin), 20_000):
            b, s = begin[i : i + 20_000], size[i : i + 20_000].astype(np.int64)
            ends = np.cumsum(s)
            index = np.arange(ends[-1]) - np.repeat(ends - s, s) + np.repeat(b, s)
            data = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(raw[index])])
            yield pa.record_batch([pa.array(grams[i : i + 20_000]), pa.array(keys[i : i + 20_000]), pa.array(start[i : i + 20_000]), data], names=["gram", "_key", "start", "bytes"])


def _ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(depth, for each position the rank of so many bytes from there): prefix doubling, cut at `length`.

    At depth 8 the rank is the bytes themselves.
    """
    padded = np.concatenate((data, np.zeros(length, np.uint8))).astype(np.uint64)
    key, depth = np.zeros(len(data), np.uint64), min(8, length)
    for i in range(depth):
        key = (key << np.uint64(8)) | padded[i : i + len(data)]
    levels = [(depth, key)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64) if depth < length else key
    while depth < length:
        step = min(depth, length - depth)
        later = np.concatenate((rank[step:], np.zeros(step, np.uint64)))
        rank = np.unique((rank << np.uint64(32)) | later, return_inverse=True)[1].astype(np.uint64)
        depth += step
        levels.append((depth, rank))
    return levels


def _common(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common prefixes, to the greatest depth, of what starts at a and at b."""
    out = np.zeros(len(a), np.int64)
    for depth, rank in reversed(levels):  # after the greatest depth, each halves what can be left
        more = np.flatnonzero(out + depth <= levels[-1][0])
        same = more[rank[a[more] + out[more]] == rank[b[more] + out[more]]]
        out[same] += depth
    depth, key = levels[0]
    part = np.flatnonzero(out < levels[-1][0])
    differ = key[a[part] + out[part]] ^ key[b[part] + out[part]]
    extra = sum((differ < np.uint64(1 << 8 * (depth - k))).astype(np.int64) for k in range(1, depth))
    out[part] = np.minimum(out[part] + extra, levels[-1][0])
    return out


def _smaller(position: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order: the nearest place before it with a smaller position, and the least common prefix between (0: none).

    common[i]: of places i - 1 and i. All places go at once: one that meets a larger position passes
    on to where that one has come, since all between are larger still.
    """
    at, least = np.arange(len(position)) - 1, common.copy()
    open_ = np.flatnonzero(least > 0)
    while len(open_):
        open_ = open_[position[at[open_]] > position[open_]]
        over = at[open_]
        least[open_], at[open_] = np.minimum(least[open_], least[over]), at[over]
        open_ = open_[least[open_] > 0]
    return at, least


def previous_factors(data: np.ndarray, position: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(LPF to depth `length`, where that factor starts or -1) of each of the positions, among those of its group.

    position: ascending, each with `length` bytes in its own text; group: of each position.
    """
    levels = _ranks(data, length)
    order = np.lexsort((position, levels[-1][1][position], group))  # the suffix array, to this depth
    p, g = position[order], group[order]
    common = np.zeros(len(p), np.int64)
    together = np.flatnonzero(g[1:] == g[:-1]) + 1
    common[together] = _common(levels, p[together - 1], p[together])
    at, before = _smaller(p, common)
    # The next smaller ones are the previous ones of the order turned round.
    back, after = _smaller(p[::-1], np.append(0, common[:0:-1])[: len(p)])
    back, after = len(p) - 1 - back[::-1], after[::-1]
    lpf, source = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    lpf[order] = np.maximum(before, after)
    near = np.where(before >= after, at, back)
    source[order] = np.where(np.maximum(before, after) > 0, p[np.clip(near, 0, len(p) - 1)], -1)
    return lpf, source


def _factors(length: int):
    """Spans of positions whose LPF among the segments of their gram reaches length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        gram, key, start = (table.column(c).to_numpy() for c in ("gram", "_key", "start"))
        order = np.lexsort((start, key, gram))  # within a gram, by place in the corpus
        gram, key, start = gram[order], key[order], start[order]
        raw, offsets = bytewords.texts_of(table.column("bytes").combine_chunks().take(pa.array(order)))
        new = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        # Buckets never share strings, so they can be sorted in parts of a few MB.
        first = 0
        while first < len(new):
            last = first + 1
            while last < len(new) and offsets[new[last]] - offsets[new[first]] < bytewords.STEP // 2:
                last += 1
            a, b = new[first], new[last] if last < len(new) else len(gram)
            yield from _sort_buckets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], gram[a:b], key[a:b], start[a:b])
            first = last

    def _sort_buckets(data, at, gram, key, start) -> Iterator[pa.RecordBatch]:
        many = np.maximum(np.diff(at) - length + 1, 0)  # suffixes that are long enough, segment by segment
        segment = np.repeat(np.arange(len(many)), many)
        ends = np.cumsum(many)
        position = np.arange(ends[-1]) - np.repeat(ends - many, many) + np.repeat(at[:-1], many)
        lpf, _ = previous_factors(data, position, gram[segment], length)
        later = lpf >= length
        hit = np.flatnonzero(later)
        if not len(hit):
            return
        head = np.concatenate(([True], (position[hit][1:] != position[hit][:-1] + 1) | (segment[hit][1:] != segment[hit][:-1])))
        h = np.flatnonzero(head)
        t = np.append(h[1:], len(hit)) - 1
        s = segment[hit[h]]
        begin = start[s] + (position[hit[h]] - at[s])
        yield pa.record_batch([pa.array(key[s]), pa.array(begin.astype(np.int32)), pa.array((position[hit[t]] - position[hit[h]] + length).astype(np.int32))], names=["_key", "start", "size"])

    return run


def _hot_keys(docs: DataFrame, length: int, hot: Broadcast | None = None) -> Broadcast:
    """The grams that very many different segments have, sorted: HOT_SHARE of them at most. With hot grams: of the keys of their stretches."""
    if hot is not None and not len(hot.value):
        return hot
    crowd = docs.mapInArrow(bytewords.tidy(_crowded(length, hot)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST)
    crowd = materialize(crowd, "crowded")
    segments = crowd.where("gram = 0").agg(F.max("n")).first()[0] or 0
    hot = crowd.where((F.col("gram") != 0) & (F.col("n") >= segments // HOT_SHARE)).toPandas()["gram"].to_numpy(np.int64).view(np.uint64)
    return docs.sparkSession.sparkContext.broadcast(np.sort(hot))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_key, spans) of each document that loses bytes; docs: _key, _text. Spans may overlap."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    known = docs.select("_key", F.md5(F.col("_text").cast("binary")).alias("identity"), F.octet_length("_text").alias("n")).where(F.col("n") >= length)
    known = materialize(known, "identities")
    copies = known.groupBy("identity", "n").agg(F.min("_key").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = materialize(copies, "groups")  # so that the join with a group of very many copies can be split
    later = materialize(known.join(copies, ["identity", "n"]).where("_key != first").select("_key", F.lit(0).alias("start"), F.col("n").alias("size")), "copies")
    ids = later.select("_key")
    firsts = docs.join(F.broadcast(ids) if later.count() <= BROADCAST_ROWS else ids, "_key", "left_anti")
    total = known.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    hot = _hot_keys(firsts, length)
    fine = _hot_keys(firsts, length, hot)
    rows = _dealt(firsts.mapInArrow(bytewords.tidy(_cut_up(length, hot, fine)), _SCHEMA), partitions_for(total, BYTES_PER_TASK, cores))
    met = materialize(rows.mapInArrow(bytewords.tidy(_meet), _SCHEMA), "met")
    need = met.where(F.col("kind") == NEED)
    wanted = need.groupBy("_key").agg(F.collect_list(F.struct("gram", "start", "size")).alias("wanted"))
    many = need.count()
    fetched = docs.join(wanted, "_key").mapInArrow(bytewords.tidy(_fetch), "gram long, _key long, start int, bytes binary")
    ends = fetched.repartition(partitions_for(many, SEGMENTS_PER_TASK, cores), "gram").mapInArrow(bytewords.tidy(_factors(length)), "_key long, start int, size int")
    found = later.unionByName(met.where(F.col("kind") == SPAN).select("_key", "start", "size")).unionByName(ends)
    return found.groupBy("_key").agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def _kept(text: memoryview, cuts: list[dict] | None) -> tuple[bytes, int, int]:
    """(bytes that stay, how many go, in how many runs)."""
    if not cuts:
        return bytes(text), 0, 0
    parts, at, gone, runs, end = [], 0, 0, 0, -1
    for start, size in sorted((c["start"], c["size"]) for c in cuts):
        if start > end:
            runs += 1
            parts.append(text[at:start])
        stop = max(at, start + size)
        gone += stop - max(start, at)
        at = end = stop
    parts.append(text[at:])
    return b"".join(parts), gone, runs


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = bytewords.texts_of(batch.column("_text"))
        view, out = memoryview(raw), []
        for i, j, cuts in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
            kept, gone, runs = _kept(view[i:j], cuts)
            out.append((j - i, gone, runs, hashlib.sha256(kept).hexdigest()))
        n_bytes, gone, runs, digest = zip(*out, strict=True) if out else ((),) * 4
        yield pa.record_batch([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = keyed(documents.select("doc_id", "text")).select("_key", "doc_id", F.col("text").alias("_text"))
    out = docs.join(spans(docs.select("_key", "_text"), length), "_key", "left").select("doc_id", "_text", "spans")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(bytewords.tidy(_digests), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            # A character that a cut has split goes as well.
            texts.append(text if not cuts or text is None else _kept(memoryview(text.encode()), cuts)[0].decode("utf-8", "ignore"))
        yield pa.record_batch([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "text"])


def cut_documents(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with all their columns; text without the bytes that repeat earlier ones."""
    docs = keyed(packed(documents))
    found = spans(docs.select("_key", F.col("text").alias("_text")), length)
    out = docs.join(found, "_key", "left").select(F.col("_row").dropFields("text").alias("_row"), "text", "spans")
    rest = T.StructType([f for f in documents.schema.fields if f.name != "text"])
    cut = out.mapInArrow(bytewords.tidy(_cut_texts), T.StructType([T.StructField("_row", rest), T.StructField("text", T.StringType())]))
    return cut.select(*("text" if c == "text" else F.col(f"_row.`{c}`") for c in documents.columns))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))
