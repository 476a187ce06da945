"""Exact Jaccard self-join of documents' word shingles by prefix filtering with set-relation skipping.

Sets that are equal form one class, whose answers are computed once. Classes are joined over index
lists keyed by the shingles of their prefixes, under an order that puts frequent shingles last:
any total order gives the same links, so the frequencies are only ever an aid.

Index-level skipping: a list is sorted by set size; a set's partners are one block of sizes, and
within it entries whose positions leave too few shingles for the overlap needed are skipped.
Answer-level skipping: a list's sets are first compared to one leader of their size; sets found
similar to it share its component, and later only pairs between different components are compared
(all of them, so no link between components is lost).

Numbers of links are derived from leaders' answers. All links of a set lie in its component, whose
sets meet in cells of bounded size (of sizes that suit, see _cells). A cell's leader is compared to
every set of it; by the triangle inequality its distances decide most other pairs, and the overlaps
of those left open are the leader's, corrected by the shingles in which a set differs from it. Pairs
are counted, never put out.

Before two sets meet whole, their parity bitmaps do: bits that differ bound the shingles that
aren't shared from below, so a pair that fails here can't be a link.

Defined results
  null or empty text, or no words   n_shingles 0, n_links 0, component_id its own doc_id
  fewer than `width` words          the whole sequence is the one shingle
  equal texts                       one class: the same component, and links among them all
  null or repeated doc_id           rows are kept apart (see common.keyed); component_id is the smallest
                                    doc_id that is not null in the component, null if there is none
  empty table                       no rows
  extra columns                     ignored by join(); stage() passes the columns of documents through
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bytewords
from tallyloom.llm.common import discard, keyed, materialize, packed, partitions_for, read_table
from tallyloom.llm.components import components

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
WIDTH = 5
#: A shingle is frequent if it is seen in a documents' share of 1 / RARE or more. Shares of a corpus's
#: documents add up to the mean set size, so at most RARE * mean size shingles are frequent, at any scale.
RARE = 4000
#: Lists of up to so many sets yield their pairs at once; longer ones go by leaders.
SHORT_LIST = 6
POSTINGS_PER_TASK = 600_000
#: Pairs of rows that one vectorized step looks at.
PAIRS_AT_ONCE = 1_000_000
#: Shingles (8 bytes each) that a task counts at once to find frequent ones.
HELD = 1_000_000
#: A cell of a component holds sets of about so many shingles; a set counts as PER_SET shingles more.
CELL_ITEMS = 400_000
PER_SET = 200
#: Sets whose sizes lie in bands further apart than one can't be similar: a band is a little wider than a link allows.
BAND = 101 / PERCENT
#: Rows and columns of a cell that one product takes at once.
CELL_ROWS, CELL_COLUMNS = 256, 2048
#: Components that need more than one cell, up to which they are broadcast; more are joined by a shuffle.
BROADCAST_COMPONENTS = 100_000
#: Up to so many ids (8 MB) of sets to compare are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _least_overlap(total: np.ndarray) -> np.ndarray:
    """Least intersection of two sets whose sizes add up to total: ceil(PERCENT * total / (100 + PERCENT))."""
    return -((-PERCENT * total) // (100 + PERCENT))


def _prefix(n: np.ndarray) -> np.ndarray:
    return n - (PERCENT * n + 99) // 100 + 1


def _index_prefix(n: np.ndarray) -> np.ndarray:
    """How far into a set the first shared shingle can be if the other set is at least as large."""
    return n - _least_overlap(2 * n) + 1


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = bytewords.texts_of(column)
    for first, last in bytewords.steps(raw, offsets):
        hashes, text = bytewords.word_hashes(raw, offsets[first : last + 1])
        yield first, last, *bytewords.shingle_sets(hashes, text, last - first, width)


def _frequent(width: int):
    """Shingles that two or more sets of a task's run of HELD shingles have, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            values = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            held.clear()
            new = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(values)))
            many = n > 1
            yield pa.record_batch([pa.array(values[new][many].view(np.int64)), pa.array(n[many])], names=["shingle", "n"])

        for batch in batches:
            for _, _, values, _ in _sets(batch.column("_text"), width):
                held.append(values)
                if sum(map(len, held)) > HELD:
                    yield from flush()
        yield from flush()

    return run


def _segments(values: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[at[i] : at[i] + lengths[i]] for every i, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    step = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    return values[np.repeat(at, lengths) + step]


def _bitmaps(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """For each set the parity of its shingles over a power of two of bits, at least twice its size."""
    n = np.diff(offsets)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(bits)))
    owner = np.repeat(np.arange(len(n)), n)
    place = (values & (bits[owner] - 1).astype(np.uint64)).astype(np.int64) + at[owner]
    data = np.packbits((np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(data)])


def _not_ruled_out(low: np.ndarray, high: np.ndarray, n_low: np.ndarray, n_high: np.ndarray, bits_low: list[bytes], bits_high: list[bytes]) -> np.ndarray:
    """Whether two sets, by their sizes and parity bitmaps at low[i] and high[i] of the lists, could be similar."""
    keep = np.zeros(len(low), bool)
    sizes_low, sizes_high = np.array([len(x) for x in bits_low])[low], np.array([len(x) for x in bits_high])[high]
    for x, y in sorted(set(zip(sizes_low.tolist(), sizes_high.tolist(), strict=True))):
        rows = np.flatnonzero((sizes_low == x) & (sizes_high == y))
        for i in range(0, len(rows), 20_000):
            r = rows[i : i + 20_000]
            a = np.frombuffer(b"".join([bits_low[k] for k in low[r].tolist()]), np.uint64).reshape(len(r), -1)
            b = np.frombuffer(b"".join([bits_high[k] for k in high[r].tolist()]), np.uint64).reshape(len(r), -1)
            # A bitmap of half the bits is the two halves' difference.
            while a.shape[1] > b.shape[1]:
                a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
            while b.shape[1] > a.shape[1]:
                b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
            total = n_low[r] + n_high[r]
            keep[r] = total - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) >= 2 * _least_overlap(total)
    return keep


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bitmaps don't rule out a link."""
    for batch in batches:
        at = np.arange(batch.num_rows)
        keep = pa.array(_not_ruled_out(at, at, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), batch.column("xa").to_pylist(), batch.column("xb").to_pylist()))
        yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _signatures(frequent, width: int):
    """Size, 128-bit identity, parity bitmap and ordered prefix of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, rank = frequent.value  # sorted shingles; each one's rank by frequency
        near = np.zeros(1 << 22, bool)
        near[shingles >> np.uint64(42)] = True
        for batch in batches:
            keys = batch.column("_key")
            for first, last, values, offsets in _sets(batch.column("_text"), width):
                n = np.diff(offsets)
                a = np.add.reduceat(np.append(bytewords.mix(values), np.uint64(0)), np.minimum(offsets[:-1], len(values))) if last > first else values
                b = np.add.reduceat(np.append(bytewords.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), np.uint64(0)), np.minimum(offsets[:-1], len(values))) if last > first else values
                order = values >> np.uint64(1)
                maybe = np.flatnonzero(near[values >> np.uint64(42)])
                if len(maybe):
                    found = np.searchsorted(shingles, values[maybe])
                    found = np.minimum(found, len(shingles) - 1)
                    hit = shingles[found] == values[maybe]
                    order[maybe[hit]] = np.uint64(1 << 63) + rank[found[hit]]
                    owner = np.repeat(np.arange(last - first), n)
                    mixed = np.unique(owner[maybe[hit]])
                    # Only texts with frequent shingles have to be put in order again.
                    inside = np.isin(owner, mixed)
                    part = np.flatnonzero(inside)
                    order[part] = order[part][np.lexsort((order[part], owner[part]))]
                take = np.where(n > 0, _prefix(n), 0)
                prefix = _segments(order, offsets[:-1], take)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))).astype(np.int32)), pa.array(prefix.view(np.int64)))
                yield pa.record_batch([keys[first:last], pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _bitmaps(values, offsets), lists], names=["_key", "n", "h1", "h2", "bitmap", "prefix"])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """A task's postings (shingle, set, n, at), sorted into lists by shingle and within a list by (size, set)."""
    table = pa.Table.from_batches(batches)
    columns = [table.column(c).to_numpy() for c in ("shingle", "set", "n", "at")]
    order = np.lexsort((columns[1], columns[2], columns[0]))
    return [c[order] for c in columns]


def _passes(n_small, at_small, n_large, at_large) -> np.ndarray:
    """Whether two sets whose first shared shingle stands at these positions can still be similar."""
    size = 100 * n_small >= PERCENT * n_large
    rest = 1 + np.minimum(n_small - at_small - 1, n_large - at_large - 1)
    return size & (at_small < _index_prefix(n_small)) & (rest >= _least_overlap(n_small + n_large))


_OUT = ["kind", "shingle", "a", "b", "at"]
_OUT_SCHEMA = "kind int, shingle long, a long, b long, at int"


def _rows(kind: int, shingle, a, b, at) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(shingle), pa.array(a), pa.array(b), pa.array(at.astype(np.int32))], names=_OUT)


def _distinct_pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[new & (low != high)], high[new & (low != high)]


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: pairs to compare; kind 1: the postings of lists that go by leaders."""
    table = list(batches)
    if not table:
        return
    shingle, sets, n, at = _gather(iter(table))
    del table
    start = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
    length = np.diff(np.append(start, len(shingle)))
    parts = []
    for k in range(2, SHORT_LIST + 1):
        s = start[length == k]
        for i in range(k):
            for j in range(i + 1, k):
                ok = _passes(n[s + i], at[s + i], n[s + j], at[s + j])
                parts.append((sets[s[ok] + i], sets[s[ok] + j]))
    long = length > SHORT_LIST
    rows = _segments(np.arange(len(shingle)), start[long], length[long])
    # Leaders: the middle set of each run of sizes within one step of 12 %.
    size = np.floor(np.log(np.maximum(n[rows], 1)) / np.log(1.12)).astype(np.int64)
    if len(rows):
        new = np.flatnonzero(np.concatenate(([True], (shingle[rows][1:] != shingle[rows][:-1]) | (size[1:] != size[:-1]))))
        many = np.diff(np.append(new, len(rows)))
        lead = np.repeat(rows[new + many // 2], many)
        small, large = np.minimum(lead, rows), np.maximum(lead, rows)  # rows of a list are sorted by size
        ok = _passes(n[small], at[small], n[large], at[large])
        parts.append((sets[small[ok]], sets[large[ok]]))
    low, high = _distinct_pairs(parts)
    yield _rows(0, np.zeros(len(low), np.int64), low, high, np.zeros(len(low)))
    for i in range(0, len(rows), 100_000):
        r = rows[i : i + 100_000]
        yield _rows(1, shingle[r], sets[r], n[r], at[r])


class _Lists:
    """A task's longer lists with the sets' components. A set's bitmap comes once, in a row without a shingle."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        table = pa.Table.from_batches(list(batches))
        bits = table.filter(table.column("shingle").is_null())
        table = table.filter(table.column("shingle").is_valid())
        columns = [table.column(c).to_numpy() for c in ("shingle", "set", "n", "at", "component")]
        order = np.lexsort((columns[1], columns[2], columns[0]))
        self.shingle, self.sets, self.n, self.at, self.component = (c[order] for c in columns)
        ids = bits.column("set").to_numpy()
        order = np.argsort(ids)
        self.ids, self.sizes, self.bits = ids[order], bits.column("n").to_numpy()[order], bits.column("bitmap").take(pa.array(order)).to_pylist()

    def partners(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first, end): the rows outside the largest component of their list, with the block of rows there whose sizes suit.

        Every pair between components has a side outside the largest one.
        """
        new = np.concatenate(([True], self.shingle[1:] != self.shingle[:-1]))
        lists = np.cumsum(new) - 1
        order = np.lexsort((self.component, lists))
        part = np.concatenate(([True], (lists[order][1:] != lists[order][:-1]) | (self.component[order][1:] != self.component[order][:-1])))
        part = np.cumsum(part) - 1
        many = np.bincount(part)
        of = lists[order][np.searchsorted(part, np.arange(len(many)))]  # the list of each (list, component)
        best = np.lexsort((many, of))
        largest = best[np.append(of[best][1:] != of[best][:-1], True)]  # for each list
        self.part = np.empty(len(lists), np.int64)
        self.part[order] = part
        self.outside = self.part != largest[lists]
        rows = np.flatnonzero(self.outside)
        place = (lists << 32) + self.n
        low, high = (lists[rows] << 32) - (-PERCENT * self.n[rows] // 100), (lists[rows] << 32) + 100 * self.n[rows] // PERCENT
        return rows, np.searchsorted(place, low, side="left"), np.searchsorted(place, high, side="right")

    def pairs(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        low, high = _distinct_pairs(parts)
        i, j = np.searchsorted(self.ids, low), np.searchsorted(self.ids, high)
        keep = _not_ruled_out(i, j, self.sizes[i], self.sizes[j], self.bits, self.bits)
        return pa.record_batch([pa.array(low[keep]), pa.array(high[keep])], names=["a", "b"])


def _later_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs between different components."""
    batches = list(batches)
    if not batches:
        return
    x = _Lists(batches)
    del batches
    if not len(x.sets):
        return
    rows, first, end = x.partners()
    many = np.cumsum(end - first)
    parts, held, at = [], 0, 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        width = end[at:to] - first[at:to]
        i = np.repeat(rows[at:to], width)
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[at:to], width)
        ok = (x.part[i] != x.part[j]) & (~x.outside[j] | (j > i))
        i, j = i[ok], j[ok]
        small, large = np.minimum(i, j), np.maximum(i, j)  # rows of a list are sorted by size
        ok = _passes(x.n[small], x.at[small], x.n[large], x.at[large])
        parts.append((x.sets[small[ok]], x.sets[large[ok]]))
        held += int(ok.sum())
        if held > PAIRS_AT_ONCE:
            yield x.pairs(parts)
            parts, held = [], 0
        at = to
    yield x.pairs(parts)


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, values, offsets in _sets(batch.column("_text"), width):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.record_batch([batch.column("_key")[first:last], lists], names=["id", "items"])

    return run


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bitmaps leave, each once, in a written table."""
    xa = classes.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("xa"))
    xb = classes.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("xb"))
    return materialize(pairs.distinct().join(xa, "a").join(xb, "b").mapInArrow(bytewords.tidy(_may_link), "a long, b long"), "pairs")


def _linked(pairs: DataFrame, sets: DataFrame, many: int) -> DataFrame:
    """Of the pairs (a, b), so many in a written table, those whose whole sets are similar enough."""
    few = many <= BROADCAST_IDS

    def chosen(side: str) -> DataFrame:
        """Only the sets that stand on this side of a pair are shuffled."""
        ids = pairs.select(F.col(side).alias("id")).distinct()
        return sets.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    x = chosen("a").select(F.col("id").alias("a"), F.col("items").alias("x"))
    y = chosen("b").select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("_common", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("_common") >= PERCENT * (F.size("x") + F.size("y") - F.col("_common"))).select("a", "b")


def _dense(items: np.ndarray, rows: np.ndarray, many: int, first: int, width: int) -> np.ndarray:
    """Which of the numbered items first to first + width each row has, as 0 and 1; items must be sorted."""
    low, high = np.searchsorted(items, (first, first + width))
    out = np.zeros((many, width), np.float32)
    out[rows[low:high], items[low:high] - first] = 1
    return out


def _cell_links(values: np.ndarray, n: np.ndarray, side: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each set of a cell the weight of the sets it is linked with there: side 0 meets side 1, or itself if there is no other.

    values holds the sets' shingles one after another, n each. The leader, the first set, is compared
    with every other; other sets' answers follow from its overlaps and the shingles where they differ from it.
    """
    low = np.flatnonzero(side == 0)
    high = np.flatnonzero(side == 1)
    alone = not side.any()
    high = low if alone else high
    out = np.zeros(len(n), np.int64)
    if not len(low) or not len(high) or (alone and len(low) < 2):
        return out
    rows = np.repeat(np.arange(len(n)), n)
    _, ids = np.unique(values, return_inverse=True)
    seen = np.bincount(ids)
    led = np.zeros(len(seen), bool)
    led[ids[: n[0]]] = True
    overlap = np.bincount(rows[led[ids]], minlength=len(n))
    distance = n + n[0] - 2 * overlap
    # Shingles that all sets have, or one alone, correct no overlap: but the leader's own, which others lack.
    varies = np.where(led, seen < len(n), seen > 1)
    place = np.cumsum(varies) - 1
    use = varies[ids]
    items, rows = place[ids[use]], rows[use]
    order = np.argsort(items, kind="stable")
    items, rows = items[order], rows[order]
    led = led[varies].astype(np.float32)
    for at in range(0, len(low), CELL_ROWS):
        a = low[at : at + CELL_ROWS]
        total = n[a][:, None] + n[high]
        allowed = total - 2 * _least_overlap(total)
        linked = distance[a][:, None] + distance[high] <= allowed
        maybe = ~linked & (np.abs(distance[a][:, None] - distance[high]) <= allowed)
        if alone:
            maybe &= a[:, None] != high
        x, y = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
        if len(x):
            common = np.repeat(overlap[high[y]][None, :], len(x), axis=0)
            for first in range(0, len(led), CELL_COLUMNS):
                width = min(CELL_COLUMNS, len(led) - first)
                sets = _dense(items, rows, len(n), first, width)
                differ = sets[a[x]] - led[first : first + width]
                common += np.rint(differ @ sets[high[y]].T).astype(np.int64)
            near = common >= _least_overlap(total[np.ix_(x, y)])
            linked[np.ix_(x, y)] |= near & maybe[np.ix_(x, y)]
        if alone:
            linked &= a[:, None] != high
        out[a] += linked @ weight[high]
        if not alone:
            out[high] += weight[a] @ linked
    return out


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of links found in a task's cells."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    del batches
    component, cell, side = (table.column(c).to_numpy() for c in ("component", "cell", "side"))
    order = np.lexsort((table.column("set").to_numpy(), side, cell, component))
    table, component, cell, side = table.take(pa.array(order)), component[order], cell[order], side[order]
    sets, weight = table.column("set").to_numpy(), table.column("many").to_numpy()
    lists = table.column("items").combine_chunks()
    values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    n = np.diff(offsets).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (component[1:] != component[:-1]) | (cell[1:] != cell[:-1]))))
    links = np.zeros(len(sets), np.int64)
    for i, j in zip(new.tolist(), np.append(new[1:], len(sets)).tolist(), strict=True):
        links[i:j] = _cell_links(values[offsets[i] : offsets[j]], n[i:j], side[i:j], weight[i:j])
    yield pa.record_batch([pa.array(sets), pa.array(links)], names=["set", "links"])


def _cells(rows: DataFrame) -> DataFrame:
    """rows (set, n, many, component), once for each cell where the set meets others, with cell and side.

    A component of up to CELL_ITEMS is one cell. Larger ones are cut by bands of sizes and by hash
    within a band; blocks of one band meet each other and those of the next band.
    """
    cost = F.col("n") + PER_SET
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int"))
    large = rows.groupBy("component").agg(F.sum(cost).alias("w")).where(F.col("w") > CELL_ITEMS).select("component")
    large = materialize(large, "large")
    few = large.count() <= BROADCAST_COMPONENTS
    blocks = rows.join(F.broadcast(large) if few else large, "component", "left_semi").groupBy("component", "band").agg(F.ceil(F.sum(cost) / CELL_ITEMS).cast("int").alias("k"))
    blocks = materialize(blocks.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("blocks")), "blocks")
    rows = rows.join(F.broadcast(blocks) if few else blocks, "component", "left")

    def of(band) -> Column:
        return F.coalesce(F.try_element_at("blocks", band), F.lit(0))

    def meet(many, low, high, step: int, side) -> Column:
        """One (cell, side) for each number below many."""
        numbers = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
        band = F.col("band") - (1 if step and side == 1 else 0)
        cell = lambda j: (band * 2 + step).cast("long") * F.lit(1 << 40) + low(j).cast("long") * F.lit(1 << 20) + high(j)
        return F.transform(numbers, lambda j: F.struct(cell(j).alias("cell"), (side(j) if callable(side) else F.lit(side)).cast("int").alias("side")))

    block = F.pmod(F.xxhash64("set"), of(F.col("band"))).cast("int")
    within = meet(of(F.col("band")), lambda j: F.least(block, j), lambda j: F.greatest(block, j), 0, lambda j: block > j)
    above = meet(of(F.col("band") + 1), lambda j: block, lambda j: j, 1, 0)
    below = meet(of(F.col("band") - 1), lambda j: j, lambda j: block, 1, 1)
    one = F.array(F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(0).alias("side")))
    place = F.when(F.col("blocks").isNull(), one).otherwise(F.concat(within, above, below))
    return rows.select("component", "set", "n", "many", F.explode(place).alias("p")).select("component", "set", "n", "many", "p.cell", "p.side")


def _links(classes: DataFrame, whole: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, links): the number of documents of other classes that a class is linked with; classes without any are left out."""
    rows = materialize(classes.select("set", "n", "many").join(whole.withColumnRenamed("v", "set"), "set"), "linked")
    cells = materialize(_cells(rows), "cells")
    items = cells.agg(F.sum("n")).first()[0] or 0
    tasks = partitions_for(items, 2 * CELL_ITEMS, classes.sparkSession.sparkContext.defaultParallelism)
    met = cells.join(sets.withColumnRenamed("id", "set"), "set").select("component", "cell", "side", "set", "many", "items")
    found = met.repartition(tasks, "component", "cell").mapInArrow(bytewords.tidy(_count_links), "set long, links long")
    out = materialize(found.groupBy("set").agg(F.sum("links").alias("links")), "links")
    discard(rows, cells)
    return out


def join(documents: DataFrame, width: int = WIDTH, links: bool = False) -> DataFrame:
    """doc_id, _key, n_shingles, set_id (the class: its smallest key), component (the smallest key).

    With links also n_links, the number of documents (rows) that a document is linked with.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    docs = keyed(documents.select("doc_id", "text")).select("_key", "doc_id", F.col("text").alias("_text"))
    texts = docs.select("_key", "_text")
    seen = texts.select("_text").mapInArrow(bytewords.tidy(_frequent(width)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    total = docs.count()
    top = seen.where(F.col("n") >= max(SHORT_LIST, total // RARE)).toPandas()
    shingles = top["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    rank = np.empty(len(top), np.uint64)
    rank[np.lexsort((shingles, top["n"].to_numpy(np.int64)))] = np.arange(len(top), dtype=np.uint64)
    if not len(top):
        shingles, rank, order = np.array([2**64 - 1], np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int64)
    frequent = sc.broadcast((shingles[order], rank[order]))
    base = materialize(texts.mapInArrow(bytewords.tidy(_signatures(frequent, width)), "_key long, n long, h1 long, h2 long, bitmap binary, prefix array<long>"), "signatures")
    classes = base.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("_key", "n", "bitmap", "prefix")).alias("s"), F.count(F.lit(1)).alias("many"))
    classes = materialize(classes.select("h1", "h2", F.col("s._key").alias("set"), "s.n", "s.bitmap", "s.prefix", "many"), "classes")
    postings = classes.select("set", "n", F.posexplode("prefix").alias("at", "shingle"))
    count = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    tasks = partitions_for(count, POSTINGS_PER_TASK, sc.defaultParallelism)
    found = materialize(postings.repartition(tasks, "shingle").mapInArrow(bytewords.tidy(_first_pairs), _OUT_SCHEMA), "postings")
    pairs = _possible(found.where("kind = 0").select("a", "b"), classes)
    met = pairs.count()
    long = found.where("kind = 1").select("shingle", F.col("a").alias("set"), F.col("b").alias("n"), "at", F.pmod(F.xxhash64("shingle"), F.lit(tasks)).alias("task"))
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("_key")).union(long.select("set")).distinct(), "wanted")
    chosen = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "_key", "left_semi")
    sets = materialize(chosen.mapInArrow(bytewords.tidy(_full_sets(width)), "id long, items array<long>"), "sets")
    whole = components(_linked(pairs, sets, met), met)
    apart = long.join(whole.withColumnRenamed("v", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    # A set's bitmap goes once to each task that has it in a list, not with each place in a list.
    bits = long.select("set", "task").distinct().join(classes.select("set", "n", "bitmap"), "set")
    rows = apart.withColumn("bitmap", F.lit(None).cast("binary")).unionByName(bits, allowMissingColumns=True)
    rows = rows.select("task", "shingle", "set", "n", "at", "component", "bitmap")
    more = materialize(rows.repartition(tasks, "task").mapInArrow(bytewords.tidy(_later_pairs), "a long, b long").distinct(), "pairs")
    again = more.count()
    edges = whole.select(F.col("v").alias("a"), F.col("component").alias("b")).union(_linked(more, sets, again))
    whole = components(edges, 2 * met + again)
    answers = _links(classes, whole, sets) if links else None
    discard(found, pairs, wanted, sets, more)
    members = base.select("_key", "n", "h1", "h2").join(classes.select("h1", "h2", "set", "many"), ["h1", "h2"], "left")
    members = members.join(whole, F.col("set") == F.col("v"), "left")
    columns = ["_key", F.col("n").alias("n_shingles"), F.coalesce("set", "_key").alias("set_id"), F.coalesce("component", "set", "_key").alias("component")]
    if links:
        members = members.join(answers, "set", "left")
        columns.append((F.coalesce("many", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return members.select(*columns).join(docs.select("_key", "doc_id"), "_key")


def with_component_id(joined: DataFrame) -> DataFrame:
    """component_id: the smallest doc_id of the component that is not null."""
    ids = joined.groupBy("component").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ids = materialize(ids, "components")  # so that the join with a very large component can be split
    return joined.join(ids, "component", "left").withColumn("component_id", F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_least"))).drop("_least", "_n")


def representatives(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are the first of their component by (doc_id nulls first, text)."""
    docs = keyed(packed(documents))
    gone = join(docs.select(F.col("_key").alias("doc_id"), "text")).where("_key != component").select("_key")
    return docs.join(materialize(gone, "gone"), "_key", "left_anti").select("_row.*")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_component_id(join(read_table(spark, sf_dir, "documents"), links=True))
    return out.select("doc_id", "n_shingles", "component_id", "set_id", "n_links")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM d
), e AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(v, r) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a
), component AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
), same AS (
  SELECT s.doc_id, least(s.doc_id, min(b)) AS set_id FROM s LEFT JOIN links ON a = s.doc_id AND na = nb AND c = na GROUP BY s.doc_id
), partners AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, coalesce(set_id, s.doc_id) AS set_id, coalesce(n_links, 0) AS n_links
FROM s JOIN component ON v = s.doc_id JOIN same ON same.doc_id = s.doc_id LEFT JOIN partners ON partners.a = s.doc_id
"""
