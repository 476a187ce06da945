"""Best-fit packing of documents' token ids after Martello-Toth dominance reduction.

A document's ids end with an end id; only a document longer than a sequence is cut, its first
piece being the shorter one. Pieces of one length are alike, so the instance is a histogram of at
most `capacity` lengths, whatever the corpus holds. The driver solves that: sets {k, j} that
provably dominate every other set with k are fixed and leave the instance; the rest goes, longest
first, where it fits best. Every piece then finds its place by its rank among those of its length.

Defined results
  null or empty text  one piece that holds the end id alone
  null or repeated doc_id, repeated rows  each row is a document of its own (see common.keyed)
  ties                pieces of one length rank by (part, key, piece): the packing is deterministic
  empty table         no rows
  extra columns       ignored
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import bytewords
from tallyloom.llm.common import keyed, materialize, partitions_for, read_table
from tallyloom.llm.tokens import default_vocabulary, encoder

CAPACITY = 1024
END = 2
#: Pieces that are ranked in one window at most, on average.
RANKED_TOGETHER = 200_000
TEXTS = 1024


@dataclass
class Bins:
    """`count` sequences alike: (length, how many) in order, and what room each has left."""

    items: list[tuple[int, int]]
    count: int
    room: int


def _best_pair(sizes: list[int], have: dict[int, int], most: int) -> int:
    """The largest sum of two pieces, at most `most`; 0 if none."""
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        s = sizes[i] + sizes[j]
        if s > most or (i == j and have[sizes[i]] < 2):
            j -= 1
        else:
            best = max(best, s)
            i += 1
    return best


def _partner(k: int, have: dict[int, int], capacity: int) -> int | None:
    """j if {k, j} dominates every feasible set with k (0: k alone does); None if none is known to.

    A set dominates another with k if its other piece is at least as long as all that could stand
    in its place together. So the longest j that fits dominates when it fills the sequence, when no
    two pieces fit beside k, or when at most two fit and no pair of them is longer than j.
    """
    rest = {s: n - (s == k) for s, n in have.items() if n - (s == k) > 0}
    room = capacity - k
    if rest.get(room):
        return room
    sizes = sorted(rest)
    at = bisect_left(sizes, room + 1) - 1
    if at < 0:
        return 0
    j = sizes[at]
    least = [s for s in sizes[:3] for _ in range(min(3, rest[s]))][:3]
    if len(least) < 2 or sum(least[:2]) > room:
        return j
    if (len(least) < 3 or sum(least) > room) and _best_pair(sizes[: at + 1], rest, room) <= j:
        return j
    return None


def reduce(have: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Bins], dict[int, int]]:
    """Fixed sequences and the instance that is left, applying dominance until it finds nothing more."""
    have, fixed, moved = {s: n for s, n in have.items() if n}, [], True
    while moved:
        moved = False
        for k in sorted(have, reverse=True):
            while have.get(k) and (j := _partner(k, have, capacity)) is not None:
                if j == 0:
                    many, items = have[k], [(k, 1)]
                elif j == k:
                    many, items = have[k] // 2, [(k, 2)]
                else:
                    # As sets leave, nothing new fits beside k: while a j is left, it goes on dominating.
                    many, items = min(have[k], have[j]), [(k, 1), (j, 1)]
                fixed.append(Bins(items, many, capacity - sum(s * n for s, n in items)))
                for s, n in items:
                    have[s] -= n * many
                    if not have[s]:
                        del have[s]
                moved = True
    return fixed, have


def best_fit(have: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Best-fit decreasing over counts: a sequence that takes a piece stays the tightest for the next one alike."""
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def add(b: Bins) -> None:
        if b.count:
            if not by_room.setdefault(b.room, []):
                insort(rooms, b.room)
            by_room[b.room].append(b)

    for s in sorted(have, reverse=True):
        left = have[s]
        while left:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                b = Bins([], left, capacity)  # as many new ones as could be needed
            else:
                b = by_room[rooms[at]].pop()
                if not by_room[b.room]:
                    rooms.pop(at)
            fit = b.room // s
            full = min(b.count, left // fit)
            used = full
            add(Bins([*b.items, (s, fit)], full, b.room - fit * s))
            left -= full * fit
            if left and used < b.count and left < fit:
                add(Bins([*b.items, (s, left)], 1, b.room - left * s))
                used, left = used + 1, 0
            if b.items:
                add(Bins(b.items, b.count - used, b.room))
    return [b for bs in by_room.values() for b in bs]


def plan(have: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, each, sequence, offset): ranks low..high-1 of a length go `each` to a sequence, from that one on, at that offset."""
    fixed, rest = reduce(have, capacity)
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for b in fixed + best_fit(rest, capacity):
        offset = 0
        for s, each in b.items:
            low = taken.get(s, 0)
            taken[s] = low + each * b.count
            out.append((s, low, taken[s], each, sequence, offset))
            offset += s * each
        sequence += b.count
    return out


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                texts = [t or "" for t in part.column("_text").to_pylist()]
                rows: list[tuple[int, int, int, int, int]] = []
                for n, ids in enumerate(tool.encode(texts)):
                    ids = np.append(ids, np.uint32(end))
                    first = (len(ids) - 1) % capacity + 1
                    at = 0
                    for piece, to in enumerate(range(first, len(ids) + 1, capacity)):
                        rows.append((n, piece, at, to - at, zlib.crc32(ids[at:to])))
                        at = to
                n, piece, start, length, crc = (np.array(c) for c in zip(*rows, strict=True))
                keys = part.column("_key").to_numpy()[n]
                yield pa.record_batch([pa.array(keys), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["_key", "piece", "start", "length", "ids_crc32"])

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = documents.sparkSession
    docs = keyed(documents.select("doc_id", "text"))
    run = _pieces(vocabulary or default_vocabulary(), capacity, end)
    pieces = docs.select("_key", F.col("text").alias("_text")).mapInArrow(bytewords.tidy(run), "_key long, piece int, start long, length long, ids_crc32 long")
    pieces = materialize(pieces, "pieces")
    parts = partitions_for(pieces.count(), RANKED_TOGETHER, 4)
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("_key", "piece"), F.lit(parts)).cast("int"))
    tally = materialize(pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")), "tally")
    have = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = tally.select("length", "_part", before.alias("_base"))
    by_length: dict[int, list] = {}
    for s, *cut in plan(have, capacity):
        by_length.setdefault(s, []).append(tuple(cut))
    # A plan has a few cuts for each of at most `capacity` lengths.
    cuts = F.broadcast(spark.createDataFrame(list(by_length.items()), "length long, _cuts array<struct<low:long,high:long,each:long,sequence:long,offset:long>>"))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_key", "piece")) - 1
    ranked = pieces.withColumn("_rank", rank).join(base, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_base")).join(cuts, "length")
    ranked = ranked.withColumn("_cut", F.get(F.filter("_cuts", lambda c: (c["low"] <= F.col("_rank")) & (F.col("_rank") < c["high"])), F.lit(0)))
    place = (F.col("_rank") - F.col("_cut.low")).cast("long")
    out = ranked.select(
        "_key", "piece", "start", "length", "ids_crc32",
        (F.col("_cut.sequence") + F.expr("(_rank - _cut.low) div _cut.each")).alias("sequence_id"),
        (F.col("_cut.offset") + (place % F.col("_cut.each")) * F.col("length")).alias("offset"),
    )
    return docs.select("_key", "doc_id").join(out, "_key").drop("_key")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
