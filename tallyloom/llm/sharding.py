"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `virtual` points of a ring of 65,536 positions; a key belongs to the next point
clockwise. A full shard takes no more: keys beyond its capacity continue clockwise to the next
point of a shard with room. Capacities are the even shares (counts at most one apart), so balance
is guaranteed, and only keys of overfull shards move away from their own arc.

Which keys overflow is decided by counts alone: within an arc, keys rank by (position hash,
doc_id, checksum). The driver gets one count for each arc (shards x virtual numbers, whatever the
corpus holds), walks the ring once, and hands back rank segments that every row finds by its arc.

Defined results
  null text          size 8, checksum 0 (as for an empty text)
  null doc_id        hashed by its text instead
  repeated rows      each row gets a slot of its own
  equal texts        have no bearing: law `rows` counts rows, whatever they hold
  ties               equal keys share an arc; their order within it doesn't change what they return
  empty table        no rows
  extra columns      ignored
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, read_table

POSITIONS = 65536
#: Parts of an arc that are ranked apart; a window never holds more than its part of an arc.
PARTS = 8


@dataclass(frozen=True)
class Segment:
    """Ranks low..high-1 of an arc go to shard, from slot on; hops counts the points passed."""

    arc: int
    low: int
    high: int
    shard: int
    slot: int
    hops: int


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; of two at one position the lower shard's stays."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for i in range(virtual):
            position = int.from_bytes(hashlib.md5(f"{shard}:{i}".encode()).digest()[:2], "big")
            at[position] = min(shard, at.get(position, shard))
    return sorted(at.items())


def place(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[Segment]:
    """Bounded loads over counts of keys by arc (the index of a point)."""
    n = sum(counts.values())
    room = [n // shards + (1 if s < n % shards else 0) for s in range(shards)]
    filled = [0] * shards
    out: list[Segment] = []
    over: list[tuple[int, int]] = []

    def put(arc: int, low: int, many: int, shard: int, hops: int) -> None:
        out.append(Segment(arc, low, low + many, shard, filled[shard], hops))
        filled[shard] += many
        room[shard] -= many

    for arc, (_, shard) in enumerate(points):
        many = counts.get(arc, 0)
        if own := min(many, room[shard]):
            put(arc, 0, own, shard, 0)
        if many > own:
            over.append((arc, own))
    for arc, low in over:
        left, at, hops = counts[arc] - low, arc, 0
        while left:
            at, hops = (at + 1) % len(points), hops + 1
            shard = points[at][1]
            if hops > len(points):  # a shard whose points all fell on another's: its room comes last
                shard = next(s for s in range(shards) if room[s])
            if take := min(left, room[shard]):
                put(arc, low, take, shard, hops)
                low, left = low + take, left - take
    return out


def shard(docs: DataFrame, shards: int = 24, virtual: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard, hops."""
    spark = docs.sparkSession
    points = ring(shards, virtual)
    bounds = [p for p, _ in points]
    arc_at, arcs = 0, []
    for position in range(POSITIONS):
        while arc_at < len(bounds) and bounds[arc_at] < position:
            arc_at += 1
        arcs.append((position, arc_at % len(points), points[arc_at % len(points)][1]))
    # Bounded by POSITIONS rows of three integers.
    arc_table = F.broadcast(spark.createDataFrame(arcs, "_position int, _arc int, home_shard int"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    rows = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.conv(F.substring(key, 1, 4), 16, 10).cast("int").alias("_position"),
        F.substring(key, 5, 12).alias("_order"),
    )
    rows = materialize(rows.join(arc_table, "_position").withColumn("_part", (F.conv(F.substring("_order", 1, 2), 16, 10).cast("int") * PARTS / 256).cast("int")), "ring")
    tally = rows.groupBy("_arc", "_part").agg(F.count(F.lit(1)).alias("n")).collect()  # at most shards * virtual * PARTS rows
    by_arc: dict[int, int] = {}
    starts = []
    for arc, part, n in sorted(tally):
        starts.append((arc, part, by_arc.get(arc, 0)))
        by_arc[arc] = by_arc.get(arc, 0) + n
    segments = place(points, by_arc, shards)
    base = F.broadcast(spark.createDataFrame(starts, "_arc int, _part int, _base long"))
    cuts: dict[int, list[Segment]] = {}
    for s in segments:
        cuts.setdefault(s.arc, []).append(s)
    packed = [(a, [(s.low, s.high, s.shard, s.slot, s.hops) for s in ss]) for a, ss in cuts.items()]
    found = F.broadcast(spark.createDataFrame(packed, "_arc int, _cuts array<struct<low:long,high:long,shard:int,slot:long,hops:int>>"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_arc", "_part").orderBy("_order", "doc_id", "text_crc32", "size")) - 1)
    ranked = ranked.join(base, ["_arc", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_base")).join(found, "_arc")
    ranked = ranked.withColumn("_cut", F.get(F.filter("_cuts", lambda c: (c["low"] <= F.col("_rank")) & (F.col("_rank") < c["high"])), F.lit(0)))
    return ranked.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_cut.shard").alias("shard"),
        (F.col("_cut.slot") + F.col("_rank") - F.col("_cut.low")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
        F.col("_cut.hops").alias("hops"),
    )


def op4_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"))
