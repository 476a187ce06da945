"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame functions only.

Texts are lower-cased words; shingles are `WIDTH` words. A window has as many shingles as an item
and may start at any shingle, wherever the shared shingles stand in the item: the similarity takes
no account of order. With o shingles in common, a window of w and an item of n have similarity
o / (w + n - o), so one that reaches s has o >= s (w + n) / (1 + s). Windows in which fewer
positions hold a shingle of some item of that size can't reach s and aren't formed; all others are.
Window and item fingerprints (64 bits, the majority of their shingles' hashes) meet by multi-index
Hamming blocks: both are cut into RADIUS + 1 blocks, and two fingerprints within RADIUS agree in at
least one of them. Candidates are then held to their exact similarity: the weighted Jaccard index,
each shingle weighing as often as it occurs.

At similarity 0.8 the shingle vectors' angle is at most 27 degrees: about 10 bits of 64 differ,
with a standard deviation below 3. RADIUS is more than four of those beyond. Against the shortest items
the angle can be wider: a text of 4 shingles of an item's 5 differs in 12 bits on average, and is
beyond RADIUS in 3.4 of 10,000 cases (reckoned from the binomial distribution).

The benchmark's shingles are broadcast in slices of at most SLICE_SHINGLES (48 bytes each); each
slice takes one scan of the documents.

Defined results
  null or empty text         no shingle: never contaminated, never a benchmark
  fewer than WIDTH words     the whole sequence is the one shingle
  text shorter than an item  its one window is the whole text
  null doc_id or item_id     kept: rows are told apart by keys of their own (see common.keyed)
  repeated rows              each gives its own result row
  equal windows' scores      the earliest start is reported
  empty tables               no rows
  extra columns              ignored by search(); stages pass the columns of documents through
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import keyed, let, materialize, packed, partitions_for, read_table, words_of

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 23
SLICE_SHINGLES = 1_000_000


def shingles(text: Column) -> Column:
    """Array of the text's shingle hashes, in order. The words are bound once, wherever the optimizer moves the expression."""

    def rolled(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH))))
        return F.when(F.size(w) >= WIDTH, each).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(words_of(F.lower(text)), rolled)


def fingerprint(hashes: Column) -> Column:
    """SimHash: bit b is set if more than half of the hashes have it."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda x, b: x.bitwiseOR(bit(b)))


def blocks(code: Column) -> Column:
    """(block, value) of each of the RADIUS + 1 blocks of a fingerprint."""
    many = RADIUS + 1
    cuts = [64 * i // many for i in range(many + 1)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays with repeats: the sum of lesser counts over the sum of greater ones."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return shared / (F.size(a) + F.size(b) - shared)


def window_starts(hits: Column, m: Column, n: Column, similarity: float) -> Column:
    """Ascending starts of all windows of n of m shingles that hold enough of `hits` (ascending positions) to reach `similarity`."""
    w = F.least(m, n)
    need = F.greatest(F.lit(1), F.ceil(similarity / (1 + similarity) * (w + n) - 1e-9).cast("int"))

    def after(a: Column, i: Column) -> Column:
        """Starts after hit i - 1 and not after hit i, from which hits i to i + need - 1 are reached."""
        low = F.greatest(F.lit(0), F.coalesce(F.get(a, i - 1) + 1, F.lit(0)), F.get(a, i + need - 1) - w + 1)
        high = F.least(F.get(a, i), m - w)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    every = lambda a: F.flatten(F.transform(F.sequence(F.lit(0), F.size(a) - need), lambda i: after(a, i)))
    return F.when(F.size(hits) >= need, let(hits, every)).otherwise(F.array().cast("array<int>"))


def search(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """_key, doc_id, item_id, start (in shingles), similarity, hamming: the best window of each document and item that reach `similarity`."""
    docs = keyed(documents.select("doc_id", "text"))
    items = keyed(benchmark.select("item_id", "text"), order="item_id", key="_item")
    items = materialize(items.select("_item", "item_id", shingles(F.col("text")).alias("_whole")), "items").where(F.size("_whole") > 0)
    size = items.agg(F.sum(F.size("_whole"))).first()[0] or 0
    slices = partitions_for(size, SLICE_SHINGLES, 1)
    known = items.withColumn("_code", fingerprint(F.col("_whole"))).withColumn("_n", F.size("_whole"))
    texts = docs.select("_key", shingles(F.col("text")).alias("_shingles"))
    texts = texts.select("_key", F.size("_shingles").alias("_m"), F.posexplode("_shingles").alias("_at", "_shingle"))
    found = None
    for i in range(slices):
        part = known.where(F.pmod(F.xxhash64("_item"), F.lit(slices)) == i)
        shared = part.select("_n", F.explode("_whole").alias("_shingle")).distinct()
        hits = texts.join(F.broadcast(shared), "_shingle").groupBy("_key", "_m", "_n").agg(F.array_sort(F.collect_list("_at")).alias("_hits"))
        starts = hits.select("_key", "_n", window_starts(F.col("_hits"), F.col("_m"), F.col("_n"), similarity).alias("_starts"))
        # Written, so that the planner knows how few texts are left to be cut into windows.
        starts = materialize(starts.where(F.size("_starts") > 0), "starts")
        windows = docs.select("_key", "text").join(starts, "_key").select("_key", "_n", "_starts", shingles(F.col("text")).alias("_shingles"))
        windows = windows.select("_key", "_n", "_shingles", F.explode("_starts").alias("start"))
        windows = windows.select("_key", "_n", "start", F.slice("_shingles", F.col("start") + 1, F.col("_n")).alias("_window"))
        windows = windows.withColumn("_print", let(F.col("_window"), fingerprint))
        near = windows.select("*", F.inline(blocks(F.col("_print")))).join(F.broadcast(part.select("_item", "_n", "_code", F.inline(blocks(F.col("_code"))))), ["_n", "block", "value"])
        near = near.withColumn("hamming", F.bit_count(F.col("_print").bitwiseXOR(F.col("_code")))).where(F.col("hamming") <= RADIUS)
        near = near.dropDuplicates(["_key", "start", "_item"]).join(F.broadcast(part.select("_item", "item_id", "_whole")), "_item")
        scored = near.withColumn("similarity", weighted_jaccard(F.col("_window"), F.col("_whole"))).where(F.col("similarity") >= similarity)
        best = scored.groupBy("_key", "_item", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"), F.col("hamming"))).alias("b"))
        best = best.select("_key", "item_id", (-F.col("b.s")).alias("start"), "b.similarity", "b.hamming")
        found = best if found is None else found.unionByName(best)
    return found.join(docs.select("_key", "doc_id"), "_key")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no item is found."""
    docs = keyed(packed(documents))
    dirty = search(docs.select(F.col("_key").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(materialize(dirty, "dirty"), "_key", "left_anti").select("_row.*")


def op8_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "start", "similarity", "hamming")
