"""Connected components by large-star and small-star rounds; links stay in written tables, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import discard, materialize


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edges: long a, b in any direction, repeats allowed; at most `most` of them, if given. Returns (v, component) for every vertex of an edge.

    component is the smallest vertex that can be reached. A round costs two aggregations and two
    joins over edges between different vertices; rounds grow with the logarithm of the longest
    path. A vertex with very many edges is summed map-side and its join can be split.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges", most)
    now = before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # A round puts out two edges at most for each of the last one's.
        last, e = e, materialize(small, "edges", 2 * now.n if now else most and 2 * most)
        discard(last)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v").alias("component")).distinct())
