"""Centroid clustering with block-norm screening: exact integer distances only where a bound can't tell.

Vectors of 64 components become integers and are written once, each beside its compressed form: for
each of SEGMENTS segments its sum S and its residual R = w * (squared norm) - S * S, where w is the
segment's width; R / w is the squared norm of what is left of the segment without its mean. The
products of means are exact in the compressed form, and the Cauchy-Schwarz inequality bounds the
products of what is left, segment by segment:

    |x - c|^2 >= |x|^2 + |c|^2 - 2 / w * sum over segments of (S_x * S_c + sqrt(R_x * R_c)).

The exact distance to the centroid of the least bound is a first upper bound of a vector's nearest
distance. Centroids are then screened one after another: only vectors whose bound for it isn't above
the least distance so far get an exact one. Bounds are doubles, lowered by SLACK of the norms, far more
than their rounding, so that no nearest centroid is pruned. Exact distances are integers throughout:
products are summed by BLAS in doubles where every partial sum is below 2**53, else in 64-bit integers.

A round is one pass over the written vectors: a task returns one row for each cluster that it saw
(count, component sums, number of exact distances), and one aggregation adds these
up. Only k rows of 64 sums come to the driver, where a centroid's components become the floor of
sum / count. Nothing is shuffled but those rows, so a vector that a third of all rows hold is no key.

Defined results: rows whose vector is null, has another number of components, or holds null, NaN or
infinite entries leave. Components are held within 2**27 steps of zero. Fewer rows than `k` give as
many centroids as there are rows; the first centroids may be equal, and then the smaller number wins
all ties and the others stay empty, as they are. Rows whose vec_id is null hash as the text "null";
rows with one id are told apart by their components. Repeated rows each get a result. No usable row
gives an empty result. Sums of distances that a long can't hold are null. Columns beside vec_id and
embedding are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import discard, materialize, read_table, ship
from tallyloom.llm.vectors import usable

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SEED = "2"
#: Segments of a vector, of equal width.
SEGMENTS = 32
#: Share of the norms by which a bound is lowered, against rounding.
SLACK = 1e-9
#: Vectors that a task compares at once.
VECTORS = 8192


def compressed(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Sums of each row's segments, then their residuals; exact."""
    parts = x.astype(np.int64).reshape(len(x), segments, -1)
    sums = parts.sum(axis=2)
    return np.hstack([sums, x.shape[1] // segments * (parts * parts).sum(axis=2) - sums * sums])


def lower_bounds(small: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """A bound of the squared distance of every vector (its compressed form and squared norm) to every centroid."""
    segments = small.shape[1] // 2
    own, sizes = compressed(centroids, segments).astype(np.float64), (centroids * centroids).sum(axis=1)
    mine = small.astype(np.float64)
    most = mine[:, :segments] @ own[:, :segments].T + np.sqrt(mine[:, segments:]) @ np.sqrt(own[:, segments:]).T
    total = norms[:, None].astype(np.float64) + sizes[None, :]
    return total - 2.0 * segments / centroids.shape[1] * most - SLACK * (total + 1.0)


def nearest(x: np.ndarray, small: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, the smaller of tied ones; squared distance; exact distances worked out) of each row."""
    wide = x.astype(np.int64)
    norms, sizes = (wide * wide).sum(axis=1), (centroids * centroids).sum(axis=1)
    reach = max(int(np.abs(wide).max(initial=0)), int(np.abs(centroids).max()))
    kind = np.float64 if x.shape[1] * reach * reach < 2**53 else np.int64
    mine, theirs = wide.astype(kind), centroids.astype(kind)
    low = lower_bounds(small, norms, centroids)
    cluster = low.argmin(axis=1)
    first = cluster.copy()
    best = norms + sizes[first] - 2 * np.einsum("ij,ij->i", mine, theirs[first]).astype(np.int64)
    tried = len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero((low[:, c] <= best) & (first != c))
        tried += len(rows)
        found = norms[rows] + sizes[c] - 2 * (mine[rows] @ theirs[c]).astype(np.int64)
        better = (found < best[rows]) | ((found == best[rows]) & (c < cluster[rows]))
        rows = rows[better]
        cluster[rows], best[rows] = c, found[better]
    return cluster, best, tried


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, VECTORS):
            part = batch.slice(at, VECTORS)
            yield part, _matrix(part.column("x")), _matrix(part.column("small"))


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.ravel())


def _compressed(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                yield pa.record_batch([batch.column("vec_id"), _lists(x.astype(np.int32)), _lists(compressed(x, segments))], names=["vec_id", "x", "small"])

    return run


SUMS = "cluster int, n long, sums array<long>, exact long"


def _sums(centroids: np.ndarray):
    """One row for each cluster of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, exact = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), 0
        for _, x, small in _blocks(batches):
            cluster, _, tried = nearest(x, small, centroids)
            order = np.argsort(cluster, kind="stable")
            at, first = np.unique(cluster[order], return_index=True)
            n[at] += np.diff(np.append(first, len(x)))
            sums[at] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
            exact += tried
        seen = np.flatnonzero(n)
        if len(seen):
            spent = [exact] + [0] * (len(seen) - 1)
            rows = [pa.array(seen.astype(np.int32)), pa.array(n[seen]), pa.array(sums[seen].tolist(), pa.list_(pa.int64())), pa.array(spent, pa.int64())]
            yield pa.record_batch(rows, names=["cluster", "n", "sums", "exact"])

    return run


def _labels(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, small in _blocks(batches):
            cluster, distance, _ = nearest(x, small, centroids)
            yield pa.record_batch([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of the smallest sha256 of `<seed>:<vec_id>`; k rows come to the driver."""
    mark = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> list:
    """One row for each non-empty cluster with its number of vectors and their sums: at most k rows."""
    each = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    parts = vectors.mapInArrow(_sums(centroids), SUMS)
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("exact").alias("exact"), F.array(*each).alias("sums")).collect()


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: str = SEED, segments: int = SEGMENTS, counts: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    counts: if given, gets (vectors, exact distances) of each round.
    """
    if dims % segments:
        raise ValueError(f"{dims} components can't be cut into {segments} segments of one width")
    spark = embeddings.sparkSession
    ship(spark)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    raw = usable(embeddings, dims)
    vectors = materialize(raw.mapInArrow(_compressed(segments), f"vec_id {kind}, x array<int>, small array<long>"), "vectors")
    centroids = first_centroids(vectors, k, seed)
    schema = f"vec_id {kind}, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        found = _moved(vectors, centroids)
        if counts is not None:
            counts.append((sum(r.n for r in found), sum(r.exact for r in found)))
        for r in found:
            centroids[r.cluster] = [int(s) // r.n for s in r.sums]
    labels = materialize(vectors.mapInArrow(_labels(centroids), schema), "labels")
    discard(vectors)
    found = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()
    digest = {c: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for c, row in enumerate(centroids.tolist())}
    held = lambda v: int(v) if int(v) < 2**63 else None
    total = sum(int(r.inertia) for r in found)
    # One row for each of at most k clusters.
    about = [(r.cluster, held(r.inertia), held(total), digest[r.cluster]) for r in found]
    facts = F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return labels.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"))
