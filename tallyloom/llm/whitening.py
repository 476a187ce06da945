"""Whitening of embeddings: covariance from upper-triangle column aggregates, decomposed by LAPACK.

The fit list is each distinct integer vector once (a written table; copies are combined before they
are shuffled, so one vector that a third of all rows hold costs one row for each task). One
aggregation over it gives n, sums and ranges of every dimension. The next one sums, by generated SQL
expressions, the products of every pair of dimensions i <= j, each component less its dimension's
centre: the rows of the triangle are groups and its columns the expressions, one for each j. (One
expression for each of the 2080 pairs of 64 dimensions, without groups, is more than Spark compiles:
it took 13 times as long.) Exploded rows are summed within their task, and a task sends on one row for
each dimension. Centres are the means rounded to integers, and the sums are exact longs, so the result
doesn't hang on the order of rows; what the rounding of centres leaves is taken off exactly on the
driver, which holds dims * dims numbers and no rows. LAPACK (numpy.linalg.eigh) decomposes the
covariance. Where the ranges show that a long might not hold a sum, products are summed as doubles
from the unrounded means.

Defined results: rows whose vector is null, empty, or holds null, NaN or infinite entries leave. A
table's dimension is the commonest length of its vectors (of equally common ones the larger); others
leave too. Entries are held within 2**27 steps of zero. Null ids stay, and repeated rows each give
their own result. A component without variance has null `whitened` and 0 `explained`; the others'
signs make their largest coefficient positive. Without usable rows the result is empty. `deviation` is
null where a long can't hold it; with `wide=True` it is a decimal. Columns beside vec_id and embedding
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import discard, materialize, read_table
from tallyloom.llm.vectors import usable

#: Components that a row gets.
COMPONENTS = 4
#: Columns of products in one aggregation: as many as Spark still compiles into one loop.
COLUMNS = 64
#: Share of the trace below which a component counts as without variance.
FLAT = 1e-12
SCHEMA = "vec_id {id}, component int, n long, deviation {deviation}, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Fit:
    """n and sums of the distinct vectors, their covariance, its eigenvalues by falling size and unit eigenvectors as columns.

    reach: the largest of all |n * x - S|.
    """

    n: int
    sums: tuple[int, ...]
    reach: int
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def projections(self, k: int) -> list[np.ndarray | None]:
        """For each of the first k components the coefficients that whiten a centred vector; None without variance."""
        least = FLAT * max(float(np.trace(self.covariance)), 0.0)
        return [self.vectors[:, c] / np.sqrt(self.values[c]) if self.values[c] > least else None for c in range(min(k, len(self.values)))]


def _columns(rows: DataFrame, dims: int) -> DataFrame:
    return rows.select(*(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(dims)))


def _covariance(columns: DataFrame, n: int, sums: list[int], low: list[int], high: list[int]) -> np.ndarray:
    """Sums of centred products of every pair i <= j as generated SQL, divided by n."""
    dims = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    reach = max(max(h - c, c - lo) for lo, h, c in zip(low, high, centre, strict=True))
    fits = reach * reach * n < 2**62
    centred = columns.selectExpr(*(f"x{i} - ({centre[i]}L) AS c{i}" if fits else f"x{i} - ({sums[i] / n!r}D) AS c{i}" for i in range(dims)))
    rows = centred.selectExpr("*", f"posexplode(array({', '.join(f'c{i}' for i in range(dims))})) AS (i, c)")
    out = np.zeros((dims, dims))
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    for at in range(0, dims, COLUMNS):
        block = range(at, min(at + COLUMNS, dims))
        products = [F.expr(f"sum(IF(i <= {j}, c * c{j}, {'0L' if fits else '0D'}))").alias(f"p{j}") for j in block]
        for r in rows.where(f"i <= {block[-1]}").groupBy("i").agg(*products).collect():
            for j in range(max(r.i, at), block[-1] + 1):
                p = r[f"p{j}"]
                out[r.i, j] = out[j, r.i] = float(Fraction(n * p - left[r.i] * left[j], n * n)) if fits else p / n
    return out


def fit(distinct: DataFrame, dims: int) -> Fit | None:
    """distinct: x, each vector once, of `dims` components. None without rows."""
    columns = _columns(distinct, dims)
    each = lambda f: [f(f"x{i}") for i in range(dims)]
    row = columns.agg(F.count(F.lit(1)), *each(lambda c: F.sum(F.col(c).cast("decimal(20,0)"))), *each(F.min), *each(F.max)).first()
    n = row[0]
    if not n:
        return None
    sums, low, high = ([int(v) for v in row[1 + k * dims : 1 + (k + 1) * dims]] for k in range(3))
    covariance = _covariance(columns, n, sums, low, high)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)])
    reach = max(max(n * h - s, s - n * lo) for s, lo, h in zip(sums, low, high, strict=True))
    return Fit(n, tuple(sums), reach, covariance, values, vectors * signs)


def _whitened(f: Fit, coefficients: np.ndarray) -> str:
    """SQL of one whitened component from the columns x0, x1, ..."""
    return " + ".join(f"(x{i} - {s / f.n!r}D) * {float(w)!r}D" for i, (s, w) in enumerate(zip(f.sums, coefficients, strict=True)))


def _identity_error(columns: DataFrame, f: Fit, projections: list) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, measured over the rows."""
    made = [w for w in projections if w is not None]
    if not made:
        return 0.0
    rows = columns.selectExpr(*(f"{_whitened(f, w)} AS w{k}" for k, w in enumerate(made)))
    pairs = [(a, b) for a in range(len(made)) for b in range(a, len(made))]
    found = rows.agg(*(F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs)).first()
    return max(abs(v - (a == b)) for (a, b), v in zip(pairs, found, strict=True))


def _deviation(f: Fit, wide: bool) -> str:
    """SQL of the exact sum of (n * x - S) ** 2 in the narrowest type that holds it; null where none does."""
    kind, most = "DECIMAL(38,0)" if wide else "BIGINT", len(f.sums) * f.reach**2
    apart = [f"({f.n}L * x{i} - ({s}L))" for i, s in enumerate(f.sums)] if f.reach < 2**62 else []
    if most < 2**63:
        return f"CAST({' + '.join(f'{d} * {d}' for d in apart)} AS {kind})"
    if f.reach < 10**18 and most < 10**38:
        tens = [f"CAST({d} AS DECIMAL(19,0))" for d in apart]
        return f"try_cast({' + '.join(f'{d} * {d}' for d in tens)} AS {kind})"
    return f"CAST(NULL AS {kind})"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, wide: bool = False) -> DataFrame:
    """A row for each usable vector and each of the first `components` principal components. wide: deviation as decimal(38,0), for tables whose long is too small."""
    rows = usable(embeddings)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        schema = SCHEMA.format(id=embeddings.schema["vec_id"].dataType.simpleString(), deviation="decimal(38,0)" if wide else "long")
        return embeddings.sparkSession.createDataFrame([], schema)
    dims = lengths["d"]
    rows = rows.where(F.size("x") == dims)
    distinct = materialize(rows.select("x").distinct(), "vectors")
    f = fit(distinct, dims)
    projections = f.projections(components)
    error, trace = _identity_error(_columns(distinct, dims), f, projections), float(np.trace(f.covariance))
    discard(distinct)
    one = "named_struct('component', {k}, 'whitened', {w}, 'explained', {e!r}D)"
    each = [one.format(k=k + 1, w="CAST(NULL AS DOUBLE)" if w is None else _whitened(f, w), e=0.0 if w is None else float(f.values[k]) / trace) for k, w in enumerate(projections)]
    wide_rows = rows.select("vec_id", *(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(dims)))
    made = wide_rows.selectExpr("vec_id", f"{f.n}L AS n", f"{_deviation(f, wide)} AS deviation", f"array({', '.join(each)}) AS _each")
    return made.select("vec_id", F.inline("_each"), "n", "deviation").select("vec_id", "component", "n", "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
