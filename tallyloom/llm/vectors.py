"""Integer components of embeddings, as the operators over vectors share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer steps of one unit of a component.
STEPS = 256
#: Components are held within these bounds, so that squared distances of 64 components fit in a long.
MOST = 1 << 27


def whole(vector: Column) -> Column:
    """True if a vector is there and none of its components is null, NaN or infinite."""
    c = vector.cast("array<double>")
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(vector: Column, steps: int = STEPS) -> Column:
    """floor(steps * x) of each component, as longs within [-MOST, MOST]."""
    held = lambda x: F.least(F.greatest(x * F.lit(float(steps)), F.lit(float(-MOST))), F.lit(float(MOST)))
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(held(x)).cast("long"))


def usable(embeddings: DataFrame, dims: int | None = None) -> DataFrame:
    """vec_id and x, the integer components, of rows whose vector is whole and not empty (of `dims` components, if given)."""
    rows = embeddings.select("vec_id", "embedding").where(whole(F.col("embedding")))
    rows = rows.where(F.size("embedding") == dims if dims else F.size("embedding") > 0)
    return rows.select("vec_id", integers(F.col("embedding")).alias("x"))
