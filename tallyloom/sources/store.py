"""Records as stored state: a table of Parquet files in buckets of their key, where a change rewrites only the buckets it touches.

A row's bucket is a hash of its key, so lookups and changes by key open only the folders of their
buckets (partition pruning), and what a change writes grows with the buckets it touches, not with the
table. A change is worked out into a scratch table first and then put in place of the old buckets by
Spark's dynamic partition overwrite, whose commit moves finished folders: a lost executor or a failed
job leaves the old rows. Which buckets a change touches is at most one number for each bucket on the
driver. One writer at a time; readers open files anew with read().
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.scratch import drop, written

BUCKET = "_bucket"


@dataclass(frozen=True)
class Store:
    """A stored table: where it is, its columns, the unique key, and into how many buckets it is cut."""

    path: str
    schema: T.StructType
    key: str
    buckets: int

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _files(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows as they are now."""
        return self._files(spark).select(*self.schema.names)

    def lookup(self, spark: SparkSession, key) -> DataFrame:
        """The row of a key: one bucket is opened."""
        bucket = spark.range(1).select(self.bucket_of(F.lit(key))).first()[0]
        return self._files(spark).where((F.col(BUCKET) == bucket) & (F.col(self.key) == F.lit(key))).select(*self.schema.names)

    def among(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is in the first column of keys: only their buckets are opened."""
        spark = keys.sparkSession
        asked = keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        touched = self._touched(asked.withColumn(BUCKET, self.bucket_of(F.col(self.key))))
        return self._files(spark).where(F.col(BUCKET).isin(touched)).join(asked, self.key, "left_semi").select(*self.schema.names)

    def _replace(self, rows: DataFrame) -> None:
        """rows, with their buckets, take the place of all rows of those buckets."""
        held = written(rows.select(*self.schema.names, BUCKET))
        writer = held.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(self.path)
        drop(held)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most one row for each bucket

    def upsert(self, changes: DataFrame, order: str | None = None) -> int:
        """Puts each changed row in place of the row of its key, or adds it; of changes to one key the greatest by `order` (or any). Returns how many buckets were written.

        changes: the table's columns and, if it isn't one of them, the order's. Rows without a key are an error.
        """
        spark, names = changes.sparkSession, self.schema.names
        if changes.where(F.col(self.key).isNull()).limit(1).count():
            raise ValueError(f"changes without {self.key}")
        rank = F.struct(*([order] if order else []), *names)
        last = changes.groupBy(self.key).agg(F.max_by(F.struct(*names), rank).alias("_row")).select("_row.*")
        last = written(last.withColumn(BUCKET, self.bucket_of(F.col(self.key))))
        touched = self._touched(last)
        if touched:
            old = self._files(spark).where(F.col(BUCKET).isin(touched))
            self._replace(old.join(last.select(self.key), self.key, "left_anti").select(*names, BUCKET).unionByName(last))
        drop(last)
        return len(touched)

    def update(self, spark: SparkSession, where: Column, changes: Mapping[str, Column], keys: DataFrame | None = None) -> int:
        """Sets columns of the rows that fit, of those in `keys` if given; returns how many fit. Buckets without such a row aren't written.

        keys: a column of keys; only their buckets are opened at all.
        """
        rows, fits = self._files(spark), F.coalesce(where, F.lit(False))
        if keys is not None:
            asked = keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
            asked = written(asked.withColumn(BUCKET, self.bucket_of(F.col(self.key))))
            rows = rows.where(F.col(BUCKET).isin(self._touched(asked)))
            rows = rows.join(asked.select(self.key, F.lit(True).alias("_asked")), self.key, "left")
            fits = fits & F.coalesce("_asked", F.lit(False))
        counts = rows.groupBy(BUCKET).agg(F.count_if(fits).alias("n")).where("n > 0").collect()  # at most one row for each bucket
        if counts:
            held = rows.where(F.col(BUCKET).isin([r[BUCKET] for r in counts])).withColumn("_fits", fits)
            kinds = {f.name: f.dataType for f in self.schema.fields}
            # All right-hand sides see the row as it was.
            changed = [F.when(F.col("_fits"), changes[n].cast(kinds[n])).otherwise(F.col(n)).alias(n) if n in changes else F.col(n) for n in self.schema.names]
            self._replace(held.select(*changed, BUCKET))
        if keys is not None:
            drop(asked)
        return sum(r.n for r in counts)


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> Store:
    """A new store of rows, whose key is unique and not null."""
    store = Store(path, rows.schema, key, buckets)
    rows.withColumn(BUCKET, store.bucket_of(F.col(key))).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
    return store
