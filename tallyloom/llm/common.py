"""What the corpus operators share: scratch tables in the cluster's shared folder, let-bindings, words and keys."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Most bytes of an Arrow batch.
ARROW_BYTES = str(4 << 20)
#: Rows that the Parquet reader decodes at once; texts of 4096 rows would fill arrays of many MB.
READ_ROWS = "1024"
#: Rows of a few numbers that one task writes.
ROWS_PER_FILE = 250_000
#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only a local session, which has one disk, may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Gives executors this package's code, once for each context (they need not have it on their path), and bounds batches."""
    sc = spark.sparkContext
    if not getattr(sc, "_tallyloom_shipped", False):
        top = Path(__file__).resolve().parents[2]
        if top.is_dir():  # else the code runs from an archive that was shipped already
            base = os.path.join(tempfile.mkdtemp(prefix="tallyloom-"), "tallyloom")
            sc.addPyFile(shutil.make_archive(base, "zip", top, "tallyloom"))
        sc._tallyloom_shipped = True
    # Texts are long: a batch between the JVM and Python is bounded by its bytes, not by its rows alone.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and survives lost executors.

    rows: a bound on the rows of a table of a few numbers each, if known. No more tasks write it than
    that many rows need, so that a small table isn't a file for each partition.
    """
    path = shared_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(partitions_for(rows, ROWS_PER_FILE))).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them stands in written tables itself."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            sc = t.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once for each row, however often body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def partitions_for(rows_or_bytes: int, per_task: int, least: int = 1) -> int:
    return max(least, -(-rows_or_bytes // per_task))


def keyed(docs: DataFrame, order: str = "doc_id", text: str = "text", key: str = "_key") -> DataFrame:
    """docs with a unique long key that follows (order nulls first, text).

    Where `order` is a unique integer without nulls, it is the key itself. Otherwise rows are sorted
    by (order nulls first, text nulls first) and numbered in a written table, so that null or
    repeated ids, ids of other types, and rows that are repeated whole, each get a key of their own.
    """
    ship(docs.sparkSession)
    ranged = docs.orderBy(F.col(order).asc_nulls_first(), F.col(text).asc_nulls_first())
    numbered = ranged.withColumn(key, F.monotonically_increasing_id())
    if not isinstance(docs.schema[order].dataType, IntegralType):
        return materialize(numbered, "keyed")
    clash = docs.groupBy(F.col(order)).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(order).isNull())
    if not clash.limit(1).collect():
        return docs.withColumn(key, F.col(order).cast("long"))
    return materialize(numbered, "keyed")


def packed(docs: DataFrame) -> DataFrame:
    """docs as _row (a struct of all its columns), doc_id and text, so that no column can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "text")
