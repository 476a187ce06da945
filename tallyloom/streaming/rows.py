"""Live lists of rows: readers with parameters of their own, told only what changes.

Two streams feed one query: changed records, and readers' parameters. Records are kept in a bucketed
store (sources.store), parameters in a small table with one row for each reader. A batch

1. looks up the old rows of the records it changes, in the buckets of their keys alone;
2. tells every reader whose parameters stay which of these rows come into its list, change there, or
   leave it: old and new rows are tested against each reader's parameters, so a batch costs its own rows;
3. tells a reader whose parameters are new its whole list, from the store;
4. puts the records into the store.

A reader's list is what its `put` and `remove` rows add up to since the last `reset`. A batch that is run
again after a failure tells the same and ends in the same store and parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.sources.scratch import drop, finished, shared_folder, written
from tallyloom.sources.store import Store

#: A reader's parameters; blank or null ones don't restrict. `active` false: the reader has left.
PARAMETERS = "reader string, name string, payment_status string, upload_status string, active boolean, version long"
#: Readers, at most, whose parameters are broadcast to a batch's rows.
READERS = 10_000


def fits(name: Column, payment_status: Column, upload_status: Column) -> Column:
    """Whether the record of a row fits a reader's parameters: a part of the name without case, and statuses."""
    free = lambda p: F.trim(F.coalesce(p, F.lit(""))) == ""
    tests = (
        free(name) | F.contains(F.lower(F.col("farmer_name")), F.lower(name)),
        free(payment_status) | F.col("payment_status").eqNullSafe(payment_status),
        free(upload_status) | F.col("upload_status").eqNullSafe(upload_status),
    )
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _readers(parameters: DataFrame) -> DataFrame:
    """The last parameters of each reader, under names of their own."""
    last = parameters.groupBy("reader").agg(F.max_by(F.struct("name", "payment_status", "upload_status", "active"), "version").alias("p"))
    return last.where("p.active").select("reader", F.col("p.name").alias("_name"), F.col("p.payment_status").alias("_payment"), F.col("p.upload_status").alias("_upload"))


def changes(old: DataFrame, new: DataFrame, readers: DataFrame, key: str) -> DataFrame:
    """(reader, change, row): `put` for rows that now fit a reader's parameters, `remove` for those that did and don't. Rows that stay as they are aren't told.

    readers: at most READERS rows; they are tested against a batch's rows, not against the table.
    """
    if readers.limit(READERS + 1).count() > READERS:
        raise ValueError(f"more than {READERS} readers: start another query for them")
    parameters = (F.col("_name"), F.col("_payment"), F.col("_upload"))
    met = lambda rows: rows.join(F.broadcast(readers), fits(*parameters)).select("reader", F.col(key).alias("_key"), F.struct(*rows.columns).alias("row"))
    before, now = met(old).withColumnRenamed("row", "_old"), met(new).withColumnRenamed("row", "_new")
    both = before.join(now, ["reader", "_key"], "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select("reader", F.when(F.col("_new").isNull(), "remove").otherwise("put").alias("change"), F.coalesce("_new", "_old").alias("row"))


def apply(store: Store, known: DataFrame, records: DataFrame, parameters: DataFrame, order: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One batch: (what readers are told, all parameters after it). The store is changed.

    path: where what the batch's records change is written, before the store is: run again, the batch
    tells the same, though the store has the records already.
    """
    spark = records.sparkSession
    path = path or shared_folder(spark, "told")
    last = records.groupBy(store.key).agg(F.max_by(F.struct(*store.schema.names), order).alias("_row")).select("_row.*")
    last = written(last)
    renewed = parameters.select("reader").distinct()
    if not finished(spark, path):
        old = store.among(last.select(store.key))
        changes(old, last, _readers(known).join(renewed, "reader", "left_anti"), store.key).write.mode("overwrite").parquet(path)
    told = spark.read.schema(f"reader string, change string, row {store.schema.simpleString()}").parquet(path)
    store.upsert(last)
    drop(last)
    after = known.unionByName(parameters)
    if not parameters.isEmpty():
        now = store.read(spark)
        whole = changes(now.limit(0), now, _readers(after).join(renewed, "reader", "left_semi"), store.key)
        reset = renewed.select("reader", F.lit("reset").alias("change"), F.lit(None).cast(store.schema).alias("row"))
        told = told.unionByName(reset).unionByName(whole)
    return told, after


def follow(
    spark: SparkSession, records: DataFrame, parameters: DataFrame, store: Store, order: str, emit: Callable[[DataFrame, int], None], folder: str,
) -> StreamingQuery:
    """Runs apply() for each batch of both streams and hands what readers are told to emit: (reader, change, row), change one of reset, put and remove.

    records: a stream with the store's columns; order: the column that tells later changes of a key from
    earlier ones. parameters: a stream of PARAMETERS. folder: a shared folder for the parameters and the checkpoint.
    """
    both = records.select(F.struct(*store.schema.names).alias("r"), F.lit(None).cast(f"struct<{PARAMETERS.replace(' ', ':').replace(',:', ',')}>").alias("p"))
    both = both.unionByName(parameters.select(F.lit(None).cast(store.schema).alias("r"), F.struct(*(c.split()[0] for c in PARAMETERS.split(", "))).alias("p")))

    def step(batch: DataFrame, number: int) -> None:
        held = written(batch)
        before = f"{folder}/parameters/{number - 1}"
        known = spark.read.schema(PARAMETERS).parquet(before) if number else spark.createDataFrame([], PARAMETERS)
        told, after = apply(store, known, held.where("r IS NOT NULL").select("r.*"), held.where("p IS NOT NULL").select("p.*"), order, f"{folder}/told/{number}")
        # One row for each reader is kept.
        kept = after.groupBy("reader").agg(F.max_by(F.struct("name", "payment_status", "upload_status", "active", "version"), "version").alias("p"))
        kept.select("reader", "p.*").write.mode("overwrite").parquet(f"{folder}/parameters/{number}")
        emit(told, number)
        drop(held)

    return both.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").start()
