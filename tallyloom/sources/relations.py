"""Canonical relations over physical tables. Joins a query doesn't need aren't made: ask for the measures only where they are used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.columns import half_up
from tallyloom.sources.scratch import drop, shared_folder, written

#: The fact relation. Times are naive timestamps; money is double.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "org_id", "worker_id", "farmer_id", "farmer_name")]
    + [T.StructField(n, T.DoubleType()) for n in ("quantity", "fat", "snf")]
    + [T.StructField(n, T.StringType()) for n in ("payment_status", "payment_method", "payment_reference")]
    + [T.StructField("payment_timestamp", T.TimestampNTZType()), T.StructField("payable_amount", T.DoubleType()), T.StructField("amount_paid", T.DoubleType())]
    + [T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType()), T.StructField("upload_status", T.StringType())]
)
FARMER = T.StructType([T.StructField("farmer_id", T.StringType()), T.StructField("farmer_name", T.StringType()), T.StructField("normalized_name", T.StringType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("is_active", T.BooleanType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str, measures: bool = True) -> DataFrame:
    """One record for each order; measures: quantity, fat and snf from its lines (else null)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    if measures:
        lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("_q"), half_up(F.avg("l_discount"), 6).alias("_f"), half_up(F.avg("l_tax"), 6).alias("_s"))
        rows = rows.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    else:
        rows = rows.withColumns({n: F.lit(None).cast("double") for n in ("_q", "_f", "_s")})
    status, none = F.col("o_orderstatus"), F.lit(None).cast("string")
    digit = F.substring("o_orderpriority", 1, 1)
    return rows.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("c_nationkey").cast("string").alias("org_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("worker_id"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_custkey").cast("string")).alias("farmer_id"),
        F.col("c_name").alias("farmer_name"),
        F.coalesce("_q", F.lit(0.0)).alias("quantity"), F.col("_f").alias("fat"), F.col("_s").alias("snf"),
        F.when(status == "F", "RECORDED_LOCALLY").when(status == "P", "PAID").otherwise("PENDING").alias("payment_status"),
        F.when(status == "O", none).when(digit == "1", "CASH").when(digit == "2", "UPI").when(digit == "3", "BANK_TRANSFER").otherwise("OTHER").alias("payment_method"),
        F.when(status != "O", F.concat(F.lit("REF-"), F.col("o_orderkey").cast("string"))).alias("payment_reference"),
        F.when(status == "F", F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("payment_timestamp"),
        F.col("o_totalprice").alias("payable_amount"),
        F.when(status == "F", F.col("o_totalprice")).alias("amount_paid"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        F.when(status == "F", "UPLOADED").otherwise("PENDING").alias("upload_status"),
    )


#: The same relation in SQL, for the oracle.
ORDERS_SQL = """rel AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS org_id,
    CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS worker_id,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_custkey AS VARCHAR) END AS farmer_id, c_name AS farmer_name,
    coalesce(q, 0.0) AS quantity, f AS fat, s AS snf,
    CASE o_orderstatus WHEN 'F' THEN 'RECORDED_LOCALLY' WHEN 'P' THEN 'PAID' ELSE 'PENDING' END AS payment_status,
    CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderpriority LIKE '1%' THEN 'CASH' WHEN o_orderpriority LIKE '2%' THEN 'UPI'
         WHEN o_orderpriority LIKE '3%' THEN 'BANK_TRANSFER' ELSE 'OTHER' END AS payment_method,
    CASE WHEN o_orderstatus <> 'O' THEN 'REF-' || CAST(o_orderkey AS VARCHAR) END AS payment_reference,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 DAY END AS payment_timestamp,
    o_totalprice AS payable_amount, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS amount_paid,
    o_orderdate AS created_at, o_orderdate AS updated_at, CASE WHEN o_orderstatus = 'F' THEN 'UPLOADED' ELSE 'PENDING' END AS upload_status
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (
    SELECT l_orderkey, sum(l_quantity) AS q, floor(avg(l_discount) * 1e6 + 0.5) / 1e6 AS f, floor(avg(l_tax) * 1e6 + 0.5) / 1e6 AS s FROM lineitem GROUP BY l_orderkey
  ) ON o_orderkey = l_orderkey
)"""


def farmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry over customers; those of negative balance are inactive."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("farmer_id"), F.col("c_name").alias("farmer_name"), F.lower(F.trim("c_name")).alias("normalized_name"), F.lit("1995-01-01").cast("timestamp_ntz").alias("created_at"), (F.col("c_acctbal") >= 0).alias("is_active"))


FARMERS_SQL = "reg AS (SELECT CAST(c_custkey AS VARCHAR) AS farmer_id, c_name AS farmer_name, lower(trim(c_name)) AS normalized_name, c_acctbal >= 0 AS is_active FROM customer)"


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both with one row for each key, that of the greatest version."""
    both = current.unionByName(changes)
    best = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("_row"))
    return best.select("_row.*")


#: Open rows that one task takes in order.
IN_ORDER = 100_000


def insert_absent(current: DataFrame, new: DataFrame, keys: list[str], order: str | None = None, in_order: int = IN_ORDER) -> DataFrame:
    """current, and the rows of new that share none of the keys with it or with a row inserted before them.

    New rows come in ascending `order` (the first key if not given), ties by all columns. A null key
    collides with nothing. Rows are numbered once in a written table; from then on only numbers and
    keys of open rows move, and every step's open rows and choices are written, so that no plan grows.
    A round inserts the rows that are the first of every key they have, wherever they stand, and drops
    what collides with them. Rows in a chain, each colliding with the one before, would take a round
    each: if a round closes fewer than `in_order` rows, or no more are open, the first `in_order` open
    rows are taken one after another in one task, which holds no more than those.
    """
    spark = current.sparkSession
    folder = shared_folder(spark, "insert")
    numbered = new.orderBy(order or keys[0], *new.columns).withColumn("_id", F.monotonically_increasing_id())
    rows = written(numbered, f"{folder}/rows")
    opened = rows.select("_id", *keys)
    for k in keys:
        opened = opened.join(current.select(k).where(F.col(k).isNotNull()), k, "left_anti")
    opened = written(opened.select("_id", *keys))
    left, closed, turn = opened.count(), in_order, 0
    schema = opened.schema
    while left:
        path = f"{folder}/chosen/turn={turn}"
        if left <= in_order or closed < in_order:
            taken = written(opened.orderBy("_id").limit(in_order))
            chosen = written(taken.repartition(1).mapInArrow(_in_order(keys), schema), path)
            after = opened.where(F.col("_id") > taken.agg(F.max("_id")).first()[0])
        else:
            taken = None
            first = [opened.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("_id").alias("_id")).select("_id") for k in keys]
            free = [opened.where(F.col(k).isNull()).select("_id") for k in keys]
            every = reduce(DataFrame.union, first + free).groupBy("_id").count().where(F.col("count") == len(keys))
            chosen = written(opened.join(every, "_id", "left_semi"), path)
            after = opened.join(chosen.select("_id"), "_id", "left_anti")
        for k in keys:
            after = after.join(chosen.select(k).where(F.col(k).isNotNull()), k, "left_anti")
        before, opened = opened, written(after.select("_id", *keys))
        still = opened.count()
        # After rows in order, rounds are tried again.
        left, closed, turn = still, left - still if taken is None else in_order, turn + 1
        drop(before, *([taken] if taken is not None else []))
    if not turn:
        return current
    chosen = spark.read.schema(T.StructType([*schema, T.StructField("turn", T.IntegerType())])).parquet(f"{folder}/chosen")
    return current.unionByName(rows.join(chosen.select("_id"), "_id", "left_semi").select(*new.columns))


def _in_order(keys: list[str]):
    """Of a task's rows, by number, those that share no key with a chosen one before."""

    def run(batches):
        import pyarrow as pa

        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("_id")
        seen, keep = [set() for _ in keys], []
        for i, row in enumerate(zip(*(table.column(k).to_pylist() for k in keys), strict=True)):
            if not any(v is not None and v in s for v, s in zip(row, seen, strict=True)):
                keep.append(i)
                for v, s in zip(row, seen, strict=True):
                    s.add(v)
        yield from table.take(pa.array(keep, pa.int64())).to_batches()

    return run


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, split: str | None = None) -> None:
    """One object a line; a folder for each value of the split column."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(split) if split else writer).json(path)
