"""First rows for an empty store: three farmers and a record of each."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.columns import payable_amount
from tallyloom.plans.entities import normalize
from tallyloom.sources.relations import FARMER, RECORD

# Name, quantity, fat, snf, paid in cash or not; the hours since each record.
SEED = (("Ramesh", 18.0, 4.2, 8.6, False, 3), ("Suresh", 12.0, 4.0, 8.5, True, 2), ("Mahesh", 20.0, 4.3, 8.7, False, 1))
ORGANIZATION, WORKER, REFERENCE = "ORG001", "WORKER001", "CASH-REC-001"


def seed(spark: SparkSession, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(registry, records) as a new store holds them."""
    farmers = [(str(i + 1), name, normalize(name), now, True) for i, (name, *_) in enumerate(SEED)]
    rows = []
    for i, (name, quantity, fat, snf, paid, hours) in enumerate(SEED):
        at = now - timedelta(hours=hours)
        status = ("RECORDED_LOCALLY", "CASH", REFERENCE, at) if paid else ("PENDING", None, None, None)
        rows.append((str(i + 1), ORGANIZATION, WORKER, str(i + 1), name, quantity, fat, snf, *status, None, None, at, at, "PENDING"))
    amount = payable_amount(F.col("quantity"), F.col("fat"), F.col("snf"))
    records = spark.createDataFrame(rows, RECORD).withColumn("payable_amount", amount)
    return spark.createDataFrame(farmers, FARMER), records.withColumn("amount_paid", F.when(F.col("payment_status") != "PENDING", F.col("payable_amount")))


def seeded(registry: DataFrame, records: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """The store as it is; with the first rows if its registry is empty."""
    return seed(registry.sparkSession, now) if registry.isEmpty() else (registry, records)
