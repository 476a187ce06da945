"""Fixed operational queries over the fact relation and the registry; writes are projections that return the new table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import effective_payable, half_up, normalized_name, payable_amount
from tallyloom.plans.temporal import bounds, within
from tallyloom.model import Period


def total_quantity() -> Column:
    return F.coalesce(F.sum("quantity"), F.lit(0.0))


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), "id")


def search(rows: DataFrame, name: str = "", payment_status: str | None = None, upload_status: str | None = None) -> DataFrame:
    """Name by LIKE without case (% and _ of the caller stay wildcards); what is empty or None doesn't restrict."""
    if name:
        rows = rows.where(F.lower("farmer_name").like(f"%{name.lower()}%"))
    for column, wanted in (("payment_status", payment_status), ("upload_status", upload_status)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    return newest_first(rows)


def by_id(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("id") == key).limit(1)


def pending_uploads(rows: DataFrame) -> DataFrame:
    return rows.where("upload_status = 'PENDING'").orderBy("created_at", "id")


def pending_payments(rows: DataFrame) -> DataFrame:
    return newest_first(rows.where("payment_status = 'PENDING'"))


def search_registry(registry: DataFrame, part: str) -> DataFrame:
    """Active entries whose name holds a part; a blank part finds none."""
    return registry.where(F.lit(False)) if not part.strip() else registry.where("is_active").where(F.contains("normalized_name", F.lit(part.strip().lower()))).orderBy("farmer_name")


def week_start(as_of: datetime, first_day: int = 0) -> datetime:
    """Midnight of the week's first day (0 Monday ... 6 Sunday, by locale)."""
    day = datetime.combine(as_of.date(), datetime.min.time())
    return day - timedelta(days=(day.weekday() - first_day) % 7)


def totals(rows: DataFrame) -> DataFrame:
    """Count, quantity, distinct names without case."""
    return rows.agg(F.count(F.lit(1)).alias("n"), total_quantity().alias("total_quantity"), F.countDistinct(F.lower("farmer_name")).alias("n_names"))


def today(rows: DataFrame, as_of: datetime) -> DataFrame:
    return rows.where(within("created_at", *bounds(Period("RELATIVE", "TODAY"), as_of)))


def since(rows: DataFrame, start: datetime) -> DataFrame:
    return rows.where(F.col("created_at") >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"))


def week_of(rows: DataFrame, as_of: datetime, name: str, first_day: int = 0) -> DataFrame:
    """What one name (a part, without case) gave since the week's start."""
    return search(since(rows, week_start(as_of, first_day)), name).agg(total_quantity().alias("total_quantity"))


def covered(rows: DataFrame, as_of: datetime, period: str = "today", first_day: int = 0) -> DataFrame:
    """Distinct names without case: today, this week, or ever."""
    chosen = {"today": lambda: today(rows, as_of), "week": lambda: since(rows, week_start(as_of, first_day))}.get(period.strip().lower(), lambda: rows)()
    return chosen.agg(F.countDistinct(F.lower("farmer_name")).alias("n_names"))


def affected(rows: DataFrame) -> DataFrame:
    """How many rows a sync of all pending ones would change: ask before it."""
    return rows.agg(F.count_if(F.col("upload_status") == "PENDING").alias("n"))


def history(rows: DataFrame, name: str) -> DataFrame:
    found = search(rows, name)
    return found.agg(F.count(F.lit(1)).alias("n"), total_quantity().alias("total_quantity"))


def pending_summary(rows: DataFrame) -> DataFrame:
    return rows.where("payment_status = 'PENDING'").agg(F.count(F.lit(1)).alias("n"), total_quantity().alias("total_quantity"), half_up(F.coalesce(F.sum(effective_payable()), F.lit(0.0))).alias("total_amount"))


def dashboard(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Five figures of one table in one pass."""
    now = within("created_at", *bounds(Period("RELATIVE", "TODAY"), as_of))
    return rows.agg(
        F.count_if(now).alias("n_today"), F.coalesce(F.sum(F.when(now, F.col("quantity"))), F.lit(0.0)).alias("quantity_today"),
        F.countDistinct(F.when(now, F.lower("farmer_name"))).alias("names_today"),
        F.count_if(F.col("upload_status") == "PENDING").alias("n_pending_upload"), F.count(F.lit(1)).alias("n_all"),
    )


def create_record(fields: DataFrame, now: Column) -> DataFrame:
    """New rows from validated input (id, farmer_name, quantity, fat, snf, payment_status, payment_method, payment_reference): amounts and times are filled in."""
    paid = F.upper("payment_status").isin("PAID", "RECORDED_LOCALLY", "COMPLETE", "SETTLED")
    amount = payable_amount(F.col("quantity"), F.col("fat"), F.col("snf"))
    return fields.withColumns({
        "payable_amount": amount, "payment_status": F.when(paid, "RECORDED_LOCALLY").otherwise("PENDING"), "amount_paid": F.when(paid, amount),
        "payment_timestamp": F.when(paid, now), "created_at": now, "updated_at": now, "upload_status": F.lit("PENDING"),
    })


def pay(rows: DataFrame, key: str, status: str, method: str, reference: str | None, now: Column, amount: float | None = None) -> DataFrame:
    """The table after one payment; without an amount the payable one counts as paid."""
    hit = F.col("id") == key
    new = {"payment_status": F.lit(status), "payment_method": F.lit(method), "payment_reference": F.lit(reference).cast("string"), "payment_timestamp": now, "updated_at": now, "amount_paid": F.lit(amount) if amount is not None else effective_payable()}
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def mark_uploaded(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The table after a sync of all pending rows, or of those named in a table of ids."""
    if ids is None:
        return rows.withColumn("upload_status", F.when(F.col("upload_status") == "PENDING", "UPLOADED").otherwise(F.col("upload_status")))
    named = ids.select(F.col("id").alias("_id")).distinct()
    return rows.join(named, F.col("id") == F.col("_id"), "left").withColumn("upload_status", F.when(F.col("_id").isNotNull(), "UPLOADED").otherwise(F.col("upload_status"))).drop("_id")


def set_active(registry: DataFrame, key: str, active: bool) -> DataFrame:
    return registry.withColumn("is_active", F.when(F.col("farmer_id") == key, F.lit(active)).otherwise(F.col("is_active")))


def rename(registry: DataFrame, key: str, name: str) -> DataFrame:
    hit = F.col("farmer_id") == key
    return registry.withColumn("farmer_name", F.when(hit, F.lit(name)).otherwise(F.col("farmer_name"))).withColumn("normalized_name", F.when(hit, normalized_name(F.lit(name))).otherwise(F.col("normalized_name")))


def unambiguous(rows: DataFrame) -> DataFrame:
    """Registry entries from the facts: names that alone have their key (lower case, trimmed); colliding ones stay out."""
    key = F.lower(F.trim("farmer_name"))
    grouped = rows.where(F.trim("farmer_name") != "").groupBy(key.alias("normalized_name")).agg(F.min("farmer_name").alias("farmer_name"), F.countDistinct("farmer_name").alias("n"))
    return grouped.where("n = 1").drop("n")


def link(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Facts without a farmer_id get that of their name's entry."""
    known = registry.select(F.col("normalized_name").alias("_n"), F.col("farmer_id").alias("_f"))
    joined = rows.join(known, F.lower(F.trim("farmer_name")) == F.col("_n"), "left")
    return joined.withColumn("farmer_id", F.coalesce("farmer_id", "_f")).drop("_n", "_f")


def get_or_create(registry: DataFrame, name: str, new_id: str) -> DataFrame:
    """The entry of a name, or a new one where there is none; a blank name has none and gets none."""
    spark = registry.sparkSession
    asked = spark.createDataFrame([(new_id, name)], "farmer_id string, farmer_name string").select("farmer_id", F.trim(F.regexp_replace("farmer_name", r"\s+", " ")).alias("farmer_name"), normalized_name(F.col("farmer_name")).alias("normalized_name"))
    asked = asked.where("normalized_name != ''")
    known = registry.join(asked.select("normalized_name"), "normalized_name", "left_semi").select("farmer_id", "farmer_name", "normalized_name")
    return known.unionByName(asked.join(registry.select("normalized_name"), "normalized_name", "left_anti"))
