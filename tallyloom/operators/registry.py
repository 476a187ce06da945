"""The engine's queries and their SQL, by name. All run over the driver's tables in the canonical relation of sources.relations."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.functions import extraction as X
from tallyloom.model import PERIODS, Aggregation, Conditional, Filter, Having, Order, Period, Query
from tallyloom.operators import catalog, dataset, retrieval, similar
from tallyloom.plans import compiler, questions, temporal
from tallyloom.plans.validate import record_errors
from tallyloom.sources import relations as R

AS_OF = datetime(1998, 8, 19, 12)
Build = Callable[[SparkSession, str], DataFrame]
_ENTRIES: dict[str, tuple[Build, str | None]] = {}


def _sql(tail: str, registry: bool = False) -> str:
    return f"WITH {R.ORDERS_SQL}{', ' + R.FARMERS_SQL if registry else ''} {tail}"


def entry(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def put(build: Build) -> Build:
        _ENTRIES[name] = (build, sql)
        return build

    return put


def dsl(name: str, q: Query, tail: str, measures: bool = False, keep: tuple[str, ...] = (), **scope: str) -> None:
    """A query of the language over the orders relation."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = compiler.compile(q, R.orders(spark, sf_dir, measures), AS_OF, R.farmers(spark, sf_dir), **scope)
        if made.df is None:
            raise ValueError(f"{name}: {made.status} {made.errors}")
        return made.df.select(*keep) if keep else made.df

    _ENTRIES[name] = (build, _sql(tail))


def _round(x: str) -> str:
    return f"floor(({x}) * 100.0 + 0.5) / 100.0"


# Scans and filters -------------------------------------------------------------------------------
_C = "CAST(count(*) AS BIGINT)"
SUM_Q, N = Aggregation("SUM", "QUANTITY"), Aggregation("COUNT_RECORDS")
for _name, _filter, _where in (
    ("filter_equals_ci", Filter("PAYMENT_METHOD", "EQUALS", "cash"), "lower(payment_method) = 'cash'"),
    ("filter_equals_number_as_text", Filter("QUANTITY", "EQUALS", "25.0"), "quantity = 25.0"),
    ("filter_not_equals_null_true", Filter("PAYMENT_METHOD", "NOT_EQUALS", "Cash"), "payment_method IS NULL OR lower(payment_method) <> 'cash'"),
    ("filter_gt", Filter("QUANTITY", "GREATER_THAN", "100"), "quantity > 100"),
    ("filter_ge", Filter("PAYABLE_AMOUNT", "GREATER_OR_EQUAL", "200000"), "payable_amount >= 200000"),
    ("filter_lt", Filter("QUANTITY", "LESS_THAN", "20"), "quantity < 20"),
    ("filter_le", Filter("FAT", "LESS_OR_EQUAL", "0.05"), "coalesce(fat <= 0.05, false)"),
    ("filter_in_range", Filter("AMOUNT_PAID", "IN_RANGE", "1000", "50000"), "amount_paid BETWEEN 1000 AND 50000"),
    ("filter_is_null", Filter("PAYMENT_TIMESTAMP", "IS_NULL"), "payment_timestamp IS NULL"),
    ("filter_is_not_null", Filter("FARMER_ID", "IS_NOT_NULL"), "farmer_id IS NOT NULL"),
    ("filter_contains", Filter("FARMER_NAME", "CONTAINS", "#00000012"), "contains(lower(farmer_name), '#00000012')"),
    ("filter_unparsable_is_false", Filter("QUANTITY", "GREATER_THAN", "many"), "false"),
):
    dsl(_name, Query(filters=(_filter,), select=("FARMER_NAME", "QUANTITY", "PAYMENT_STATUS")), f"SELECT id, farmer_name, quantity, payment_status FROM rel WHERE {_where}", measures=True)

_pair = (Filter("QUANTITY", "GREATER_THAN", "100"), Filter("PAYMENT_STATUS", "EQUALS", "pending"))
dsl("filter_and", Query(filters=_pair, select=("QUANTITY",)), "SELECT id, quantity FROM rel WHERE quantity > 100 AND payment_status = 'PENDING'", measures=True)
dsl("filter_or", Query(filters=_pair, any_filter=True, select=("QUANTITY",)), "SELECT id, quantity FROM rel WHERE quantity > 100 OR payment_status = 'PENDING'", measures=True)
dsl("filter_paid_is_literal", Query(filters=(Filter("PAYMENT_STATUS", "EQUALS", "PAID"),), aggregations=(N,)), f"SELECT {_C} AS count_records FROM rel WHERE payment_status = 'PAID' HAVING count(*) > 0")
dsl("scope_blank_or_equal", Query(aggregations=(N,)), f"SELECT {_C} AS count_records FROM rel WHERE org_id = '7' AND worker_id IN ('', 'MACHINERY') HAVING count(*) > 0", org="7", worker="MACHINERY")
dsl("select_prunes", Query(select=("PAYMENT_REFERENCE", "UPLOAD_STATUS")), "SELECT id, payment_reference, upload_status FROM rel")

# Periods -----------------------------------------------------------------------------------------
for _p in (*(Period("RELATIVE", p) for p in PERIODS), Period("DATE", None, "19/08/1998"), Period("RANGE", None, "1996-01-01", "1996-03-31")):
    _a, _b = temporal.bounds(_p, AS_OF)
    _name = f"period_{_p.period.lower()}" if _p.period else "explicit_date" if _p.kind == "DATE" else "explicit_range"
    dsl(_name, Query(time=_p, select=("FARMER_NAME", "PAYABLE_AMOUNT")), f"SELECT id, farmer_name, payable_amount FROM rel WHERE created_at >= TIMESTAMP '{_a}' AND created_at < TIMESTAMP '{_b}'")

# Aggregates --------------------------------------------------------------------------------------
_paid, _null0 = "AMOUNT_PAID", "coalesce(amount_paid, 0.0)"
dsl("agg_sum_null0", Query(aggregations=(Aggregation("SUM", _paid),)), f"SELECT {_round(f'sum({_null0})')} AS sum_amount_paid FROM rel HAVING count(*) > 0")
dsl("agg_avg_null0", Query(aggregations=(Aggregation("AVG", _paid),)), f"SELECT {_round(f'avg({_null0})')} AS avg_amount_paid FROM rel HAVING count(*) > 0")
dsl("agg_min_null0", Query(aggregations=(Aggregation("MIN", _paid),)), f"SELECT min({_null0}) AS min_amount_paid FROM rel HAVING count(*) > 0")
dsl("agg_max_null0", Query(aggregations=(Aggregation("MAX", _paid),)), f"SELECT max({_null0}) AS max_amount_paid FROM rel HAVING count(*) > 0")
dsl("agg_count", Query(aggregations=(N,)), f"SELECT {_C} AS count_records FROM rel HAVING count(*) > 0")
dsl("agg_distinct_nonblank", Query(aggregations=(Aggregation("COUNT_DISTINCT_FARMERS"),)), "SELECT CAST(count(DISTINCT farmer_id) AS BIGINT) AS count_farmers FROM rel HAVING count(*) > 0")
dsl("agg_multi", Query(aggregations=(SUM_Q, Aggregation("AVG", "FAT"), N)), f"SELECT {_round('sum(quantity)')} AS sum_quantity, {_round('avg(coalesce(fat, 0.0))')} AS avg_fat, {_C} AS count_records FROM rel HAVING count(*) > 0", measures=True)
dsl("agg_empty_input", Query(aggregations=(SUM_Q,), time=Period("DATE", None, "1970-01-01")), "SELECT 0.0 AS sum_quantity WHERE false")
dsl(
    "limit_then_agg", Query(aggregations=(SUM_Q, N), order=Order("PAYABLE_AMOUNT"), limit=50),
    f"SELECT {_round('sum(quantity)')} AS sum_quantity, {_C} AS count_records FROM (SELECT * FROM rel ORDER BY coalesce(payable_amount, 0.0) DESC, created_at DESC, id LIMIT 50)", measures=True,
)

# Groups ------------------------------------------------------------------------------------------
_key = lambda c: f"coalesce(lower(trim({c})), 'unknown')"
_show = lambda c: f"coalesce(max(struct_pack(t := created_at, v := {c})).v, 'Unknown')"
_by = lambda c, cols, more="": f"SELECT {_key(c)} AS group_key, {_show(c)} AS display, {cols} FROM rel GROUP BY 1 {more}"
_SUMQ = f"{_round('sum(quantity)')} AS sum_quantity"
dsl("group_sum", Query(group_by=("PAYMENT_STATUS",), aggregations=(SUM_Q,)), _by("payment_status", _SUMQ), measures=True)
dsl("group_null_unknown", Query(group_by=("PAYMENT_METHOD",), aggregations=(N,)), _by("payment_method", f"{_C} AS count_records"))
dsl("group_trim_lower", Query(group_by=("FARMER_NAME",), aggregations=(Aggregation("MAX", "PAYABLE_AMOUNT"),)), _by("farmer_name", "max(coalesce(payable_amount, 0.0)) AS max_payable_amount"))
dsl("group_default_count", Query(group_by=("UPLOAD_STATUS",)), _by("upload_status", f"{_C} AS count_records"))
dsl(
    "group_two_fields", Query(group_by=("PAYMENT_STATUS", "PAYMENT_METHOD"), aggregations=(N,)),
    f"SELECT {_key('payment_status')} AS group_key, {_key('payment_method')} AS group_key_2, {_show('payment_status')} AS display, {_C} AS count_records FROM rel GROUP BY 1, 2",
)
for _n, _op, _s in (("gt", "GREATER_THAN", ">"), ("ge", "GREATER_OR_EQUAL", ">="), ("lt", "LESS_THAN", "<"), ("le", "LESS_OR_EQUAL", "<="), ("eq", "EQUALS", "=")):
    _v = 12.0 if _n == "eq" else 400.0
    _h = Having("COUNT_RECORDS" if _n == "eq" else "SUM", "QUANTITY", _op, _v)
    _x = "count(*)" if _n == "eq" else _round("sum(quantity)")
    dsl(f"having_{_n}", Query(group_by=("FARMER_NAME",), aggregations=(SUM_Q,), having=_h), _by("farmer_name", _SUMQ, f"HAVING {_x} {_s} {_v}"), measures=True)
for _n, _desc in (("asc", False), ("desc", True)):
    dsl(f"order_by_agg_{_n}", Query(group_by=("FARMER_NAME",), aggregations=(N,), order=Order("QUANTITY", "SUM", _desc), limit=25), _by("farmer_name", f"{_C} AS count_records", f"ORDER BY {_round('sum(quantity)')} {_n}, 1 LIMIT 25"), measures=True)
dsl("order_groups_by_name", Query(group_by=("FARMER_NAME",), aggregations=(N,), order=Order("QUANTITY", None, False), limit=25), _by("farmer_name", f"{_C} AS count_records", f"ORDER BY lower({_show('farmer_name')}), 1 LIMIT 25"))
_span = Period("RANGE", None, "1997-01-01", "1997-12-31")
_year = "WHERE created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1998-01-01'"
for _n, _k in (("top_1", 1), ("top_k", 10)):
    dsl(
        _n, Query(group_by=("FARMER_NAME",), aggregations=(SUM_Q,), order=Order("QUANTITY", "SUM"), limit=_k, time=_span),
        f"SELECT {_key('farmer_name')} AS group_key, {_show('farmer_name')} AS display, {_SUMQ} FROM rel {_year} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT {_k}", measures=True,
    )
dsl("sort_by_field_null0", Query(order=Order("AMOUNT_PAID", None, False), limit=40, select=("AMOUNT_PAID",)), "SELECT id, amount_paid FROM rel ORDER BY coalesce(amount_paid, 0.0), created_at DESC, id LIMIT 40")


@entry("group_members", _sql(f"SELECT id, farmer_name FROM rel WHERE {_key('farmer_name')} IN (SELECT {_key('farmer_name')} FROM rel GROUP BY 1 HAVING {_round('sum(quantity)')} > 900)"))
def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(group_by=("FARMER_NAME",), aggregations=(SUM_Q,), having=Having("SUM", "QUANTITY", "GREATER_THAN", 900.0))
    return compiler.members(q, R.orders(spark, sf_dir)).select("id", "farmer_name")


# Existence, statuses, reports --------------------------------------------------------------------
dsl("exists", Query(exists=True, filters=(Filter("PAYABLE_AMOUNT", "GREATER_THAN", "400000"),), group_by=("FARMER_NAME",), limit=3), "SELECT count(*) > 0 AS exists, CAST(count(*) AS BIGINT) AS n FROM rel WHERE payable_amount > 400000")
_one = "lower(farmer_name) = 'customer#000000007'"
_who = {"mention": "Customer#000000007", "specific": True}
_is_paid = "payment_status IN ('RECORDED_LOCALLY', 'PAID')"
_np = "CAST(count(*) FILTER (WHERE payment_status = 'PENDING') AS BIGINT) AS n_pending"
dsl("scope_all", Query(**_who, scope="ALL"), f"SELECT {_C} AS n, bool_and({_is_paid}) AS all_paid, {_np} FROM rel WHERE {_one} HAVING count(*) > 0")
dsl("scope_any", Query(**_who, scope="ANY"), f"SELECT {_C} AS n, bool_or({_is_paid}) AS any_paid, {_np} FROM rel WHERE {_one} HAVING count(*) > 0")
dsl("scope_latest", Query(**_who, scope="LATEST"), f"SELECT id, farmer_name, payment_status, payment_method, payment_reference, {_is_paid} AS paid FROM rel WHERE {_one} ORDER BY created_at DESC, id LIMIT 1")
dsl(
    "conditional_report", Query(**_who, conditional=Conditional()),
    f"""SELECT id, farmer_name, {_is_paid} AS matched, CASE WHEN {_is_paid} THEN payment_method END AS payment_method, CASE WHEN {_is_paid} THEN payment_reference END AS payment_reference,
    CASE WHEN NOT {_is_paid} THEN payment_status END AS payment_status, CASE WHEN NOT {_is_paid} THEN payable_amount END AS payable_amount FROM rel WHERE {_one} ORDER BY created_at DESC, id LIMIT 1""",
)
dsl("entity_rows", Query(**_who, select=("FARMER_NAME", "PAYABLE_AMOUNT")), f"SELECT id, farmer_name, payable_amount FROM rel WHERE {_one}")


@entry("paid_pending_totals", _sql(f"SELECT {_C} AS n, {_round(f'sum(CASE WHEN {_is_paid} THEN coalesce(amount_paid, payable_amount) ELSE 0.0 END)')} AS paid_total, {_round(f'sum(CASE WHEN NOT {_is_paid} THEN payable_amount ELSE 0.0 END)')} AS pending_total FROM rel"))
def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.payment_totals(R.orders(spark, sf_dir, False)).drop("last_payment")


@entry("latest_payment_ts", _sql("SELECT farmer_id, strftime(max(payment_timestamp), '%Y-%m-%d %H:%M:%S') AS last_payment FROM rel GROUP BY farmer_id"))
def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orders(spark, sf_dir, False).groupBy("farmer_id").agg(F.date_format(F.max("payment_timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last_payment"))


@entry("agg_distinct_lower_name", _sql("SELECT CAST(count(DISTINCT lower(farmer_name)) AS BIGINT) AS n_names FROM rel"))
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orders(spark, sf_dir, False).agg(F.countDistinct(F.lower("farmer_name")).alias("n_names"))


_AMOUNT = _round("l_quantity * greatest(35.0 + greatest(l_discount * 100.0 - 3.5, 0.0) * 4 + greatest(l_tax * 200.0 - 8.0, 0.0) * 2, 30.0)")


@entry("payable_amount", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_AMOUNT} AS amount FROM lineitem")
def _payable(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = C.payable_amount(F.col("l_quantity"), F.col("l_discount") * 100.0, F.col("l_tax") * 200.0)
    return R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amount.alias("amount"))


@entry("formatted_values", _sql("SELECT id, printf('%.1f', quantity) || ' L' AS quantity_text, '₹' || printf('%.2f', payable_amount) AS amount_text, strftime(created_at, '%d %b %Y, %I:%M %p') AS created_text, coalesce(payment_method, 'CASH') AS method, coalesce(payment_reference, 'N/A') AS reference FROM rel"))
def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.orders(spark, sf_dir)
    return rows.select("id", C.formatted(F.col("quantity"), "L").alias("quantity_text"), C.formatted(F.col("payable_amount"), "₹", 2).alias("amount_text"), C.display_time(F.col("created_at")).alias("created_text"), C.display_method().alias("method"), C.display_reference().alias("reference"))


# The catalogue -----------------------------------------------------------------------------------
_PICK = ("id", "farmer_name", "payment_status", "upload_status")


def catalogue(name: str, build: Callable[[DataFrame], DataFrame], tail: str, measures: bool = False) -> None:
    _ENTRIES[name] = (lambda spark, sf_dir: build(R.orders(spark, sf_dir, measures)), _sql(tail))


_pick = ", ".join(_PICK)
catalogue("scan_newest", lambda r: catalog.newest_first(r).select(*_PICK), f"SELECT {_pick} FROM rel")
catalogue("search_by_name", lambda r: catalog.search(r, "#00000001", "PENDING").select(*_PICK), f"SELECT {_pick} FROM rel WHERE lower(farmer_name) LIKE '%#00000001%' AND payment_status = 'PENDING'")
catalogue("search_no_filters", lambda r: catalog.search(r).select(*_PICK), f"SELECT {_pick} FROM rel")
catalogue("lookup_by_id", lambda r: catalog.by_id(r, "77").select(*_PICK), f"SELECT {_pick} FROM rel WHERE id = '77' LIMIT 1")
catalogue("pending_oldest_first", lambda r: catalog.pending_uploads(r).select(*_PICK), f"SELECT {_pick} FROM rel WHERE upload_status = 'PENDING'")
catalogue("pending_payments", lambda r: catalog.pending_payments(r).select(*_PICK), f"SELECT {_pick} FROM rel WHERE payment_status = 'PENDING'")
_T3 = f"{_C} AS n, coalesce(sum(quantity), 0.0) AS total_quantity, CAST(count(DISTINCT lower(farmer_name)) AS BIGINT) AS n_names"
_today = "created_at >= TIMESTAMP '1998-08-19' AND created_at < TIMESTAMP '1998-08-20'"
catalogue("today_summary", lambda r: catalog.totals(catalog.today(r, AS_OF)), f"SELECT {_T3} FROM rel WHERE {_today}", True)
catalogue("weekly_summary", lambda r: catalog.totals(catalog.since(r, catalog.week_start(AS_OF, 6))), f"SELECT {_T3} FROM rel WHERE created_at >= TIMESTAMP '1998-08-16'", True)
catalogue("weekly_summary_monday", lambda r: catalog.totals(catalog.since(r, catalog.week_start(AS_OF))), f"SELECT {_T3} FROM rel WHERE created_at >= TIMESTAMP '1998-08-17'", True)
catalogue("all_time_summary", catalog.totals, f"SELECT {_T3} FROM rel", True)
catalogue("farmer_history", lambda r: catalog.history(r, "customer#000000010"), f"SELECT {_C} AS n, coalesce(sum(quantity), 0.0) AS total_quantity FROM rel WHERE lower(farmer_name) LIKE '%customer#000000010%'", True)
catalogue("pending_payment_summary", catalog.pending_summary, f"SELECT {_C} AS n, coalesce(sum(quantity), 0.0) AS total_quantity, {_round('coalesce(sum(payable_amount), 0.0)')} AS total_amount FROM rel WHERE payment_status = 'PENDING'", True)
catalogue(
    "dashboard", lambda r: catalog.dashboard(r, AS_OF),
    f"""SELECT CAST(count(*) FILTER (WHERE {_today}) AS BIGINT) AS n_today, coalesce(sum(quantity) FILTER (WHERE {_today}), 0.0) AS quantity_today,
    CAST(count(DISTINCT lower(farmer_name)) FILTER (WHERE {_today}) AS BIGINT) AS names_today, CAST(count(*) FILTER (WHERE upload_status = 'PENDING') AS BIGINT) AS n_pending_upload, {_C} AS n_all FROM rel""", True,
)
_now = lambda: F.lit("1998-08-19 12:00:00").cast("timestamp_ntz")
catalogue("batch_sync", lambda r: catalog.mark_uploaded(r).groupBy("upload_status").agg(F.count(F.lit(1)).alias("n")), f"SELECT 'UPLOADED' AS upload_status, {_C} AS n FROM rel HAVING count(*) > 0")
catalogue(
    "sync_by_ids", lambda r: catalog.mark_uploaded(r, r.where("payment_method = 'UPI'").select("id")).groupBy("upload_status").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT CASE WHEN payment_method = 'UPI' THEN 'UPLOADED' ELSE upload_status END AS upload_status, {_C} AS n FROM rel GROUP BY 1",
)
catalogue(
    "payment_update", lambda r: catalog.pay(r, "5", "PAID", "UPI", "UPI-77", _now()).select("id", "payment_status", "payment_method", "payment_reference", "amount_paid"),
    """SELECT id, CASE WHEN id = '5' THEN 'PAID' ELSE payment_status END AS payment_status, CASE WHEN id = '5' THEN 'UPI' ELSE payment_method END AS payment_method,
    CASE WHEN id = '5' THEN 'UPI-77' ELSE payment_reference END AS payment_reference, CASE WHEN id = '5' THEN coalesce(amount_paid, payable_amount) ELSE amount_paid END AS amount_paid FROM rel""",
)


@entry("upsert_latest", _sql("SELECT id, CASE WHEN payment_status = 'PENDING' THEN 'PAID' ELSE payment_status END AS payment_status, payable_amount FROM rel"))
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.orders(spark, sf_dir, False).select("id", "payment_status", "payable_amount").withColumn("version", F.lit(1))
    changed = rows.where("payment_status = 'PENDING'").withColumns({"payment_status": F.lit("PAID"), "version": F.lit(2)})
    return R.upsert(rows, changed, "id", "version").drop("version")


def farmer_entry(name: str, build: Callable[[DataFrame], DataFrame], tail: str) -> None:
    _ENTRIES[name] = (lambda spark, sf_dir: build(R.farmers(spark, sf_dir)), f"WITH {R.FARMERS_SQL} {tail}")


_F3 = ("farmer_id", "farmer_name", "is_active")
farmer_entry("farmers_active", lambda f: f.where("is_active").orderBy("farmer_name").select(*_F3), "SELECT farmer_id, farmer_name, is_active FROM reg WHERE is_active")
farmer_entry("farmer_by_normalized_name", lambda f: f.where("is_active AND normalized_name = 'customer#000000021'").limit(1).select(*_F3), "SELECT farmer_id, farmer_name, is_active FROM reg WHERE is_active AND normalized_name = 'customer#000000021' LIMIT 1")
farmer_entry("farmer_search", lambda f: catalog.search_registry(f, " #00000002 ").select(*_F3), "SELECT farmer_id, farmer_name, is_active FROM reg WHERE is_active AND contains(normalized_name, '#00000002')")
farmer_entry("farmer_search_blank", lambda f: catalog.search_registry(f, "  ").select(*_F3), "SELECT farmer_id, farmer_name, is_active FROM reg WHERE false")
farmer_entry("soft_delete", lambda f: catalog.set_active(f, "3", False).select(*_F3), "SELECT farmer_id, farmer_name, CASE WHEN farmer_id = '3' THEN false ELSE is_active END AS is_active FROM reg")
farmer_entry("rename_farmer", lambda f: catalog.rename(f, "3", "Asha  Rao's").select("farmer_id", "farmer_name", "normalized_name"), "SELECT farmer_id, CASE WHEN farmer_id = '3' THEN 'Asha  Rao''s' ELSE farmer_name END AS farmer_name, CASE WHEN farmer_id = '3' THEN 'asha rao' ELSE normalized_name END AS normalized_name FROM reg")
farmer_entry(
    "insert_if_absent", lambda f: R.insert_absent(f, f.limit(0).unionByName(f.where("farmer_id IN ('1', '2')").withColumns({"farmer_id": F.concat(F.lit("new-"), "farmer_id"), "normalized_name": F.when(F.col("farmer_id") == "1", F.col("normalized_name")).otherwise("asha rao")})), ["farmer_id", "normalized_name"]).select("farmer_id", "normalized_name"),
    "SELECT farmer_id, normalized_name FROM reg UNION ALL SELECT 'new-' || farmer_id, 'asha rao' FROM reg WHERE farmer_id = '2'",
)


@entry("migration_unambiguous", _sql("SELECT lower(trim(farmer_name)) AS normalized_name, min(farmer_name) AS farmer_name FROM rel WHERE trim(farmer_name) <> '' GROUP BY 1 HAVING count(DISTINCT farmer_name) = 1"))
def _unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unambiguous(R.orders(spark, sf_dir, False))


@entry("migration_link", _sql("SELECT id, coalesce(rel.farmer_id, reg.farmer_id) AS farmer_id FROM rel LEFT JOIN reg ON lower(trim(rel.farmer_name)) = reg.normalized_name", True))
def _link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.link(R.orders(spark, sf_dir, False), R.farmers(spark, sf_dir)).select("id", "farmer_id")


# Entities ----------------------------------------------------------------------------------------
def resolution(name: str, mention: str, sql: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tallyloom.plans.entities import candidates

        return candidates(R.farmers(spark, sf_dir), mention).select("farmer_id", F.col("match").alias("how"))

    _ENTRIES[name] = (build, f"WITH {R.FARMERS_SQL}, k AS (SELECT farmer_id, trim(regexp_replace(regexp_replace(normalized_name, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS known FROM reg WHERE is_active) {sql}")


_how = lambda asked, toks: f"SELECT farmer_id, how FROM (SELECT farmer_id, CASE WHEN known = '{asked}' THEN 1 WHEN contains(known, '{asked}') OR contains('{asked}', known) THEN 2 WHEN list_has_any(list_filter(string_split(known, ' '), lambda t: length(t) >= 2), {toks}) THEN 3 END AS how FROM k) WHERE how IS NOT NULL"
resolution("resolve_exact", "Customer#000000010's", _how("customer 000000010", "['customer', '000000010']"))
resolution("resolve_contains", "00000003", _how("00000003", "['00000003']"))
resolution("resolve_token", "mister 000000031", _how("mister 000000031", "['mister', '000000031']"))


@entry("spelling_variants", "SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN lower(c_name) WHEN 2 THEN upper(c_name) WHEN 3 THEN replace(c_name, '.', '') WHEN 4 THEN replace(c_name, ' ', '  ') ELSE c_name END AS name FROM customer")
def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "customer").select("c_custkey", C.varied_spelling(F.col("c_name"), F.col("c_custkey")).alias("name"))


# Texts: extraction, validation, retrieval --------------------------------------------------------
def _said(sql: bool = False):
    """Sentences about orders, as a column or in SQL."""
    return (
        "c_name || CASE WHEN o_orderkey % 3 = 0 THEN ' gave ' ELSE ' delivered ' END || CAST(o_orderkey % 90 AS VARCHAR) || '.5 litres, fat ' || CAST(o_orderkey % 9 AS VARCHAR) || '.2 and SNF 8.' || CAST(o_orderkey % 10 AS VARCHAR) || CASE o_orderkey % 4 WHEN 0 THEN '. Paid in cash.' WHEN 1 THEN '. UPI.' WHEN 2 THEN '. Payment is pending.' ELSE '.' END"
        if sql
        else F.concat(
            "c_name", F.when(F.col("o_orderkey") % 3 == 0, " gave ").otherwise(" delivered "), (F.col("o_orderkey") % 90).cast("string"), F.lit(".5 litres, fat "), (F.col("o_orderkey") % 9).cast("string"), F.lit(".2 and SNF 8."), (F.col("o_orderkey") % 10).cast("string"),
            F.when(F.col("o_orderkey") % 4 == 0, ". Paid in cash.").when(F.col("o_orderkey") % 4 == 1, ". UPI.").when(F.col("o_orderkey") % 4 == 2, ". Payment is pending.").otherwise("."),
        )
    )


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return R.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", _said().alias("text"))


_S = f"WITH s AS (SELECT o_orderkey, {_said(True)} AS text FROM orders JOIN customer ON o_custkey = c_custkey)"
for _n, _patterns, _f in (("quantity", X.QUANTITY, X.quantity), ("fat", X.FAT, X.fat), ("snf", X.SNF, X.snf)):
    _tries = ", ".join(f"nullif(regexp_extract(text, '(?i){p}', 1), '')" for p in _patterns)
    _ENTRIES[f"extract_{_n}"] = (lambda spark, sf_dir, f=_f: _sentences(spark, sf_dir).select("o_orderkey", f(F.col("text")).alias("value")), f"{_S} SELECT o_orderkey, coalesce({_tries}) AS value FROM s")


@entry("extract_payment", f"{_S} SELECT o_orderkey, CASE WHEN contains(lower(text), 'cash') THEN 'CASH' WHEN contains(lower(text), 'upi') THEN 'UPI' END AS method, CASE WHEN contains(lower(text), 'cash') OR contains(lower(text), 'upi') THEN 'RECORDED_LOCALLY' WHEN contains(lower(text), 'pending') THEN 'PENDING' END AS status FROM s")
def _payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("o_orderkey", X.payment(F.col("text")).alias("p")).select("o_orderkey", "p.method", "p.status")


@entry("reconcile", f"{_S} SELECT o_orderkey, CAST(o_orderkey % 90 AS VARCHAR) || '.5' AS quantity FROM s")
def _reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("o_orderkey", X.reconciled(X.quantity(F.col("text")), (F.col("o_orderkey") % 90).cast("string")).alias("quantity"))


_holds = lambda words: " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@entry("question_kinds", f"SELECT conv_id, turn, CASE WHEN {_holds(questions.POLICY)} THEN 'KNOWLEDGE' WHEN {_holds(questions.PROFILE)} THEN 'PROFILE' WHEN {_holds(questions.ORGANIZATION)} THEN 'ORGANIZATION' ELSE 'RECORDS' END AS kind FROM conversations")
def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "conversations").select("conv_id", "turn", questions.kind(F.col("text")).alias("kind"))


@entry("validate_record", _sql("""SELECT id, array_to_string(list_filter([CASE WHEN length(trim(farmer_name)) < 2 THEN 'name' END, CASE WHEN quantity <= 0 OR quantity > 1000 THEN 'quantity' END,
    CASE WHEN fat IS NULL OR fat * 200 > 15 THEN 'fat' END, CASE WHEN snf IS NULL OR snf * 200 > 15 THEN 'snf' END, CASE WHEN payment_status <> 'PENDING' AND payment_method IN ('UPI', 'BANK_TRANSFER') AND CAST(id AS BIGINT) % 2 = 0 THEN 'reference' END], lambda x: x IS NOT NULL), ',') AS errors FROM rel"""))
def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.orders(spark, sf_dir)
    reference = F.when(F.col("id").cast("long") % 2 == 0, " ").otherwise(F.col("payment_reference"))
    errors = record_errors(F.col("farmer_name"), F.col("quantity"), F.col("fat") * 200, F.col("snf") * 200, F.col("payment_status"), F.col("payment_method"), reference)
    return rows.select("id", F.array_join(errors, ",").alias("errors"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("document_title"), F.col("lang").alias("section_title"), F.col("text").alias("content"), F.array("lang", "source").alias("keywords"))


_hit = lambda t: f"(CASE WHEN contains(lower(lang), '{t}') OR contains(lower(source), '{t}') THEN 3.5 ELSE 0 END + CASE WHEN contains(lower(lang), '{t}') THEN 2.5 ELSE 0 END + CASE WHEN contains(lower(source), '{t}') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(text), '{t}') THEN 1.0 ELSE 0 END)"
_score = f"least(({' + '.join(map(_hit, ('src3', 'ing', 'there')))}) / 9.0, 1.0)"


@entry("retrieval_scores", f"SELECT doc_id AS id, CAST({_score} AS DOUBLE) AS score FROM documents WHERE {_score} > 0")
def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.scored(_corpus(spark, sf_dir), "What is the src3 ing, there?").select("id", "score")


@entry("retrieval_topk", f"SELECT id, score FROM (SELECT doc_id AS id, CAST({_score} AS DOUBLE) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, id LIMIT 10")
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(_corpus(spark, sf_dir), "What is the src3 ing, there?", 10).select("id", "score")


# Datasets ----------------------------------------------------------------------------------------
@entry("dedup_prompts", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(text))")
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.first_of_prompt(R.table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


@entry("exact_overlap", "WITH k AS (SELECT DISTINCT source AS s, lower(trim(text)) AS t FROM documents) SELECT a.s AS split_a, b.s AS split_b, CAST(count(*) AS BIGINT) AS n FROM k a JOIN k b ON a.t = b.t AND a.s < b.s GROUP BY 1, 2")
def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.overlap_digests(R.table(spark, sf_dir, "documents"), "source", "text").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n"))


@entry("quota_fill", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) JOIN (SELECT source AS s, 5 + CAST(substr(source, 4) AS BIGINT) AS quota FROM documents GROUP BY source) ON source = s WHERE r <= quota")
def _quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents").select("doc_id", "source")
    quotas = d.select("source").distinct().withColumn("quota", F.lit(5) + F.substring("source", 4, 10).cast("long"))
    return dataset.fill_quotas(d, quotas, ["source"], "doc_id")


@entry("seeded_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 100")
def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.seeded_sample(R.table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 100)


@entry("category_pivot", "SELECT source, CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT) AS en, CAST(count(*) FILTER (WHERE lang = 'de') AS BIGINT) AS de, CAST(count(*) FILTER (WHERE lang = 'fr') AS BIGINT) AS fr, CAST(count(*) FILTER (WHERE lang = 'es') AS BIGINT) AS es FROM documents GROUP BY source")
def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.pivot_counts(R.table(spark, sf_dir, "documents").select("source", "lang"), "source", "lang", ["en", "de", "fr", "es"])


@entry("length_stats", "SELECT CAST(floor(max(length(text) / 3.8 + length(source) / 3.2 + 30)) AS BIGINT) AS longest, avg(CASE WHEN length(text) / 3.8 + length(source) / 3.2 + 30 <= 512 THEN 1.0 ELSE 0.0 END) AS share_512, CAST(floor(avg(length(text)) * 100 + 0.5) AS BIGINT) AS mean_prompt_x100, CAST(floor(avg(length(source)) * 100 + 0.5) AS BIGINT) AS mean_target_x100 FROM documents")
def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents").agg(*dataset.length_stats(F.col("text"), F.col("source")))


_SETS = "SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS w FROM documents"


@entry("jaccard_pairs", f"""WITH s AS ({_SETS}), e AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM s WHERE len(w) > 0), f AS (SELECT t, count(*) AS f FROM e GROUP BY t),
    r AS (SELECT doc_id, n, e.t, row_number() OVER (PARTITION BY doc_id ORDER BY f, e.t) AS k FROM e JOIN f ON e.t = f.t), p AS (SELECT * FROM r WHERE k <= n - ceil(92 * n / 100.0) + 1),
    c AS (SELECT DISTINCT a.doc_id AS id_a, b.doc_id AS id_b FROM p a JOIN p b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 92 * greatest(a.n, b.n))
    SELECT id_a, id_b FROM c JOIN s x ON x.doc_id = id_a JOIN s y ON y.doc_id = id_b WHERE 100 * len(list_intersect(x.w, y.w)) >= 92 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))""")
def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similar.similar_texts(d).select("id_a", "id_b")


@entry("entity_leak", "SELECT doc_id AS id, w AS name FROM documents, (SELECT 'the in' AS w UNION ALL SELECT 'der und') WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''), ' ') || ' ', ' ' || w || ' ')")
def _leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("the in",), ("der und",)], "name string")
    return dataset.contained(names, R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@entry("field_accuracy", "SELECT floor(avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END) * 10000 + 0.5) / 10000 AS value, floor(avg(CASE WHEN quality = toxic AND doc_id % 2 = 0 THEN 1 ELSE 0 END) * 10000 + 0.5) / 10000 AS exact FROM labels")
def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "labels").select(F.struct(F.col("quality").alias("value"), F.lit(0).alias("even")).alias("expected"), F.struct(F.col("toxic").alias("value"), (F.col("doc_id") % 2).cast("int").alias("even")).alias("found"))
    return dataset.field_accuracy(rows, ["value", "even"]).drop("even")


@entry("class_accuracy", "SELECT CAST(quality AS VARCHAR) AS class, CAST(count(*) FILTER (WHERE quality = toxic) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS total FROM labels GROUP BY quality")
def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("q"), F.col("toxic").cast("string").alias("t"))
    return dataset.class_accuracy(rows, "q", "t")


@entry("fidelity", "SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT regexp_matches(lower(trim(text)), 'average|avg|mean') AND role = 'user' THEN 'aggregation:AVG' END, CASE WHEN NOT regexp_matches(lower(trim(text)), 'all|every') THEN 'scope:ALL' END) AS errors FROM conversations")
def _fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = dataset.fidelity_errors(F.col("text"), aggregation=F.when(F.col("role") == "user", "AVG"), scope=F.lit("ALL"))
    return R.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(errors, ",").alias("errors"))


@entry("chat_format", "SELECT conv_id, turn, '<|im_start|>system\n' || role || '<|im_end|>\n<|im_start|>user\n' || text || '<|im_end|>\n<|im_start|>assistant\n' || CAST(conv_id AS VARCHAR) || '<|im_end|>\n' AS chat FROM conversations")
def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "conversations").select("conv_id", "turn", dataset.chat_text(F.col("role"), F.col("text"), F.col("conv_id").cast("string")).alias("chat"))


@entry("generate_prompts", """SELECT o_orderkey AS gen_idx, replace(replace('How much did {who} give {when}?', '{who}', (['Asha', 'Ravi', 'Meena'])[CAST(o_orderkey % 3 AS INT) + 1]), '{when}', (['today', 'this week'])[CAST((o_orderkey // 3) % 2 AS INT) + 1]) AS prompt FROM orders""")
def _generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.generated(R.table(spark, sf_dir, "orders"), "o_orderkey", "How much did {who} give {when}?", {"who": ["Asha", "Ravi", "Meena"], "when": ["today", "this week"]})


@entry("canonicalize", "SELECT o_orderkey, '[' || array_to_string(list_transform(list_sort(list_distinct([o_orderstatus, o_orderpriority, 'F'])), lambda x: '\"' || x || '\"'), ',') || ']' AS canonical FROM orders")
def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "orders").select("o_orderkey", dataset.canonical_list(F.array("o_orderstatus", "o_orderpriority", F.lit("F"))).alias("canonical"))


@entry("composition_counts", """WITH t AS (SELECT o_orderkey AS k FROM orders) SELECT CAST(count(*) FILTER (WHERE k % 2 = 0 AND k % 3 = 0) AS BIGINT) AS entity_plus_time,
    CAST(count(*) FILTER (WHERE k % 5 = 0 AND k % 3 = 0) AS BIGINT) AS payment_plus_time, CAST(count(*) FILTER (WHERE k % 7 = 0 AND k % 3 = 0) AS BIGINT) AS aggregation_plus_time,
    CAST(count(*) FILTER (WHERE k % 4 = 0 AND k % 7 = 0) AS BIGINT) AS filters_plus_aggregation, CAST(count(*) FILTER (WHERE k % 4 = 0 AND k % 2 = 0) AS BIGINT) AS and_logic,
    CAST(count(*) FILTER (WHERE k % 2 = 1) AS BIGINT) AS or_logic, CAST(count(*) FILTER (WHERE k % 11 = 0) AS BIGINT) AS group_by, CAST(count(*) FILTER (WHERE k % 13 = 0) AS BIGINT) AS having,
    CAST(count(*) FILTER (WHERE k % 2 = 0) AS BIGINT) AS order_by, CAST(count(*) FILTER (WHERE k % 3 = 0) AS BIGINT) AS "limit", CAST(count(*) FILTER (WHERE k % 17 = 0) AS BIGINT) AS conditional_queries,
    CAST(count(*) FILTER (WHERE k % 9 = 0) AS BIGINT) AS clarification, CAST(count(*) FILTER (WHERE k % 9 = 1) AS BIGINT) AS unsupported, CAST(count(*) FILTER (WHERE k % 19 = 0) AS BIGINT) AS read_write_hard_negatives,
    CAST(count(*) FILTER (WHERE k % 11 = 0 AND k % 7 = 0 AND k % 2 = 0 AND k % 3 = 0) AS BIGINT) AS multi_primitive_composition FROM t""")
def _composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    some = lambda n, v: F.when(k % n == 0, F.lit(v))
    items = lambda n, *v: F.when(k % n == 0, F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>"))
    targets = R.table(spark, sf_dir, "orders").select(
        some(2, "x").alias("entity"), some(3, "t").alias("time"), items(5, "AMOUNT_PAID").alias("select"), F.lit("LATEST").alias("paymentScope"), items(7, "SUM").alias("aggregations"),
        items(4, "a", "b").alias("filters"), F.when(k % 2 == 0, "AND").otherwise("OR").alias("filterLogic"), items(11, "FARMER_NAME").alias("groupBy"), some(13, "h").alias("havingFilter"), some(2, "o").alias("orderBy"),
        some(3, 1).alias("limit"), some(17, "c").alias("conditionalSpec"), F.when(k % 9 == 0, "CLARIFY").when(k % 9 == 1, "UNSUPPORTED").otherwise("QUERY").alias("type"), F.when(k % 19 == 0, "read_write_contrast").alias("category"),
    )
    return dataset.composition(targets)


@entry("extract_draft", f"""{_S} SELECT o_orderkey, CASE WHEN regexp_matches(text, '(?i)^([A-Za-z]+)\\s+(?:gave|delivered|brought|collected|supplied)') THEN 'no' ELSE split_part(text, ' ', 1) END AS name,
    regexp_extract(text, '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:litres?|liters?|ltr|l\\b)', 1) AS quantity, CAST(o_orderkey % 9 AS VARCHAR) || '.2' AS fat, '8.' || CAST(o_orderkey % 10 AS VARCHAR) AS snf,
    CASE WHEN contains(lower(text), 'paid') THEN 'PAID' ELSE 'PENDING' END AS status FROM s""")
def _draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("o_orderkey", X.draft(F.col("text")).alias("d")).select("o_orderkey", "d.*")


@entry("create_records", f"""{_S} SELECT o_orderkey, {_round("(o_orderkey % 90 + 0.5) * greatest(35.0 + greatest(o_orderkey % 9 + 0.2 - 3.5, 0.0) * 4 + greatest(8.0 + (o_orderkey % 10) / 10.0 - 8.0, 0.0) * 2, 30.0)")} AS payable_amount,
    CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'RECORDED_LOCALLY' ELSE 'PENDING' END AS payment_status FROM s""")
def _create(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _sentences(spark, sf_dir)
    t, key = F.col("text"), F.col("o_orderkey")
    rows = said.select("o_orderkey", key.cast("string").alias("id"), (key % 90 + 0.5).alias("quantity"), (key % 9 + F.lit(0.2)).alias("fat"), (F.lit(8.0) + (key % 10) / 10.0).alias("snf"), F.coalesce(X.payment(t)["status"], F.lit("PENDING")).alias("payment_status"))
    return catalog.create_record(rows, _now()).select("o_orderkey", "payable_amount", "payment_status")


farmer_entry(
    "get_or_create", lambda f: catalog.get_or_create(f, "  Asha   RAO's ", "new-1").unionByName(catalog.get_or_create(f, "Customer#000000002", "new-2")).unionByName(catalog.get_or_create(f, " ", "new-3")).select("farmer_id"),
    "SELECT 'new-1' AS farmer_id UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM reg WHERE normalized_name = 'customer 000000002') THEN '2' ELSE 'new-2' END",
)


@entry("streaming_dashboard", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY event_type")
def _streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.streaming import live

    schema = R.table(spark, sf_dir, "events").schema
    # Two levels: the stream keeps a row for each user and type, which spread over all tasks; types are summed from these.
    by_user = lambda df: df.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    figures = lambda df: df.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("user_id").alias("n_users"), C.half_up(F.sum("total")).alias("total"))
    return figures(live.once(spark, f"{sf_dir}/events.parquet", schema, by_user))


def _all() -> dict[str, tuple[Build, str | None]]:
    from tallyloom.operators import registry_many, registry_targets, registry_untried  # noqa: F401  (they enter their queries)

    return _ENTRIES


def queries() -> dict[str, Build]:
    return {n: b for n, (b, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _all().items() if s is not None}
