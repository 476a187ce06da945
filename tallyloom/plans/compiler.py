"""A query, resolved and compiled into one lazy DataFrame.

Order of work: session scope, entity, period, filters; then the first of: existence, grouping,
(order, limit, aggregation), conditional report, payment scope, plain rows. Null counts as 0 in
aggregates, and averages divide by all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import effective_paid, effective_payable, half_up, is_paid, or_zero
from tallyloom.model import COMPARISONS, FIELDS, Aggregation, Query
from tallyloom.plans import predicates, temporal
from tallyloom.plans.entities import Resolution, resolve
from tallyloom.plans.validate import query_errors


@dataclass(frozen=True)
class Compiled:
    """status OK, INVALID, CLARIFY, UNSUPPORTED, WRITE, KNOWLEDGE, CONFIG, AMBIGUOUS or NOT_FOUND; df only where OK."""

    status: str
    kind: str = ""
    df: DataFrame | None = None
    errors: tuple[str, ...] = ()
    entity: Resolution | None = None


def aggregate(a: Aggregation, default: str = "QUANTITY") -> Column:
    if a.type == "COUNT_RECORDS":
        return F.count(F.lit(1))
    if a.type == "COUNT_DISTINCT_FARMERS":
        return F.countDistinct(F.when(F.trim("farmer_id") != "", F.col("farmer_id")))
    value = or_zero(FIELDS[a.field or default].column)
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[a.type](value)


def _rounded(a: Aggregation, c: Column) -> Column:
    return half_up(c) if a.type in ("SUM", "AVG") else c


def sort_keys(field: str, descending: bool) -> list[Column]:
    """Total order: the field with null as least value, names without case, then newest, then id."""
    spec = FIELDS[field]
    c = F.col(spec.column)
    key = or_zero(c) if spec.numeric else c if spec.temporal else F.coalesce(F.lower(c), F.lit(""))
    return [key.desc_nulls_last() if descending else key.asc_nulls_first(), F.desc("created_at"), F.asc("id")]


def group_key(field: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(FIELDS[field].column).cast("string"))), F.lit("unknown"))


def _grouped(q: Query, rows: DataFrame) -> DataFrame:
    aggregations = q.aggregations or (Aggregation("COUNT_RECORDS"),)
    keys = [group_key(g).alias("group_key" if i == 0 else f"group_key_{i + 1}") for i, g in enumerate(q.group_by)]
    first = F.col(FIELDS[q.group_by[0]].column)
    # The raw value of the newest row stands for the group; ties by the value itself.
    named = F.max(F.struct(F.col("created_at").alias("t"), first.alias("v")))["v"]
    columns = {a.name(): _rounded(a, aggregate(a)) for a in aggregations}
    order = q.order
    ranking = None
    if order and order.aggregation:
        ranking = Aggregation(order.aggregation, order.field or aggregations[0].field)
    having = Aggregation(q.having.aggregation, q.having.field) if q.having else None
    hidden = {f"_{n}": _rounded(a, aggregate(a)) for n, a in (("rank", ranking), ("having", having)) if a}
    out = rows.groupBy(*keys).agg(F.coalesce(named.cast("string"), F.lit("Unknown")).alias("display"), *(c.alias(n) for n, c in {**columns, **hidden}.items()))
    if q.having:
        h, v = F.col("_having"), F.lit(q.having.value)
        compare = {">": h > v, ">=": h >= v, "<": h < v, "<=": h <= v}
        out = out.where(compare[COMPARISONS[q.having.op]] if q.having.op in COMPARISONS else h == v)
    if q.limit:
        by = F.col("_rank") if ranking else F.lower("display") if order else F.col(aggregations[0].name())
        out = out.orderBy(by.desc() if not order or order.descending else by.asc(), "group_key").limit(q.limit)
    return out.drop("_rank", "_having")


def members(q: Query, rows: DataFrame) -> DataFrame:
    """The rows of the groups that a grouped query keeps."""
    kept = _grouped(q, rows).select(F.col("group_key").alias("_kept"))
    return rows.join(kept, group_key(q.group_by[0]) == F.col("_kept"), "left_semi")


def _ordered(q: Query, rows: DataFrame) -> DataFrame:
    order = q.order.field if q.order and q.order.field else None
    if not (order or q.limit):
        return rows
    ranked = rows.orderBy(*(sort_keys(order, q.order.descending) if order else sort_keys("CREATED_AT", True)))  # type: ignore[union-attr]
    return ranked.limit(q.limit) if q.limit else ranked


def latest(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), F.asc("id")).limit(1)


def _conditional(q: Query, rows: DataFrame) -> DataFrame:
    c = q.conditional
    assert c
    value = F.lower(F.coalesce(F.col(FIELDS[c.field].column).cast("string"), F.lit("")))
    expected = [c.expected.lower()] + (["recorded_locally"] if c.field == "PAYMENT_STATUS" and c.expected.upper() == "PAID" else [])
    last = latest(rows).withColumn("matched", value.isin(*expected))
    cells = [F.when(F.col("matched") == (f in c.on_match), F.col(FIELDS[f].column)).alias(FIELDS[f].column) if (f in c.on_match) != (f in c.on_mismatch) else F.col(FIELDS[f].column) for f in dict.fromkeys((*c.on_match, *c.on_mismatch))]
    return last.select("id", "farmer_name", "matched", *cells)


def _scoped(scope: str, rows: DataFrame) -> DataFrame:
    if scope == "LATEST":
        return latest(rows).select("id", "farmer_name", "payment_status", "payment_method", "payment_reference", is_paid().alias("paid"))
    pending = F.count_if(F.col("payment_status") == "PENDING").alias("n_pending")
    flag = F.every(is_paid()).alias("all_paid") if scope == "ALL" else F.bool_or(is_paid()).alias("any_paid")
    return rows.agg(F.count(F.lit(1)).alias("n"), flag, pending).where("n > 0")


def filtered(q: Query, relation: DataFrame, as_of: datetime, found: Resolution | None = None, org: str | None = None, worker: str | None = None) -> DataFrame:
    rows = relation.where(predicates.scope(org, worker))
    if found:
        rows = rows.where(predicates.entity(found.farmer_id, found.farmer_name or ""))
    if q.time:
        rows = rows.where(temporal.within("created_at", *temporal.bounds(q.time, as_of)))
    return rows.where(predicates.group(q.filters, q.any_filter))


def compile(q: Query, relation: DataFrame, as_of: datetime, registry: DataFrame | None = None, org: str | None = None, worker: str | None = None) -> Compiled:
    if errors := query_errors(q):
        return Compiled("INVALID", errors=tuple(errors))
    if q.request != "QUERY":
        return Compiled(q.request)
    if q.target != "MILK_RECORDS":
        return Compiled("KNOWLEDGE" if q.target == "KNOWLEDGE_BASE" else "CONFIG")
    found = None
    if q.specific:
        found = resolve(registry, q.mention or "") if registry is not None else Resolution("NOT_FOUND")
        if found.status != "RESOLVED":
            return Compiled(found.status, entity=found)
    rows = filtered(q, relation, as_of, found, org, worker)
    if q.exists:
        kind, df = "exists", rows.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") > 0).alias("exists"), "n")
    elif q.group_by:
        kind, df = "group", _grouped(q, rows)
    elif q.aggregations:
        default = lambda a: "FAT" if a.type == "AVG" else "QUANTITY"
        cells = [_rounded(a, aggregate(a, default(a))).alias(a.name(default(a))) for a in q.aggregations]
        kind, df = "aggregate", _ordered(q, rows).agg(F.count(F.lit(1)).alias("_n"), *cells).where("_n > 0").drop("_n")
    elif q.conditional:
        kind, df = "conditional", _conditional(q, rows)
    elif q.scope:
        kind, df = "scope", _scoped(q.scope, rows)
    else:
        kind, df = "rows", _ordered(q, rows)
        if q.select:
            df = df.select("id", *(FIELDS[f].column for f in q.select))
    return Compiled("OK", kind, df, entity=found)


def payment_totals(rows: DataFrame) -> DataFrame:
    """Paid and pending amounts, the latest payment and the number of records in one pass."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        half_up(F.coalesce(F.sum(F.when(is_paid(), effective_paid())), F.lit(0.0))).alias("paid_total"),
        half_up(F.coalesce(F.sum(F.when(~is_paid(), effective_payable())), F.lit(0.0))).alias("pending_total"),
        F.max("payment_timestamp").alias("last_payment"),
    )
