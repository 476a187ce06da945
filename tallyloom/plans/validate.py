"""Checks that collect every error: of a query, on the driver; of records, as an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.model import AGGREGATIONS, COMPARISONS, FIELDS, OPERATORS, Query
from tallyloom.plans.temporal import parse_date


def query_errors(q: Query) -> list[str]:
    if q.request == "CLARIFY":
        return [] if q.clarify_reason else ["CLARIFY needs a reason"]
    if q.request == "UNSUPPORTED":
        return [] if q.unsupported_reason else ["UNSUPPORTED needs a reason"]
    if q.request == "WRITE":
        return [f"WRITE needs {k}" for k in ("farmerName", "quantity") if not q.write_args.get(k, "").strip()]
    out = []
    if q.target == "KNOWLEDGE_BASE" and not (q.knowledge or "").strip():
        out.append("KNOWLEDGE_BASE needs a text")
    if q.specific and not (q.mention or "").strip():
        out.append("SPECIFIC needs a mention")
    numeric = lambda f: f is None or FIELDS[f].numeric
    out += [f"{a.type} needs a numeric field, not {a.field}" for a in q.aggregations if a.type not in AGGREGATIONS or a.type[:5] != "COUNT" and not numeric(a.field)]
    for f in q.filters:
        spec, value = FIELDS[f.field], f.value
        measured = spec.numeric or spec.temporal
        if f.op not in OPERATORS:
            out.append(f"unknown operator {f.op}")
        elif f.op == "IN_RANGE" and (value is None or f.secondary is None or not measured):
            out.append(f"IN_RANGE needs two bounds and a measured field: {f.field}")
        elif f.op in COMPARISONS and (value is None or not measured):
            out.append(f"{f.op} needs a value and a measured field: {f.field}")
        elif f.op == "CONTAINS" and (measured or not (value or "").strip()):
            out.append(f"CONTAINS needs a text field and a value: {f.field}")
        elif f.op in ("EQUALS", "NOT_EQUALS") and value is None:
            out.append(f"{f.op} needs a value: {f.field}")
    out += [f"can't group by {g}" for g in q.group_by if not FIELDS[g].groupable]
    if q.having:
        if not q.group_by:
            out.append("HAVING needs GROUP BY")
        if not numeric(q.having.field):
            out.append("HAVING needs a numeric field")
        if q.having.op not in (*COMPARISONS, "EQUALS"):
            out.append(f"HAVING can't use {q.having.op}")
    if q.order and q.order.aggregation:
        if not q.group_by or not q.aggregations:
            out.append("ORDER BY an aggregate needs GROUP BY and an aggregation")
    elif q.order and q.order.field and not FIELDS[q.order.field].sortable:
        out.append(f"can't sort by {q.order.field}")
    if q.time and q.time.kind != "RELATIVE":
        days = [parse_date(d or "") for d in (q.time.start, q.time.end or q.time.start)]
        if None in days:
            out.append("not a date")
        elif days[0] > days[1]:  # type: ignore[operator]
            out.append("the range ends before it starts")
    if q.limit is not None and q.limit <= 0:
        out.append("LIMIT must be positive")
    return out


def record_errors(name: Column, quantity: Column, fat: Column, snf: Column, status: Column, method: Column, reference: Column) -> Column:
    """Array of all errors of a record that is given as text."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    value = lambda c: c.cast("string").try_cast("double")
    bad_share = lambda c: value(c).isNull() | (value(c) < 0) | (value(c) > 15)
    state, way = F.upper(text(status)), F.upper(text(method))
    paid = state.isin("PAID", "RECORDED_LOCALLY", "COMPLETE", "SETTLED")
    rules = [
        (F.length(text(name)) < 2, "name"),
        (value(quantity).isNull() | (value(quantity) <= 0) | (value(quantity) > 1000), "quantity"),
        (bad_share(fat), "fat"),
        (bad_share(snf), "snf"),
        (~(paid | (state == "PENDING")), "status"),
        (paid & way.isin("UPI", "BANK_TRANSFER", "BANK") & (text(reference) == ""), "reference"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(what)) for bad, what in rules)))


def split_valid(records: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their errors)."""
    checked = records.withColumn("errors", errors)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
