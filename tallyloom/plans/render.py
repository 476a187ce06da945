"""A compiled query's result in a sentence, for people. Rendering collects: the results it is for are one row or a few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.model import FIELDS, Aggregation, Query
from tallyloom.plans.compiler import Compiled

#: Groups that a sentence lists.
LISTED = 20
WORDS = {"SUM": "total", "AVG": "average", "MIN": "least", "MAX": "greatest"}


def amount(value: float | int | None, unit: str = "", places: int = 1) -> str:
    if value is None:
        return "none"
    if isinstance(value, int):
        return str(value)
    return f"₹{value:.2f}" if unit == "₹" else f"{value:.{places}f} {unit}".rstrip() if unit != "%" else f"{value:.{places}f}%"


def _told(a: Aggregation, value: float | int | None, default: str) -> str:
    spec = FIELDS[a.field or default]
    if a.type.startswith("COUNT"):
        return f"{value} {'records' if a.type == 'COUNT_RECORDS' else 'farmers'}"
    return f"{WORDS[a.type]} {spec.label.lower()} {amount(value, spec.unit, 2 if a.type == 'AVG' else 1)}"


def told(a: Aggregation, default: str = "QUANTITY") -> Column:
    """_told() for the column of an aggregation's values: label, number and unit of its field."""
    spec, value = FIELDS[a.field or default], F.col(a.name(default))
    if a.type.startswith("COUNT"):
        return F.concat_ws(" ", value.cast("string"), F.lit("records" if a.type == "COUNT_RECORDS" else "farmers"))
    number = F.format_string(f"%.{2 if a.type == 'AVG' and spec.unit != '₹' or spec.unit == '₹' else 1}f", value)
    shown = F.concat(F.lit("₹"), number) if spec.unit == "₹" else F.concat(number, F.lit("%" if spec.unit == "%" else f" {spec.unit}".rstrip()))
    return F.concat(F.lit(f"{WORDS[a.type]} {spec.label.lower()} "), F.when(value.isNull(), "none").otherwise(shown))


def group_texts(q: Query, made: Compiled) -> DataFrame:
    """What summary() says of each group, as a column `text` beside the group's key: for reports over all groups, however many there are."""
    a = q.aggregations[0] if q.aggregations else Aggregation("COUNT_RECORDS")
    which = f" had the {'lowest' if q.order and not q.order.descending else 'highest'}: " if q.limit == 1 else ": "
    return made.df.select("group_key", F.concat("display", F.lit(which), told(a), F.lit("." if q.limit == 1 else "")).alias("text"))


def summary(q: Query, made: Compiled) -> str:
    if made.status == "INVALID":
        return "The question can't be answered as it stands: " + "; ".join(made.errors) + "."
    if made.status == "AMBIGUOUS":
        return "Several names match: " + ", ".join(made.entity.candidates if made.entity else ()) + ". Which one is meant?"
    if made.status == "NOT_FOUND":
        return f"{q.mention} isn't in the registry."
    if made.status == "CLARIFY":
        return q.clarify_reason or ""
    if made.status == "UNSUPPORTED":
        return q.unsupported_reason or ""
    if made.df is None:
        return made.status.capitalize()
    rows = made.df.limit(LISTED + 1).collect()
    if not rows:
        return "No records match."
    first = rows[0]
    if made.kind == "exists":
        return f"Yes, {first['n']} records match." if first["exists"] else "No, no records match."
    if made.kind == "aggregate":
        default = lambda a: "FAT" if a.type == "AVG" else "QUANTITY"
        text = ", ".join(_told(a, first[a.name(default(a))], default(a)) for a in q.aggregations)
        return text[:1].upper() + text[1:] + "."
    if made.kind == "group":
        a = q.aggregations[0] if q.aggregations else Aggregation("COUNT_RECORDS")
        if q.limit == 1:
            which = "lowest" if q.order and not q.order.descending else "highest"
            return f"{first['display']} had the {which}: {_told(a, first[a.name()], 'QUANTITY')}."
        more = " and more" if len(rows) > LISTED else ""
        return "; ".join(f"{r['display']}: {_told(a, r[a.name()], 'QUANTITY')}" for r in rows[:LISTED]) + more + "."
    if made.kind == "conditional":
        if first["matched"]:
            return f"{first['farmer_name']} has been paid ({first['payment_method'] or 'CASH'}, {first['payment_reference'] or 'N/A'})."
        return f"{first['farmer_name']} hasn't been paid: {first['payment_status']}, {amount(first['payable_amount'], '₹')} due."
    if made.kind == "scope":
        if q.scope == "ALL":
            return f"All {first['n']} payments are completed." if first["all_paid"] else f"{first['n_pending']} of {first['n']} payments are pending."
        if q.scope == "ANY":
            return "At least one payment has been received." if first["any_paid"] else "No payment has been received."
        return f"The latest record of {first['farmer_name']} is {'paid' if first['paid'] else 'pending'}."
    return f"{'More than ' if len(rows) > LISTED else ''}{min(len(rows), LISTED)} records match."
