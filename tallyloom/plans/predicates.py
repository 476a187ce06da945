"""Filters as two-valued columns: a condition holds or doesn't, it is never null."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.model import COMPARISONS, FIELDS, Filter


_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")


def number(text: str | None) -> float | None:
    """A decimal number, outer spaces aside; what else float() reads (1_000, nan, inf) is none."""
    return float(text) if text is not None and _NUMBER.fullmatch(text.strip()) else None


def condition(f: Filter) -> Column:
    spec = FIELDS[f.field]
    c, no = F.col(spec.column), F.lit(False)
    text = F.lower(c.cast("string"))
    low = (f.value or "").lower()
    if f.op == "IS_NULL":
        return c.isNull()
    if f.op == "IS_NOT_NULL":
        return c.isNotNull()
    if f.op == "EQUALS":  # as text without case, numbers too
        return F.coalesce(text == low, no)
    if f.op == "NOT_EQUALS":
        return c.isNull() if f.value is None else F.coalesce(text != low, F.lit(True))
    if f.op == "CONTAINS":
        return F.coalesce(F.contains(text, F.lit(low)), no)
    as_number = F.unix_millis(c.cast("timestamp")).cast("double") if spec.temporal else c if spec.numeric else c.try_cast("double")
    least, most = number(f.value), number(f.secondary)
    if f.op == "IN_RANGE":
        return no if least is None or most is None else F.coalesce(as_number.between(least, most), no)
    if least is None:
        return no
    compare = {">": as_number > least, ">=": as_number >= least, "<": as_number < least, "<=": as_number <= least}
    return F.coalesce(compare[COMPARISONS[f.op]], no)


def group(filters: tuple[Filter, ...], any_of: bool) -> Column:
    parts = [condition(f) for f in filters]
    return reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), parts) if parts else F.lit(True)


def scope(org: str | None, worker: str | None) -> Column:
    """Rows without an owner, or of this organization and worker; None: no restriction."""
    out = F.lit(True)
    for column, mine in (("org_id", org), ("worker_id", worker)):
        if mine is not None:
            out = out & ((F.trim(F.coalesce(F.col(column), F.lit(""))) == "") | (F.col(column) == mine))
    return out


def entity(farmer_id: str | None, farmer_name: str) -> Column:
    by_id = F.coalesce(F.col("farmer_id") == farmer_id, F.lit(False)) if farmer_id is not None else F.lit(False)
    return by_id | (F.lower("farmer_name") == farmer_name.lower())
