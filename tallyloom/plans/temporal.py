"""Periods as half-open ranges [start, end) of naive timestamps, resolved on the driver from an explicit as_of."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.model import PERIODS, Period

DAY, MS = timedelta(days=1), timedelta(milliseconds=1)
DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d")
#: A day in a text.
DAY_IN_TEXT = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}"
# What a period is called in a text or by a model, tried in order.
IN_TEXT = (
    ("LAST_SUNDAY", ("last sunday", "on sunday", "past sunday")), ("SINCE_MONDAY", ("since monday", "from monday")), ("THIS_WEEK", ("this week", "weekly")),
    ("LAST_WEEK", ("last week", "previous week")), ("THIS_MONTH", ("this month", "monthly")), ("LAST_MONTH", ("last month", "previous month")),
    ("YESTERDAY", ("yesterday",)), ("TODAY", ("today",)),
)
IN_TOKEN = (
    ("TODAY", ("TODAY",)), ("YESTERDAY", ("YESTERDAY",)), ("THIS_WEEK", ("THIS_WEEK", "WEEKLY")), ("LAST_WEEK", ("LAST_WEEK", "PREVIOUS_WEEK")),
    ("THIS_MONTH", ("THIS_MONTH", "MONTHLY")), ("LAST_MONTH", ("LAST_MONTH", "PREVIOUS_MONTH")), ("SINCE_MONDAY", ("SINCE_MONDAY", "FROM_MONDAY")), ("LAST_SUNDAY", ("SUNDAY",)),
)


def parse_date(text: str) -> date | None:
    """Strictly one of the accepted forms, digits in full."""
    for form in DATE_FORMATS:
        try:
            found = datetime.strptime(text, form)
        except ValueError:
            continue
        if found.strftime(form) == text:
            return found.date()
    return None


def parse_token(token: str) -> str | None:
    name = token.strip().upper().replace(" ", "_")
    return name if name in PERIODS else next((p for p, words in IN_TOKEN if any(w in name for w in words)), None)


def from_text(text: str) -> Period | None:
    """A date in the text, else the first period named."""
    if m := re.search(DAY_IN_TEXT, text, re.A):
        return Period("DATE", None, m[0])
    found = next((p for p, words in IN_TEXT if any(w in text.lower() for w in words)), None)
    return Period("RELATIVE", found) if found else None


def token_period(token: Column) -> Column:
    """parse_token() for a column."""
    name = F.replace(F.upper(F.trim(token)), F.lit(" "), F.lit("_"))
    found = F.when(name.isin(list(PERIODS)), name)
    for p, words in IN_TOKEN:
        found = found.when(reduce(or_, (F.contains(name, F.lit(w)) for w in words)), p)
    return found


def text_period(text: Column) -> Column:
    """from_text() for a column: struct(kind, period, start); null where no period is named."""
    day = F.regexp_extract(text, DAY_IN_TEXT, 0)
    low = F.lower(text)
    made = lambda kind, period, start: F.struct(F.lit(kind).alias("kind"), F.lit(period).cast("string").alias("period"), start.cast("string").alias("start"))
    found = F.when(day != "", made("DATE", None, day))
    for p, words in IN_TEXT:
        found = found.when(reduce(or_, (F.contains(low, F.lit(w)) for w in words)), made("RELATIVE", p, F.lit(None)))
    return found


def bounds(p: Period, as_of: datetime) -> tuple[datetime, datetime]:
    """[start, end) of a period. Weeks begin on Monday; this week and this month run to a day after as_of."""
    today = datetime.combine(as_of.date(), time())
    monday, first = today - DAY * today.weekday(), today.replace(day=1)
    if p.kind != "RELATIVE":
        start, end = parse_date(p.start or ""), parse_date(p.end or p.start or "")
        if start is None or end is None:
            raise ValueError(f"not a date: {p.start} {p.end or ''}".rstrip())
        return datetime.combine(start, time()), datetime.combine(end, time()) + DAY
    return {
        "TODAY": (today, today + DAY),
        "YESTERDAY": (today - DAY, today),
        "THIS_WEEK": (monday, as_of + DAY + MS),
        "SINCE_MONDAY": (monday, as_of + DAY + MS),
        "LAST_WEEK": (monday - 7 * DAY, monday),
        "THIS_MONTH": (first, as_of + DAY + MS),
        "LAST_MONTH": ((first - DAY).replace(day=1), first),
        "LAST_SUNDAY": ((last := today - DAY * ((today.weekday() + 1) % 7)), last + DAY),
    }[p.period or ""]


def within(column: str, start: datetime, end: datetime) -> Column:
    """Plain comparisons with literals, so that they reach the Parquet scan."""
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return (F.col(column) >= at(start)) & (F.col(column) < at(end))
