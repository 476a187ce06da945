"""Numbers, names and payments from free text, as SQL regular expressions over a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.columns import capitalized

# Patterns, tried in order.
NUMBER = r"(\d+(?:\.\d+)?)"
QUANTITY = [NUMBER + r"\s*(?:litres?|liters?|ltrs?|ltr|l\b)", r"(?:gave|collected|delivered|record)\s+" + NUMBER, r"quantity\s*[:=]?\s*" + NUMBER]
FAT = [r"fat\s*[:=]?\s*" + NUMBER + r"\s*%?", NUMBER + r"\s*%\s*fat\b", NUMBER + r"\s*fat\b"]
SNF = [r"snf\s*[:=]?\s*" + NUMBER + r"\s*%?", NUMBER + r"\s*%\s*snf\b", NUMBER + r"\s*snf\b"]
NAME = [r"([A-Za-z]+)\s+gave", r"(?:record|add|for)\s+([A-Za-z]+)"]
NOT_NAMES = ["milk", "record", "collection", "today"]
SPOKEN_NAME = r"^([A-Za-z]+)\s+(?:gave|delivered|brought|collected|supplied)"


def first_match(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that is found; null if none is."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in patterns))


def quantity(text: Column) -> Column:
    return first_match(text, QUANTITY)


def fat(text: Column) -> Column:
    return first_match(text, FAT)


def snf(text: Column) -> Column:
    return first_match(text, SNF)


def reconciled(raw: Column, given: Column) -> Column:
    """The text's number where the given one is missing, shorter, or has lost its point; a given zero without support in the text is dropped."""
    given = F.trim(given)
    better = given.isNull() | (F.contains(raw, F.lit(".")) & ~F.contains(given, F.lit("."))) | (F.length(raw) > F.length(given))
    return F.when(raw.isNotNull(), F.when(better, raw).otherwise(given)).when(given.isNotNull() & ~given.isin("0", "0.0"), given)


def name(text: Column, given: Column) -> Column:
    found = first_match(text, NAME)
    usable = found.isNotNull() & ~F.lower(found).isin(*NOT_NAMES)
    return F.when(F.trim(F.coalesce(given, F.lit(""))) != "", given).when(usable, capitalized(found))


def payment(text: Column) -> Column:
    """struct(method, status) by keywords, the first that is found."""
    low = F.lower(text)
    has = lambda w: F.contains(low, F.lit(w))
    pair = lambda m, s: F.struct(F.lit(m).cast("string").alias("method"), F.lit(s).cast("string").alias("status"))
    done = "RECORDED_LOCALLY"
    return (
        F.when(has("cash"), pair("CASH", done)).when(has("upi"), pair("UPI", done)).when(has("bank"), pair("BANK_TRANSFER", done))
        .when(has("pending") | has("unpaid") | has("due"), pair(None, "PENDING")).when(has("paid"), pair(None, done)).otherwise(pair(None, None))
    )


def draft(text: Column) -> Column:
    """A record's draft from a spoken sentence: struct(name, quantity, fat, snf, status)."""
    clean = F.trim(text)
    either = lambda w: F.coalesce(F.nullif(F.regexp_extract(clean, rf"(?i)(?:{w}\s*[:=]?\s*{NUMBER}|{NUMBER}\s*{w})", 1), F.lit("")), F.regexp_extract(clean, rf"(?i)(?:{w}\s*[:=]?\s*{NUMBER}|{NUMBER}\s*{w})", 2))
    spoken = F.coalesce(F.nullif(F.regexp_extract(clean, "(?i)" + SPOKEN_NAME, 1), F.lit("")), F.substring_index(clean, " ", 1))
    return F.struct(
        capitalized(spoken).alias("name"),
        F.regexp_extract(clean, "(?i)" + NUMBER + r"\s*(?:litres?|liters?|ltr|l\b)", 1).alias("quantity"),
        either("fat").alias("fat"), either("snf").alias("snf"),
        F.when(F.contains(F.lower(clean), F.lit("paid")), "PAID").otherwise("PENDING").alias("status"),
    )
