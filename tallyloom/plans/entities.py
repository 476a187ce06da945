"""Entity resolution with three outcomes: RESOLVED, AMBIGUOUS, NOT_FOUND."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import NEW_CAPITAL, ONE_CAPITAL, capitalized, composed, name_tokens, normalized_name
from tallyloom.operators import patterns
from tallyloom.sources.scratch import written

#: Names that an ambiguous mention lists at most.
LISTED = 50


def normalize(name: str) -> str:
    text = re.sub(r"['’]s\b", "", unicodedata.normalize("NFC", name).lower())
    kept = "".join(ch if ch.isspace() or unicodedata.category(ch)[0] in "LN" else " " for ch in text)
    return " ".join(kept.split())


def tokens(normalized: str) -> list[str]:
    return [t for t in normalized.split(" ") if len(t) >= 2]


@dataclass(frozen=True)
class Resolution:
    status: str
    farmer_id: str | None = None
    farmer_name: str | None = None
    #: Names that fit, in order, at most LISTED of them; n_candidates counts them all.
    candidates: tuple[str, ...] = ()
    n_candidates: int = 0


def candidates(registry: DataFrame, mention: str) -> DataFrame:
    """Rows of the registry that match, with how: 1 equal, 2 one contains the other, 3 a token in common. Distributed; few rows."""
    asked = normalize(mention)
    name = F.col("normalized_name")
    # Only a registry with decomposed names pays for composing them.
    known = normalized_name(name if registry.where(name.rlike(r"\p{M}")).isEmpty() else composed(name))
    contains = F.contains(known, F.lit(asked)) | F.contains(F.lit(asked), known)
    shared = F.arrays_overlap(name_tokens(known), F.array(*map(F.lit, tokens(asked))).cast("array<string>"))
    how = F.when(known == asked, 1).when(contains, 2).when(shared, 3)
    return registry.where(F.col("is_active") & (known != "")).withColumn("match", how).where("match IS NOT NULL").withColumn("known", known)


def resolve(registry: DataFrame, mention: str) -> Resolution:
    """Equal names first; then containment, where a single longest name wins; then a token that one name alone has."""
    if not normalize(mention):
        return Resolution("NOT_FOUND")
    found = candidates(registry, mention)
    # The summary is one row.
    by = found.groupBy("match").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("farmer_id", "farmer_name")).alias("first"), F.max(F.length("known")).alias("longest")).orderBy("match").first()
    if by is None:
        return Resolution("NOT_FOUND")
    if by["match"] == 1 or by["n"] == 1:
        return Resolution("RESOLVED", by["first"]["farmer_id"], by["first"]["farmer_name"])
    alike = found.where(F.col("match") == by["match"])
    if by["match"] == 2:
        top = alike.where(F.length("known") == by["longest"]).limit(2).collect()
        if len(top) == 1:
            return Resolution("RESOLVED", top[0]["farmer_id"], top[0]["farmer_name"])
    listed = alike.select("farmer_name").orderBy("farmer_name").limit(LISTED).collect()
    return Resolution("AMBIGUOUS", candidates=tuple(r.farmer_name for r in listed), n_candidates=by["n"])


def _capitalized(token: str) -> str:
    """As the column of that name has it."""
    first = token[:1]
    large = first.upper()
    return (ONE_CAPITAL.get(first, first) if len(large) > 1 or first in NEW_CAPITAL else large) + token[1:]


def mention_in(text: str, names: list[str]) -> str | None:
    """The longest name that stands in a text as words; else the first of its tokens that some name has."""
    asked = normalize(text)
    for name in sorted(names, key=lambda n: -len(normalize(n))):
        if normalize(name) and re.search(rf"\b{re.escape(normalize(name))}\b", asked):
            return name
    known = {t for n in names for t in tokens(normalize(n))}
    return next((_capitalized(t) for t in tokens(asked) if t in known), None)


def _plain(c: Column, rows: DataFrame) -> Column:
    """The normalized name of a column; only decomposed texts pay for composing."""
    return normalized_name(c if rows.where(c.rlike(r"\p{M}")).isEmpty() else composed(c))


def resolve_all(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """For each distinct mention: status, farmer_id, farmer_name, how and n_candidates, as resolve() has them for one; a row a mention, and no pairs.

    how: 1 an equal name, 2 containment either way, 3 tokens in common; null where nothing fits. A
    resolved mention has the least (farmer_id, farmer_name) of those that win. n_candidates counts the
    names that fit; for how = 3 it is the number that the commonest of the mention's tokens has, which
    is the least there can be (2 at least, where it is ambiguous).

    Names inside mentions and mentions inside names are found by automata over the mentions and over
    the registry, in one scan each. Mentions inside names are counted by name length within tasks, so a
    mention that all names hold gives a few rows. Tokens meet by their counts and least and greatest names.
    """
    asks = mentions.select("mention").distinct()
    asks = written(asks.select("mention", F.coalesce(_plain(F.col("mention"), asks), F.lit("")).alias("asked")))
    name, here = F.struct("farmer_id", "farmer_name").alias("name"), registry.where("is_active")
    known = here.select(name, _plain(F.col("normalized_name"), here).alias("known")).where("known <> ''")
    asked = asks.select("asked").where("asked <> ''").distinct()

    by_name = known.groupBy("known").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    equal = written(asked.join(by_name, F.col("asked") == F.col("known")).select("asked", F.lit(1).alias("how"), F.lit(True).alias("won"), "name", "n"))
    open_ = asked.join(equal, "asked", "left_anti")
    inside = patterns.occurrences(open_, "asked", by_name, "known").join(by_name, "known").select("asked", F.length("known").alias("length"), "n", "name")
    around = patterns.counted(known, "known", "name", open_, "asked").select("asked", "length", "n", "name")
    by_length = inside.unionByName(around).groupBy("asked", "length").agg(F.sum("n").alias("n"), F.min("name").alias("name"))
    best = by_length.groupBy("asked").agg(F.sum("n").alias("n"), F.max_by(F.struct("n", "name"), "length").alias("top"))
    contained = written(best.select("asked", F.lit(2).alias("how"), (F.col("top.n") == 1).alias("won"), F.col("top.name").alias("name"), "n"))

    token = lambda c: F.explode(F.array_distinct(name_tokens(F.col(c)))).alias("token")
    tokens_ = known.select("name", token("known")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least"), F.max("name").alias("most"))
    left = open_.join(contained, "asked", "left_anti").select("asked", token("asked"))
    shared = left.join(tokens_, "token").groupBy("asked").agg(F.max("n").alias("n"), F.min("least").alias("name"), F.max("most").alias("most"))
    one = (F.col("n") == 1) & (F.col("name") == F.col("most"))
    by_token = shared.select("asked", F.lit(3).alias("how"), one.alias("won"), "name", F.when(one, F.lit(1)).otherwise(F.greatest("n", F.lit(2))).cast("long").alias("n"))

    answers = equal.unionByName(contained).unionByName(by_token)
    out = asks.join(answers, "asked", "left")
    status = F.when(F.col("how").isNull(), "NOT_FOUND").when(F.col("won"), "RESOLVED").otherwise("AMBIGUOUS")
    return out.select("mention", status.alias("status"), F.when(F.col("won"), F.col("name.farmer_id")).alias("farmer_id"), F.when(F.col("won"), F.col("name.farmer_name")).alias("farmer_name"), "how", F.coalesce("n", F.lit(0)).alias("n_candidates"))


def mentions_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(key, mention) of each text, as mention_in() has it for one: the longest name that stands in it as words, else the first of its tokens that some name has, capitalized; else null.

    texts: key (unique), text; names: name. Of equally long names the least wins.
    """
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    asked = written(texts.select("key", F.coalesce(spaced(_plain(F.col("text"), texts)), F.lit("")).alias("asked")))
    known = names.select("name", _plain(F.col("name"), names).alias("known")).where("known <> ''")
    by_known = known.groupBy(spaced(F.col("known")).alias("known")).agg(F.min("name").alias("name"))
    whole = written(patterns.longest(asked, "key", "asked", by_known, "known").join(by_known, "known").select("key", F.col("name").alias("mention")))
    tokens_ = known.select(F.explode(name_tokens(F.col("known"))).alias("token")).distinct().select(spaced(F.col("token")).alias("token"))
    first = patterns.earliest(asked.join(whole, "key", "left_anti"), "key", "asked", tokens_, "token").select("key", capitalized(F.trim("token")).alias("mention"))
    return texts.select("key").join(whole.unionByName(first), "key", "left")


#: Names that have a common token, in one part of those that meet its mentions.
DEALT = 4096


def match_all(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """(mention, farmer_id) of every shared token, each pair once: set-at-a-time, an equi-join of exploded tokens.

    A pair is put out at the commonest token that it shares, so that pairs aren't shuffled to be told
    apart. Names of a token that more than DEALT of them have are dealt over parts, and mentions meet each.
    """
    words = lambda c: F.array_distinct(name_tokens(c))
    known = registry.select("farmer_id", words(F.col("normalized_name")).alias("w")).groupBy("farmer_id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w"))
    known = written(known.where(F.size("w") > 0))
    names = known.select("farmer_id", "w", F.explode("w").alias("token"))
    many = names.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    common = written(many.where(F.col("n") > DEALT).select("token", F.ceil(F.col("n") / DEALT).alias("parts")))  # one row at most for each DEALT tokens of the registry
    names = names.join(F.broadcast(common), "token", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("farmer_id"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    asked = mentions.select("mention").distinct()
    asked = asked.select("mention", F.explode(words(normalized_name(composed(F.col("mention"))))).alias("token")).join(many, "token")
    asked = asked.groupBy("mention").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "token"))).alias("t"))
    asked = asked.select("mention", F.col("t.token").alias("t"), F.posexplode("t").alias("at", "own"))
    parts = F.when(-F.col("own.n") > DEALT, F.ceil(-F.col("own.n") / DEALT)).otherwise(F.lit(1).cast("long"))
    asked = asked.select("mention", F.col("own.token").alias("token"), F.when(F.col("at") > 0, F.slice("t", F.lit(1), F.col("at"))).alias("before"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return asked.join(names, ["token", "part"]).where(F.col("before").isNull() | ~F.arrays_overlap("before", "w")).select("mention", "farmer_id")
