"""Quality of text-to-query datasets: quotas, repeats, leakage between splits, audits, field-level metrics."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.patterns import occurrences
from tallyloom.sources.scratch import written

#: Letters, digits and underscore of any script.
WORDS = r"[^\p{L}\p{N}_]+"
#: Parts of a group that are ranked apart.
PARTS = 32


def norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def first_of_prompt(df: DataFrame, prompt: str, order: str) -> DataFrame:
    """Of rows with one normalized prompt, that of the least order stays (order is unique; null prompts leave). Only digests and orders are shuffled, not texts."""
    first = df.where(F.col(prompt).isNotNull()).groupBy(F.md5(norm(F.col(prompt)).cast("binary")).alias("_p")).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def fill_quotas(df: DataFrame, quotas: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first `quota` rows of each group, by order.

    A group is ranked in PARTS first, each to the largest quota (a literal, which limits the sort),
    so that the window over the whole group sees at most PARTS times that many rows.
    """
    most = quotas.agg(F.max("quota")).first()[0] or 0
    rank = lambda *more: F.row_number().over(Window.partitionBy(*keys, *more).orderBy(order))
    first = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(PARTS))).withColumn("_r", rank("_part")).where(F.col("_r") <= most)
    return first.withColumn("_r", rank()).where(F.col("_r") <= most).join(quotas, keys).where("_r <= quota").drop("_r", "_part", "quota")


def numbered(df: DataFrame, order: list[str], column: str = "number") -> DataFrame:
    """df with row numbers 0 ... n - 1 by `order`: written in ranges, counted by range, and numbered within each. Only one count for each range is gathered."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # one row for each range
    first, starts = 0, []
    for r in sizes:
        starts.append((r["_part"], first))
        first += r.n
    base = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _first long"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_part", part).join(base, "_part").withColumn(column, F.col("_first") + within).drop("_part", "_first", "_id")


#: Rounds of the permutation, most steps that a number is walked back into range, and a prime below 2**31 for its mixing.
ROUNDS, STEPS, PRIME = 6, 64, 2_147_483_647


def permuted(number: Column, n: int, seed: int = 42) -> Column:
    """A keyed permutation of 0 ... n - 1: each number's place in a shuffle, worked out from the number alone.

    A Feistel network on a grid of a columns and b rows, a * b barely above n; what falls beyond n is put
    through again until it doesn't. The same places wherever and in whatever order rows are read.
    """
    if n < 1 or n >= 1 << 52:
        raise ValueError(f"can't permute {n} numbers")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    keys = [int.from_bytes(hashlib.sha256(f"{seed}:{r}".encode()).digest()[:4], "big") % PRIME for r in range(ROUNDS)]

    def mixed(x: Column, r: int) -> Column:
        y = (x + keys[r]) % PRIME
        return (y * y % PRIME) * (keys[r - 1] | 1) % PRIME

    def left(r: int):
        return lambda p: F.struct(((p["l"] + mixed(p["r"], r)) % a).alias("l"), p["r"].alias("r"))

    def right(r: int):
        return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + mixed(p["l"], r)) % b).alias("r"))

    def once(x: Column) -> Column:
        pairs = F.array(F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r")))
        for r in range(0, ROUNDS, 2):
            pairs = F.transform(F.transform(pairs, left(r)), right(r + 1))
        pair = F.get(pairs, F.lit(0))
        return pair["l"] + pair["r"] * a

    walk = lambda x, _: F.when(x < n, x).otherwise(once(x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(a, STEPS))), once(number.cast("long")), walk)


def shuffled(df: DataFrame, number: str, seed: int = 42, n: int | None = None) -> DataFrame:
    """df with `position`, a row's place in the shuffle. number: a column of row numbers 0 ... n - 1 (counted if n isn't given).

    No row moves for that: nothing is sorted or exchanged. To have rows in that order, write them in
    shards by floor(position / size).
    """
    n = df.count() if n is None else n
    return df.withColumn("position", permuted(F.col(number), n, seed) if n else F.lit(None).cast("long"))


def seeded_sample(df: DataFrame, keys: list[str], key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows of each group by an MD5 of seed and key: the same rows wherever it runs."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def exact_overlaps(df: DataFrame, split: str, text: str) -> DataFrame:
    """(split_a, split_b, text): normalized texts that two splits share. Digests meet; only shared texts are shuffled."""
    shared = overlap_digests(df, split, text)
    own = df.select(F.col(split).alias("split_a"), norm(F.col(text)).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    return own.join(shared, ["split_a", "digest"]).dropDuplicates(["split_a", "split_b", "digest"]).select("split_a", "split_b", "text")


def overlap_digests(df: DataFrame, split: str, text: str) -> DataFrame:
    """(split_a, split_b, digest) of the normalized texts that two splits share. A digest's splits stand in one row; null texts leave."""
    known = df.where(F.col(text).isNotNull()).groupBy(F.md5(norm(F.col(text)).cast("binary")).alias("digest")).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    later = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return known.select("digest", F.inline(later)).select("split_a", "split_b", "digest")


def token_set(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), WORDS), ""))


def contained(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, name) where the words of a name stand in a row in a text: words are set apart by single spaces on both sides, and all names are looked for in one pass."""
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(F.array_remove(F.split(F.lower(c), WORDS), ""), " "), F.lit(" "))
    known = names.select("name", spaced(F.col("name")).alias("_spaced")).where(F.trim("_spaced") != "").distinct()
    met = occurrences(texts.select("id", spaced(F.col("text")).alias("_text")), "_text", known, "_spaced")
    return met.select("id", "_spaced").distinct().join(known, "_spaced").select("id", "name")


def pivot_counts(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0)


def length_stats(prompt: Column, target: Column) -> list[Column]:
    """Estimated tokens: the longest, the share within 512, and mean lengths."""
    estimate = F.length(prompt) / 3.8 + F.length(target) / 3.2 + 30
    return [F.floor(F.max(estimate)).alias("longest"), (F.count_if(estimate <= 512) / F.count(F.lit(1))).alias("share_512"), F.floor(F.avg(F.length(prompt)) * 100 + 0.5).alias("mean_prompt_x100"), F.floor(F.avg(F.length(target)) * 100 + 0.5).alias("mean_target_x100")]


# What the composition audit counts, as SQL over the columns of a target.
COMPOSITION = {
    "entity_plus_time": "entity IS NOT NULL AND time IS NOT NULL",
    "payment_plus_time": "(exists(select, s -> contains(s, 'PAYMENT') OR contains(s, 'AMOUNT')) OR paymentScope IN ('ALL', 'ANY')) AND time IS NOT NULL",
    "aggregation_plus_time": "size(aggregations) > 0 AND time IS NOT NULL",
    "filters_plus_aggregation": "size(filters) > 0 AND size(aggregations) > 0",
    "and_logic": "filterLogic = 'AND' AND size(filters) > 1",
    "or_logic": "filterLogic = 'OR'",
    "group_by": "size(groupBy) > 0",
    "having": "havingFilter IS NOT NULL",
    "order_by": "orderBy IS NOT NULL",
    "limit": "limit IS NOT NULL",
    "conditional_queries": "conditionalSpec IS NOT NULL",
    "clarification": "type = 'CLARIFY'",
    "unsupported": "type = 'UNSUPPORTED'",
    "read_write_hard_negatives": "category = 'read_write_contrast'",
    "multi_primitive_composition": "size(groupBy) > 0 AND size(aggregations) > 0 AND orderBy IS NOT NULL AND limit IS NOT NULL AND time IS NOT NULL",
}


def composition(targets: DataFrame) -> DataFrame:
    return targets.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in COMPOSITION.items()))


# Words of which a prompt must hold one, by what its target says.
SIGNS = {
    ("type", "WRITE"): ["record", "add", "mark", "save", "log"],
    ("type", "UNSUPPORTED"): ["why was", "why did", "what caused", "what if", "reason"],
    ("aggregation", "SUM"): ["total", "sum", "how much", "how many litres", "all", "most", "peak", "given", "give", "supplied", "deliver", "collection", "qty", "quantity", "milk"],
    ("aggregation", "AVG"): ["average", "avg", "mean"],
    ("aggregation", "MIN"): ["min", "lowest", "smallest", "minimum"],
    ("aggregation", "MAX"): ["max", "highest", "peak", "maximum", "largest"],
    ("aggregation", "COUNT_RECORDS"): ["how many collections", "how many deliveries", "how many times", "count", "number of deliveries", "entry count"],
    ("aggregation", "COUNT_DISTINCT_FARMERS"): ["how many farmers", "distinct farmers", "unique farmers", "farmers covered"],
    ("period", "TODAY"): ["today"],
    ("period", "YESTERDAY"): ["yesterday"],
    ("period", "THIS_WEEK"): ["this week", "weekly", "week"],
    ("period", "LAST_WEEK"): ["last week"],
    ("period", "THIS_MONTH"): ["this month", "monthly", "month"],
    ("period", "LAST_MONTH"): ["last month"],
    ("period", "SINCE_MONDAY"): ["since monday", "from monday", "monday"],
    ("period", "LAST_SUNDAY"): ["last sunday", "sunday"],
    ("scope", "ALL"): ["all", "every"],
    ("scope", "ANY"): ["any", "at all"],
}


# What the reason of a CLARIFY target says, and how a prompt may write its date in words.
UNCLEAR = ["ambiguous", "unspecified", "not registered"]
DATE_IN_WORDS = "september 18"


def fidelity_errors(prompt: Column, **said: Column) -> Column:
    """What a target (columns type, aggregation, period, scope, reason, date) says without a sign of it in its prompt, or its reason."""
    low = norm(prompt)
    lacks = lambda words: ~F.array_contains(F.array(*(F.contains(low, F.lit(w)) for w in words)), True)
    rules = [F.when((said[part] == value) & lacks(words), F.lit(f"{part}:{value}")) for (part, value), words in SIGNS.items() if part in said]
    if "reason" in said:
        reason = F.lower(F.coalesce(said["reason"], F.lit("")))
        rules.append(F.when((said["type"] == "CLARIFY") & ~F.array_contains(F.array(*(F.contains(reason, F.lit(w)) for w in UNCLEAR)), True), F.lit("type:CLARIFY")))
    if "date" in said:
        rules.append(F.when((said["date"] != "") & ~F.contains(prompt, said["date"]) & ~F.contains(low, F.lit(DATE_IN_WORDS)), F.concat(F.lit("date:"), said["date"])))
    return F.array_compact(F.array(*rules))


def field_accuracy(pairs: DataFrame, fields: list[str], expected: str = "expected", found: str = "found") -> DataFrame:
    """Share of rows whose found field equals the expected one, for each field (as JSON text), and of rows with all equal."""
    same = {f: F.col(f"{expected}.{f}").eqNullSafe(F.col(f"{found}.{f}")) for f in fields}
    every = F.lit(True)
    for c in same.values():
        every = every & c
    share = lambda c: (F.floor(F.avg(c.cast("int")) * 10000 + 0.5) / 10000)
    return pairs.agg(*(share(c).alias(f) for f, c in same.items()), share(every).alias("exact"))


def class_accuracy(pairs: DataFrame, expected: str, found: str) -> DataFrame:
    return pairs.groupBy(F.col(expected).alias("class")).agg(F.count_if(F.col(expected).eqNullSafe(F.col(found))).alias("hits"), F.count(F.lit(1)).alias("total"))


def chat_text(system: Column, prompt: Column, target: Column) -> Column:
    turn = lambda role, c: F.concat(F.lit(f"<|im_start|>{role}\n"), c, F.lit("<|im_end|>\n"))
    return F.concat(turn("system", system), turn("user", prompt), turn("assistant", target))


def generated(rows: DataFrame, index: str, template: str, options: dict[str, list[str]]) -> DataFrame:
    """gen_idx (the index, a long from 0 on) and prompt: a template whose {names} run through their options in mixed radix, the first name fastest."""
    text, radix = F.lit(template), 1
    for name, values in options.items():
        at = F.pmod(F.floor(F.col(index) / radix), F.lit(len(values))).cast("int")
        text = F.replace(text, F.lit("{" + name + "}"), F.get(F.array(*map(F.lit, values)), at))
        radix *= len(values)
    return rows.select(F.col(index).alias("gen_idx"), text.alias("prompt"))


def canonical_list(items: Column) -> Column:
    """A list as one JSON text, whatever its order and repeats: null fields are kept."""
    return F.to_json(F.array_sort(F.array_distinct(items)), {"ignoreNullFields": "false"})


def build_partition(candidates: DataFrame, errors: Column, quotas: DataFrame, keys: list[str], order: str = "gen_idx", prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """(rows without errors and repeats up to each group's quota, how many each group still lacks)."""
    sound = candidates.where(F.size(errors) == 0)
    filled = fill_quotas(first_of_prompt(sound, prompt, order), quotas, keys, order)
    have = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    lacking = quotas.join(have, keys, "left").withColumn("lacks", F.col("quota") - F.coalesce("_n", F.lit(0))).where("lacks > 0").select(*keys, "lacks")
    return filled, lacking
