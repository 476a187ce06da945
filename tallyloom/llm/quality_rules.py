"""Learned decision lists: sequential covering over labelled threshold statistics, applied as one Spark conditional.

Only DataFrame and SQL functions run on the executors. The driver sees, for each growth step, one
histogram of at most (features x bins) rows, whatever the corpus holds.

Defined results
  null or empty text      no words; every count 0; base_failed (fewer than 10 words)
  null label or doc_id    the row takes no part in learning; it is still judged by its text
  repeated labels         each labelled row counts; documents are never multiplied (labels are averaged by doc_id first)
  empty labels or corpus  no rules are learned: the verdict is the base rule alone; an empty corpus gives no rows
  ties between literals   larger gain, then lower feature position, then lower bin, then "<=" first
  extra columns           ignored; own columns have the prefix _ while at work
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import keyed, let, materialize, packed, read_table, words_of

WINDOW = 5
#: Up to so many ids (8 MB) of rejected documents are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SYMBOLS = r"[#*$%&|<>]"


def _features() -> dict[str, Column]:
    """name -> expression over the counts; what the rules put thresholds on."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_line": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
        "distinct_share": F.col("n_distinct_words") / n,
        "digit_share": F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "stops_per_word": F.col("n_stops") / n,
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
    }


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows found twice or more. Sorting puts equal windows side by side, so it takes n log n."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(ps: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(ps, k)["h"] == p["h"], F.lit(False))
        twice = F.filter(ps, lambda p, k: same(p, k - 1) | same(p, k + 1))
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, k - 1))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(pairs, lambda ps: let(positions(ps), covered))


def counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns of docs, and the counts of each whole text."""
    keep = ["doc_id"] if keep is None else keep
    t = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(*keep, t.alias("_text"), words_of(F.col(text)).alias("_words"))
    split = split.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda s: F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]"))))
    at = lambda i, k: F.get(F.col("_words"), i + k)
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))
    split = split.withColumn("_windows", F.when(F.size("_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    pieces = lambda pattern: (F.size(F.split("_text", pattern, -1)) - 1).cast("long")
    return split.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        pieces(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("_windows"))).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        pieces("[0-9]").alias("n_digits"),
        pieces("[A-Z]").alias("n_upper"),
        pieces("[.,!?;:]").alias("n_stops"),
    )


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = _features()[self.feature]
        return f > F.lit(self.threshold) if self.above else f <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; bad and good are the labelled rows it covers."""

    literals: tuple[Literal, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = self.literals[0].column()
        for x in self.literals[1:]:
            out = out & x.column()
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def verdict(self) -> Column:
        """One ordered conditional: the first rule that holds rejects; else the document is kept."""
        out = None
        for r in self.rules:
            out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def fired(self) -> Column:
        out = None
        for i, r in enumerate(self.rules):
            out = F.when(r.column(), F.lit(i)) if out is None else out.when(r.column(), F.lit(i))
        return F.lit(None).cast("int") if out is None else out.cast("int")


def _lower_bound(bad: float, good: float) -> float:
    """Wilson's lower bound (z = 1.64) of the share of bad rows: few rows are not believed."""
    n, z = bad + good, 1.64
    if n == 0:
        return 0.0
    p = bad / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn(labelled: DataFrame, bins: int = 16, max_rules: int = 8, max_literals: int = 3, min_precision: float = 0.8, min_bad: int = 5) -> DecisionList:
    """Sequential covering. labelled: the counts, and _bad (1 or 0).

    Two thirds of the rows (by a hash of doc_id) grow each conjunction by the literal of the largest
    information gain; the other third prunes it, dropping final literals while its precision there
    does not fall. A rule stays if Wilson's lower bound of its precision over all rows reaches
    min_precision; then the rows it covers leave, and the next rule is grown on the rest.
    """
    names = list(_features())
    rows = labelled.select("_bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("_prune"), *(f.alias(k) for k, f in _features().items()))
    marks = [i / bins for i in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(k, marks, 10000).alias(k) for k in names)).first()
    if found is None or found[0] is None:
        return DecisionList(())
    cuts = {k: sorted(set(found[k])) for k in names}
    # A value's bin is the number of cuts below it, so that "<= cut j" is "bin <= j".
    bin_of = lambda k: sum((F.when(F.col(k) > c, 1).otherwise(0) for c in cuts[k]), F.lit(0))
    binned = rows.select("_prune", "_bad", *(bin_of(k).alias(f"b{i}") for i, k in enumerate(names)))
    cells = [f"b{i}" for i in range(len(names))]
    table = materialize(binned.groupBy("_prune", *cells).agg(F.sum("_bad").alias("bad"), F.sum(1 - F.col("_bad")).alias("good")), "cells")

    def test(x: tuple[int, bool, int]) -> Column:
        return F.col(cells[x[0]]) > x[2] if x[1] else F.col(cells[x[0]]) <= x[2]

    def all_of(xs: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for x in xs:
            out = out & test(x)
        return out

    def histogram(df: DataFrame) -> list:
        stacked = df.select("bad", "good", F.posexplode(F.array(*cells)).alias("f", "b"))
        return sorted((r.f, r.b, r.bad, r.good) for r in stacked.groupBy("f", "b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect())

    def best(df: DataFrame) -> tuple[tuple[int, bool, int] | None, float, float, float, float]:
        seen = histogram(df)
        total_bad, total_good = sum(r[2] for r in seen if r[0] == 0), sum(r[3] for r in seen if r[0] == 0)
        if not total_bad or not total_good:
            return None, total_bad, total_good, total_bad, total_good
        prior, top = math.log2(total_bad / (total_bad + total_good)), (0.0, None, 0, 0)
        for f in range(len(names)):
            low_bad = low_good = 0
            for _, b, bad, good in (r for r in seen if r[0] == f):
                low_bad, low_good = low_bad + bad, low_good + good
                for above, p, n in ((False, low_bad, low_good), (True, total_bad - low_bad, total_good - low_good)):
                    if p >= 1 and b < len(cuts[names[f]]):
                        gain = p * (math.log2(p / (p + n)) - prior)
                        if gain > top[0] + 1e-9:
                            top = (gain, (f, above, b), p, n)
        return top[1], top[2], top[3], total_bad, total_good

    def covered(df: DataFrame, xss: list[list[tuple[int, bool, int]]]) -> list[tuple[int, int]]:
        sums = [F.coalesce(F.sum(F.when(all_of(xs), F.col(c)).otherwise(0)), F.lit(0)) for xs in xss for c in ("bad", "good")]
        r = df.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        return [(r[2 * i], r[2 * i + 1]) for i in range(len(xss))]

    rules: list[Rule] = []
    left = table
    while len(rules) < max_rules:
        grown: list[tuple[int, bool, int]] = []
        part = left.where(~F.col("_prune"))
        while len(grown) < max_literals:
            x, _, n, _, _ = best(part)
            if x is None:
                break
            grown.append(x)
            part = part.where(test(x))
            if n == 0:
                break
        if not grown:
            break
        prefixes = [grown[: i + 1] for i in range(len(grown))]
        on_prune = covered(left.where(F.col("_prune")), prefixes)
        overall = covered(left, prefixes)
        precision = [(b + 1) / (b + g + 2) for b, g in on_prune]
        keep = max(range(len(prefixes)), key=lambda i: (precision[i], -i))
        bad, good = overall[keep]
        if bad < min_bad or _lower_bound(bad, good) < min_precision:
            break
        chosen = prefixes[keep]
        rules.append(Rule(tuple(Literal(names[f], above, float(cuts[names[f]][b])) for f, above, b in chosen), int(bad), int(good)))
        left = left.where(~all_of(chosen))
    return DecisionList(tuple(rules))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules_for(table: DataFrame, labels: DataFrame) -> DecisionList:
    """The decision list learned from the labelled rows of a table of counts that pass the base rule."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality").alias("_q"))
    labelled = table.join(ids, F.col("doc_id") == F.col("_id")).withColumn("_bad", F.when(F.col("_q") < 0.5, 1).otherwise(0)).drop("_id", "_q")
    return learn(labelled.where(~base_failed()))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts of every document, base_failed, rule (the first that holds, or null) and kept."""
    table = materialize(counts(docs), "counts")
    found = rules_for(table, labels)
    return table.withColumn("base_failed", base_failed()).withColumn("rule", found.fired()).withColumn("kept", ~F.col("base_failed") & found.verdict())


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the verdict keeps."""
    rows = keyed(packed(docs))
    table = materialize(counts(rows, keep=["_key", "doc_id"]), "counts")
    found = rules_for(table, labels)
    gone = table.where(base_failed() | ~found.verdict()).select("_key")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "_key", "left_anti").select("_row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
