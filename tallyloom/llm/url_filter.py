"""Temporal URL lists: dated entries become validity intervals, and an as-of join judges every capture by what was active when it was fetched.

An entry names a list (its kind is block or allow), a pattern, a date and an action (add, remove). A pattern is a
host with everything below it ("example.com") or a host with a path ("example.com/a/": all paths that
begin so; "example.com/a/b": that path alone). Of one list and pattern, an entry holds from its
date until the next one's, so the intervals of a pattern never overlap.

A capture is exploded into the few patterns that could name it (a key for each label of its host and
each "/" of its path), which meet the intervals by equality and are then held to the fetch time.
The longest active pattern decides; between equals, allow.

Defined results
  null or unparsable url     no pattern names it: verdict none
  null fetch time            nothing is active then: verdict none
  null or repeated page_id   each row is judged by itself
  entries of one list, pattern and date   the last action in the order add < remove counts
  entries with a null pattern, date or action   ignored
  add after add, remove after remove, remove first   change nothing
  empty lists or captures    verdict none for every capture; no rows
  extra columns              ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import keyed, materialize, read_table

#: Up to so many intervals (some 100 bytes each) are broadcast; more are joined by a shuffle, which splits hot hosts.
BROADCAST_INTERVALS = 200_000
ALWAYS = 2**62


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^?#]*)", 1)
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.lit("/"))


def keys_of(host: Column, path: Column) -> Column:
    """Patterns that could name a URL: its host and the hosts above, and its host with each beginning of its path."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(path, "/", -1)
    below = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(host, F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/")))
    none = F.array().cast("array<string>")
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(above, below, F.array(F.concat(host, path))))).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, since, until (seconds; until is not included) of entries: list, kind, pattern, at, action."""
    known = entries.where(F.col("pattern").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    last = known.groupBy("list", "kind", "pattern", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    changes = last.withColumn("_before", F.lag("action").over(w)).where(F.coalesce(F.col("_before"), F.lit("remove")) != F.col("action"))
    held = changes.withColumn("until", F.coalesce(F.lead("at").over(w), F.lit(ALWAYS)))
    return held.where(F.col("action") == "add").select("list", "kind", "pattern", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: page_id, url, fetched_at (seconds). Returns them with n_active, verdict (block, allow, none) and pattern, the deciding one."""
    rows = keyed(captures.select("page_id", "url", "fetched_at"), order="page_id", text="url")
    lists = materialize(intervals(entries), "intervals")
    asked = rows.select("_key", "fetched_at", F.explode(keys_of(host_of(F.col("url")), path_of(F.col("url")))).alias("pattern"))
    side = F.broadcast(lists) if lists.count() <= BROADCAST_INTERVALS else lists
    met = asked.join(side, "pattern").where((F.col("since") <= F.col("fetched_at")) & (F.col("fetched_at") < F.col("until")))
    strength = F.struct(F.length("pattern").alias("n"), (F.col("kind") == "allow").cast("int").alias("allow"), F.col("pattern").alias("pattern"))
    active = met.groupBy("_key").agg(F.count(F.lit(1)).alias("n_active"), F.max(strength).alias("_best"))
    out = rows.join(active, "_key", "left")
    return out.select(
        "page_id", "url", "fetched_at",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.when(F.col("_best").isNull(), "none").when(F.col("_best.allow") == 1, "allow").otherwise("block").alias("verdict"),
        F.col("_best.pattern").alias("pattern"),
    )


FIRST = 1704067200  # 2024-01-01T00:00:00Z


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages have no fetch times: each gets an hour of January 2024 by its page_id."""
    return pages.select("page_id", "url", (F.lit(FIRST) + F.pmod(F.col("page_id") * 7919, F.lit(744)) * 3600).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries for what the pages' hosts name, by digits of an MD5: two of three domains are
    blocked on some day, half of those are removed later, and some come back; one host and first
    path step in four is allowed for good on some day."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    digits = lambda c, i: F.conv(F.substring(F.md5(c), 2 * i + 1, 2), 16, 10).cast("long")
    day = lambda n: F.lit(FIRST) + n * 86400
    domains = pages.select(F.substring_index(host, ".", -3).alias("pattern")).where("pattern != ''").distinct()
    d = F.col("pattern")
    first, second, third = digits(d, 1) % 15, digits(d, 2) % 8 + 1, digits(d, 3) % 5 + 1
    dated = lambda at, action: F.struct(day(at).alias("at"), F.lit(action).alias("action"))
    removed = F.when(digits(d, 4) % 2 == 0, dated(first + second, "remove"))
    again = F.when(digits(d, 4) % 4 == 0, dated(first + second + third, "add"))
    blocked = domains.where(digits(d, 0) % 3 != 0).select(F.lit("hosts").alias("list"), F.lit("block").alias("kind"), "pattern", F.explode(F.array_compact(F.array(dated(first, "add"), removed, again))).alias("e"))
    steps = pages.select(F.concat(host, F.regexp_extract(path, r"^(/[^/]*/?)", 1)).alias("pattern")).where(F.length(host) > 0).distinct()
    allowed = steps.where(digits(d, 0) % 4 == 0).select(F.lit("paths").alias("list"), F.lit("allow").alias("kind"), "pattern", F.struct(day(digits(d, 1) % 20).alias("at"), F.lit("add").alias("action")).alias("e"))
    return blocked.unionByName(allowed).select("list", "kind", "pattern", "e.at", "e.action")


def op1_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(captures_of(pages), entries_of(pages))


OP1_SQL = r"""
WITH c AS (
  SELECT row_number() OVER () AS k, page_id, url, 1704067200 + ((page_id * 7919) % 744) * 3600 AS fetched_at,
         lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host,
         CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^?#]*)', 1) LIKE '/%'
              THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^?#]*)', 1) ELSE '/' END AS path
  FROM pages
), d AS (
  SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS pattern FROM c WHERE host <> ''
), dx AS (
  SELECT pattern, CAST('0x' || md5(pattern)[1:2] AS BIGINT) AS b0, CAST('0x' || md5(pattern)[3:4] AS BIGINT) % 15 AS f,
         CAST('0x' || md5(pattern)[5:6] AS BIGINT) % 8 + 1 AS s, CAST('0x' || md5(pattern)[7:8] AS BIGINT) % 5 + 1 AS t,
         CAST('0x' || md5(pattern)[9:10] AS BIGINT) AS b4
  FROM d
), p AS (
  SELECT DISTINCT host || regexp_extract(path, '^(/[^/]*/?)', 1) AS pattern FROM c WHERE host <> ''
), iv AS (
  SELECT 'block' AS kind, pattern, 1704067200 + f * 86400 AS since,
         CASE WHEN b4 % 2 = 0 THEN 1704067200 + (f + s) * 86400 ELSE 4611686018427387904 END AS until FROM dx WHERE b0 % 3 <> 0
  UNION ALL
  SELECT 'block', pattern, 1704067200 + (f + s + t) * 86400, 4611686018427387904 FROM dx WHERE b0 % 3 <> 0 AND b4 % 4 = 0
  UNION ALL
  SELECT 'allow', pattern, 1704067200 + (CAST('0x' || md5(pattern)[3:4] AS BIGINT) % 20) * 86400, 4611686018427387904
  FROM p WHERE CAST('0x' || md5(pattern)[1:2] AS BIGINT) % 4 = 0
), keys AS (
  SELECT DISTINCT k, fetched_at, pattern FROM (
    SELECT k, fetched_at, array_to_string(string_split(host, '.')[i:], '.') AS pattern FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host <> '')
    UNION ALL
    SELECT k, fetched_at, host || array_to_string(string_split(path, '/')[1:i], '/') || '/' FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS i FROM c WHERE host <> '')
    UNION ALL
    SELECT k, fetched_at, host || path FROM c WHERE host <> '')
), m AS (
  SELECT k, count(*) AS n_active, max({'n': length(keys.pattern), 'allow': CAST(kind = 'allow' AS INT), 'pattern': keys.pattern}) AS best
  FROM keys JOIN iv ON keys.pattern = iv.pattern AND since <= fetched_at AND fetched_at < until GROUP BY k
)
SELECT page_id, url, fetched_at, coalesce(n_active, 0) AS n_active,
       CASE WHEN best IS NULL THEN 'none' WHEN best.allow = 1 THEN 'allow' ELSE 'block' END AS verdict, best.pattern AS pattern
FROM c LEFT JOIN m USING (k)
"""
