"""Queries for what the others leave out: order, empty input, odd literals, every branch of the extractors, tools by name. And their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.functions import extraction as X
from tallyloom.model import Filter, Period, Query
from tallyloom.operators import catalog, dataset, retrieval
from tallyloom.operators.registry import _C, AS_OF, N, _by, _round, _sql, catalogue, dsl, entry, farmer_entry
from tallyloom.plans.entities import candidates, match_all, mentions_in, normalize
from tallyloom.plans.questions import parsed
from tallyloom.sources import relations as R
from tallyloom.sources.scratch import shared_folder
from tallyloom.sources.seed import seed

# Order: of a limited result the rows themselves prove it ------------------------------------------
catalogue("scan_newest_20", lambda r: catalog.newest_first(r).select("id").limit(20), "SELECT id FROM rel ORDER BY created_at DESC, id LIMIT 20")
catalogue("pending_oldest_20", lambda r: catalog.pending_uploads(r).select("id").limit(20), "SELECT id FROM rel WHERE upload_status = 'PENDING' ORDER BY created_at, id LIMIT 20")
farmer_entry("farmers_active_20", lambda f: f.where("is_active").orderBy("farmer_name").select("farmer_name").limit(20), "SELECT farmer_name FROM reg WHERE is_active ORDER BY farmer_name LIMIT 20")
dsl("group_default_order", Query(group_by=("FARMER_NAME",), aggregations=(N,), limit=15), _by("farmer_name", f"{_C} AS count_records", "ORDER BY 3 DESC, 1 LIMIT 15"))
dsl("group_of_nothing", Query(group_by=("FARMER_NAME",), aggregations=(N,), time=Period("DATE", None, "1970-01-01")), _by("farmer_name", f"{_C} AS count_records", "HAVING false"))
for _i, _text in enumerate(("1_000", "nan", "inf", " 1e2 ", "+50.", "0x10")):
    _holds = {3: "quantity > 100", 4: "quantity > 50"}.get(_i, "false")
    dsl(f"numeric_literal_{_i}", Query(filters=(Filter("QUANTITY", "GREATER_THAN", _text),), aggregations=(N,)), f"SELECT {_C} AS count_records FROM rel WHERE {_holds} HAVING count(*) > 0", measures=True)

# The catalogue by name and period -----------------------------------------------------------------
catalogue("weekly_by_name", lambda r: catalog.week_of(r, AS_OF, "#00000001", 6), "SELECT coalesce(sum(quantity), 0.0) AS total_quantity FROM rel WHERE created_at >= TIMESTAMP '1998-08-16' AND contains(lower(farmer_name), '#00000001')", True)
for _p, _where in (("today", "created_at >= TIMESTAMP '1998-08-19' AND created_at < TIMESTAMP '1998-08-20'"), ("week", "created_at >= TIMESTAMP '1998-08-17'"), ("ever", "true")):
    catalogue(f"farmers_covered_{_p}", lambda r, p=_p: catalog.covered(r, AS_OF, p), f"SELECT CAST(count(DISTINCT lower(farmer_name)) AS BIGINT) AS n_names FROM rel WHERE {_where}")
catalogue("sync_affected", catalog.affected, "SELECT CAST(count(*) FILTER (WHERE upload_status = 'PENDING') AS BIGINT) AS n FROM rel")


@entry("effective_amounts", _sql(f"SELECT id, coalesce(p, {_round('quantity * greatest(35.0 + greatest(coalesce(fat, 0.0) - 3.5, 0.0) * 4 + greatest(coalesce(snf, 0.0) - 8.0, 0.0) * 2, 30.0)')}) AS payable, coalesce(amount_paid, p, {_round('quantity * greatest(35.0 + greatest(coalesce(fat, 0.0) - 3.5, 0.0) * 4 + greatest(coalesce(snf, 0.0) - 8.0, 0.0) * 2, 30.0)')}) AS paid FROM (SELECT *, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN payable_amount END AS p FROM rel)"))
def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.orders(spark, sf_dir).withColumn("payable_amount", F.when(F.col("id").cast("long") % 2 == 0, F.col("payable_amount")))
    return rows.select("id", C.effective_payable().alias("payable"), C.effective_paid().alias("paid"))


@entry("insert_absent_collisions", "SELECT c_custkey || '/' || i AS farmer_id, c_name || ' ' || n AS normalized_name FROM customer, (VALUES ('1', 'a'), ('2', 'b'), ('3', 'c'), ('5', 'e'), ('7', 'f')) v(i, n)")
def _collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer, among the new rows: 3 takes c from 4, so that 5, second row of 5, falls to the first; 6 shares e with it; 1 and b are there already."""
    keys = [("3", "c"), ("4", "c"), ("5", "e"), ("5", "g"), ("6", "e"), ("1", "z"), ("8", "b"), ("7", "f")]
    c = R.table(spark, sf_dir, "customer")

    def rows(pairs: list[tuple[str, str]]) -> DataFrame:
        each = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(i).alias("i")) for i, (k, n) in enumerate(pairs)))
        out = c.select("c_custkey", "c_name", F.inline(each))
        return out.select(F.concat_ws("/", F.col("c_custkey").cast("string"), "k").alias("farmer_id"), F.concat_ws(" ", "c_name", "n").alias("normalized_name"), (F.col("c_custkey") * 10 + F.col("i")).cast("long").alias("at"))

    return R.insert_absent(rows([("1", "a"), ("2", "b")]), rows(keys), ["farmer_id", "normalized_name"], "at").drop("at")


@entry("seed_rows", _sql("SELECT farmer_name, payment_status, payment_method, payable_amount, amount_paid, CAST(date_diff('hour', created_at, TIMESTAMP '1998-08-19 12:00:00') AS INT) AS hours FROM rel UNION ALL SELECT * FROM (VALUES ('Ramesh', 'PENDING', NULL, CAST(702.0 AS DOUBLE), CAST(NULL AS DOUBLE), 3), ('Suresh', 'RECORDED_LOCALLY', 'CASH', 456.0, 456.0, 2), ('Mahesh', 'PENDING', NULL, 792.0, NULL, 1)) v(farmer_name, payment_status, payment_method, payable_amount, amount_paid, hours)"))
def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a new store beside the records of the tables."""
    hours = F.expr(f"CAST(timestampdiff(HOUR, created_at, TIMESTAMP_NTZ '{AS_OF.isoformat(sep=' ')}') AS INT)")
    rows = R.orders(spark, sf_dir, False).unionByName(seed(spark, AS_OF)[1])
    return rows.select("farmer_name", "payment_status", "payment_method", "payable_amount", "amount_paid", hours.alias("hours"))


@entry("jsonl_round_trip", _sql("SELECT id, farmer_name, quantity, payment_method, amount_paid FROM rel"))
def _jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    R.write_jsonl(R.orders(spark, sf_dir), folder)
    return R.read_jsonl(spark, folder, R.RECORD).select("id", "farmer_name", "quantity", "payment_method", "amount_paid")


# Names -------------------------------------------------------------------------------------------
@entry("normalized_names", r"SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize(CASE WHEN c_custkey % 2 = 0 THEN 'Jose' || chr(769) || '''s ' || c_name ELSE 'JOSÉ  ' || c_name END)), '[''’]s\b', '', 'g'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM customer")
def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "customer")
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "José's ").otherwise("JOSÉ  "), "c_name")
    return c.select("c_custkey", C.normalized_name(C.composed(name)).alias("name"))


@entry("capitalized", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, md5(upper(text[1]) || text[2:]) AS digest FROM documents")
def _capitalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return R.table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(C.capitalized(t).cast("binary")).alias("digest"))


_TOKENS = "list_filter(string_split(trim(regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: length(t) >= 2)"


# A search: every hundredth customer is asked for by the whole name, of which all names share a token.
@entry("mentions_match", f"WITH {R.FARMERS_SQL}, m AS (SELECT 'Mister ' || farmer_name AS mention, unnest({_TOKENS.format('lower(farmer_name)')}) AS t FROM reg WHERE CAST(farmer_id AS BIGINT) % 100 = 0), k AS (SELECT farmer_id, unnest({_TOKENS.format('normalized_name')}) AS t FROM reg) SELECT DISTINCT mention, farmer_id FROM m JOIN k ON m.t = k.t")
def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.farmers(spark, sf_dir)
    plain = f.withColumn("normalized_name", C.normalized_name(F.col("normalized_name")))
    return match_all(f.where(F.col("farmer_id").cast("long") % 100 == 0).select(F.concat(F.lit("Mister "), "farmer_name").alias("mention")), plain)


farmer_entry("resolve_blank", lambda f: candidates(f, " ' ").where(F.lit(bool(normalize(" ' ")))).select("farmer_id"), "SELECT farmer_id FROM reg WHERE false")


# Texts: every branch -----------------------------------------------------------------------------
def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


def branches(name: str, said: list[tuple], schema: str, build, out: list[tuple], names: str) -> None:
    """For every order one of the inputs in turn, and what build makes of it, against the answers written out."""
    fields = [f.split()[0] for f in schema.split(",")]
    kind = f"array<struct<{', '.join(f'{f}: string' for f in fields)}>>"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = F.array(*(F.struct(*(F.lit(v).cast("string").alias(f) for f, v in zip(fields, s, strict=True))) for s in said)).cast(kind)
        o = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"))
        return build(o.withColumn("_in", F.get(inputs, F.pmod("i", F.lit(len(said))).cast("int"))).select("i", "_in.*"))

    entry(name, f"SELECT o_orderkey AS i, v.* EXCLUDE (turn) FROM orders JOIN ({_values([(i, *o) for i, o in enumerate(out)], f'turn, {names}')}) v ON o_orderkey % {len(out)} = turn")(run)


branches(
    "reconcile_branches", [("12.5", None), ("12.5", "125"), ("12.5", "12"), ("12.5", "12.5"), ("7", "12.5"), (None, "0"), (None, "0.0"), (None, " 9 "), (None, None)], "raw string, given string",
    lambda d: d.select("i", X.reconciled(F.col("raw"), F.col("given")).alias("value")), [("12.5",), ("12.5",), ("12.5",), ("12.5",), ("12.5",), (None,), (None,), ("9",), (None,)], "value",
)
branches(
    "reconcile_names", [("ramesh gave 5 litres", None), ("record asha 5", " "), ("milk gave nothing", None), ("ramesh gave 5", "Asha"), ("nobody", None)], "said string, given string",
    lambda d: d.select("i", X.name(F.col("said"), F.col("given")).alias("name")), [("Ramesh",), ("Asha",), (None,), ("Asha",), (None,)], "name",
)
branches(
    "payment_words", [("by Bank",), ("UPI done",), ("in cash",), ("still pending",), ("unpaid",), ("is due",), ("paid",), ("nothing",), (None,)], "said string",
    lambda d: d.select("i", X.payment(F.col("said")).alias("p")).select("i", "p.method", "p.status"),
    [("BANK_TRANSFER", "RECORDED_LOCALLY"), ("UPI", "RECORDED_LOCALLY"), ("CASH", "RECORDED_LOCALLY"), (None, "PENDING"), (None, "PENDING"), (None, "PENDING"), (None, "RECORDED_LOCALLY"), (None, None), (None, None)], "method, status",
)
branches(
    "fidelity_reasons",
    [("tell me", "CLARIFY", "ambiguous name", ""), ("tell me", "CLARIFY", "no idea", ""), ("milk on 2026-09-18", "QUERY", None, "2026-09-18"), ("milk on September 18", "QUERY", None, "2026-09-18"), ("milk on friday", "QUERY", None, "2026-09-18"), ("add 5", "WRITE", None, ""), ("five", "WRITE", None, "")],
    "prompt string, type string, reason string, day string", lambda d: d.select("i", F.array_join(dataset.fidelity_errors(F.col("prompt"), type=F.col("type"), reason=F.col("reason"), date=F.col("day")), ",").alias("errors")),
    [("",), ("type:CLARIFY",), ("",), ("",), ("date:2026-09-18",), ("",), ("type:WRITE",)], "errors",
)

#: Questions by turn, where {name} is a customer's, {n} a number and {day} a date; and what they ask for: request, target, mention, select, filters, period, aggregations, groups, limit, written quantity.
_WORDS = [
    ("{name} gave {n} litres fat 4.1", "WRITE", "MILK_RECORDS", None, "", "", None, "", "", None, "{n}"),
    ("did {name} give {n} litres fat 4.1?", "QUERY", "MILK_RECORDS", "{name}", "", "", None, "", "", None, None),
    ("what is the sync policy", "QUERY", "KNOWLEDGE_BASE", None, "", "", None, "", "", None, None),
    ("what is my officer id", "QUERY", "WORKER_PROFILE", None, "", "", None, "", "", None, None),
    ("which union do we belong to", "QUERY", "ORGANIZATION_INFO", None, "", "", None, "", "", None, None),
    ("why was {name} paid late", "UNSUPPORTED", "MILK_RECORDS", None, "", "", None, "", "", None, None),
    ("total milk of {name} last week", "QUERY", "MILK_RECORDS", "{name}", "", "", "LAST_WEEK", "SUM QUANTITY", "", None, None),
    ("how much milk on {day}, and the average fat", "QUERY", "MILK_RECORDS", None, "FAT", "", "{day}", "SUM QUANTITY,AVG FAT", "", None, None),
    ("who gave the most since monday", "QUERY", "MILK_RECORDS", None, "FARMER_NAME,QUANTITY", "", "SINCE_MONDAY", "SUM QUANTITY", "FARMER_NAME", 1, None),
    ("list entries above {n} litres with fat over 4 this month", "QUERY", "MILK_RECORDS", None, "FARMER_NAME,QUANTITY,FAT", "QUANTITY GREATER_THAN {n},FAT GREATER_THAN 4", "THIS_MONTH", "", "", None, None),
    ("snf > 8.5 and fat above {n}", "QUERY", "MILK_RECORDS", None, "SNF", "SNF GREATER_THAN 8.5", None, "", "", None, None),
    ("pending payment of {name} yesterday", "QUERY", "MILK_RECORDS", "{name}", "PAYMENT_STATUS,PAYMENT_METHOD,PAYMENT_REFERENCE", "PAYMENT_STATUS EQUALS PENDING", "YESTERDAY", "", "", None, None),
]
_SAID_SQL = "replace(replace(replace({}, '{{name}}', c_name), '{{n}}', CAST(o_orderkey % 90 + 1 AS VARCHAR)), '{{day}}', strftime(o_orderdate, '%Y-%m-%d'))"


@entry(
    "words_to_queries",
    f"SELECT o_orderkey, request, target, {_SAID_SQL.format('mention')} AS mention, fields, {_SAID_SQL.format('filters')} AS filters, {_SAID_SQL.format('period')} AS period, aggregations, groups, \"limit\", {_SAID_SQL.format('quantity')} AS quantity "
    f"FROM orders JOIN customer ON o_custkey = c_custkey JOIN ({_values([(i, *w) for i, w in enumerate(_WORDS)], 'turn, said, request, target, mention, fields, filters, period, aggregations, groups, \"limit\", quantity')}) v ON o_orderkey % {len(_WORDS)} = turn",
)
def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about every order, read in the JVM, with the customers' names found in them."""
    c = R.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = R.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    text = F.get(F.array(*(F.lit(w[0]) for w in _WORDS)), F.pmod("o_orderkey", F.lit(len(_WORDS))).cast("int"))
    for slot, value in (("{name}", F.col("c_name")), ("{n}", (F.col("o_orderkey") % 90 + 1).cast("string")), ("{day}", F.date_format("o_orderdate", "yyyy-MM-dd"))):
        text = F.replace(text, F.lit(slot), value)
    texts = o.select(F.col("o_orderkey").alias("key"), text.alias("text"))
    named = texts.join(mentions_in(texts, c.select(F.col("c_name").alias("name"))), "key")
    q = named.select("key", parsed(F.col("text"), F.col("mention")).alias("q"))
    pair = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *(x[n] for n in names))), ",")
    return q.select(
        F.col("key").alias("o_orderkey"), "q.request", "q.target", "q.mention", F.array_join("q.select", ",").alias("fields"), pair(F.col("q.filters"), "field", "op", "value").alias("filters"),
        F.coalesce("q.time.period", "q.time.start").alias("period"), pair(F.col("q.aggregations"), "type", "field").alias("aggregations"), F.array_join("q.group_by", ",").alias("groups"), "q.limit", F.col("q.write_args")["quantity"].alias("quantity"),
    )


# Retrieval ---------------------------------------------------------------------------------------
def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents")
    key = F.element_at(F.array(*(F.lit(b.doc_id) for b in retrieval.BONUSES), F.concat(F.lit("D"), F.col("doc_id").cast("string"))), F.least(F.col("doc_id") + 1, F.lit(5)).cast("int"))
    return d.select(key.alias("id"), F.lit("dairy").alias("document_title"), F.lit("notes").alias("section_title"), F.concat(F.lit("quota "), F.col("doc_id").cast("string")).alias("content"), F.array(F.lit("limits")).alias("keywords"))


_IDS = "CASE doc_id WHEN 0 THEN 'KNOW-PAY-01' WHEN 1 THEN 'KNOW-QUAL-01' WHEN 2 THEN 'KNOW-REJ-01' WHEN 3 THEN 'KNOW-SYNC-01' ELSE 'D' || CAST(doc_id AS VARCHAR) END"


@entry("retrieval_bonuses", f"SELECT q, {_IDS} AS id, CAST(CASE WHEN doc_id = favoured THEN 4.0 + base ELSE base END / (3.0 * n) AS DOUBLE) AS score FROM documents, (VALUES (0, 0, 2, 0.0), (1, 1, 3, 1.0), (2, 2, 2, 1.0), (3, 3, 3, 0.0)) v(q, favoured, n, base) WHERE (doc_id = favoured OR base > 0)")
def _bonuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, out = _knowledge(spark, sf_dir), None
    for i, question in enumerate(("is payment complete", "minimum SNF quota", "quota spoilage", "upload while offline")):
        q = retrieval.scored(k, question).select(F.lit(i).alias("q"), "id", "score")
        out = q if out is None else out.unionByName(q)
    return out


@entry("retrieval_without_evidence", "SELECT 'none' AS id, 0.0 AS score WHERE false")
def _no_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit in the content of five terms stays below the threshold; a question of stop words asks nothing."""
    k = _knowledge(spark, sf_dir)
    few = retrieval.search(k, "quota alpha bravo charlie delta foxtrot", 5)
    return few.unionByName(retrieval.search(k, "what is the", 5)).select("id", "score")
