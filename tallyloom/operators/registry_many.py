"""Queries that answer for a whole column at once - mentions, texts, names, questions - and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.model import Aggregation, Order, Query
from tallyloom.operators import dataset, retrieval, similar, targets
from tallyloom.operators.registry import _SETS, AS_OF, _corpus, _sentences, entry
from tallyloom.plans import compiler, entities, render
from tallyloom.sources import relations as R
from tallyloom.sources.scratch import shared_folder
from tallyloom.sources.store import Store, create
from tallyloom.streaming import rows as live_rows

# Rows that collide in two keys ---------------------------------------------------------------------
_KEYS = ("'f' || CAST(c_custkey // 2 AS VARCHAR)", "'n' || CAST((c_custkey + 1) // 2 AS VARCHAR)")


@entry("insert_absent_chain", f"WITH {R.FARMERS_SQL} SELECT farmer_id, normalized_name FROM reg UNION ALL SELECT {_KEYS[0]}, {_KEYS[1]} FROM customer WHERE c_custkey % 2 = (SELECT min(c_custkey) % 2 FROM customer)")
def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a new row that collides with the one before it: every other one gets in."""
    have = R.farmers(spark, sf_dir).select("farmer_id", "normalized_name").withColumn("n", F.lit(0).cast("long"))
    k = F.col("c_custkey")
    half = lambda c: F.floor(c / 2).cast("long").cast("string")
    new = R.table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), half(k)).alias("farmer_id"), F.concat(F.lit("n"), half(k + 1)).alias("normalized_name"), k.cast("long").alias("n"))
    return R.insert_absent(have, new, ["farmer_id", "normalized_name"], "n").drop("n")


# Records as stored state ---------------------------------------------------------------------------
_STORED = ("id", "farmer_name", "payment_status", "upload_status", "amount_paid", "updated_at")


def _store(spark: SparkSession, sf_dir: str) -> Store:
    return create(R.orders(spark, sf_dir, False).select(*_STORED), shared_folder(spark, "store"), "id", 32)


@entry("stored_upsert", f"WITH {R.ORDERS_SQL} SELECT id, farmer_name, CASE WHEN payment_status = 'PENDING' AND CAST(id AS BIGINT) % 7 = 0 THEN 'PAID' ELSE payment_status END AS payment_status FROM rel UNION ALL SELECT 'new-' || CAST(c_custkey AS VARCHAR), c_name, 'PENDING' FROM customer")
def _stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid records in place of pending ones, and a new record for each customer, each told twice."""
    store, rows = _store(spark, sf_dir), R.orders(spark, sf_dir, False).select(*_STORED)
    paid = rows.where("payment_status = 'PENDING' AND CAST(id AS BIGINT) % 7 = 0").withColumn("payment_status", F.lit("PAID")).withColumn("turn", F.lit(2))
    new = R.table(spark, sf_dir, "customer").select(F.concat(F.lit("new-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("farmer_name"), F.lit("PENDING").alias("payment_status"), F.lit("PENDING").alias("upload_status"), F.lit(None).cast("double").alias("amount_paid"), F.lit("1998-08-19").cast("timestamp_ntz").alias("updated_at"), F.lit(1).alias("turn"))
    store.upsert(paid.unionByName(paid.withColumns({"payment_status": F.lit("LOST"), "turn": F.lit(1)})).unionByName(new), "turn")
    return store.read(spark).select("id", "farmer_name", "payment_status")


@entry("stored_updates", f"WITH {R.ORDERS_SQL} SELECT id, CASE WHEN CAST(id AS BIGINT) % 500 = 3 THEN 'PAID' ELSE payment_status END AS payment_status, 'UPLOADED' AS upload_status, CASE WHEN CAST(id AS BIGINT) % 500 = 3 THEN coalesce(amount_paid, 1.5) ELSE amount_paid END AS amount_paid, (SELECT count(*) FROM rel WHERE upload_status = 'PENDING') AS n_synced FROM rel")
def _stored_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments by id, then all pending uploads: the second change's count is what the sync reports."""
    store = _store(spark, sf_dir)
    ids = R.orders(spark, sf_dir, False).where("CAST(id AS BIGINT) % 500 = 3").select("id")
    store.update(spark, F.lit(True), {"payment_status": F.lit("PAID"), "amount_paid": F.coalesce("amount_paid", F.lit(1.5))}, ids)
    n = store.update(spark, F.col("upload_status") == "PENDING", {"upload_status": F.lit("UPLOADED")})
    return store.read(spark).select("id", "payment_status", "upload_status", "amount_paid", F.lit(n).cast("long").alias("n_synced"))


_READERS = [("all", "", None, None), ("pending", None, "PENDING", " "), ("seven", "#000000007", "", "PENDING"), ("paid", "", "PAID", "")]
_AFTER = "CASE WHEN payment_status = 'PENDING' THEN 'PAID' ELSE 'PENDING' END"


@entry(
    "live_row_changes",
    f"""WITH {R.ORDERS_SQL}, c AS (SELECT *, {_AFTER} AS after FROM rel WHERE CAST(id AS BIGINT) % 9 = 0), p(reader, name, status, upload) AS (VALUES ('all', '', '', ''), ('pending', '', 'PENDING', ''), ('seven', '#000000007', '', 'PENDING')),
    t AS (SELECT reader, id, contains(lower(farmer_name), name) AND (upload = '' OR upload_status = upload) AS fit, status = '' OR payment_status = status AS before, status = '' OR after = status AS now FROM c, p)
    SELECT reader, CASE WHEN now THEN 'put' ELSE 'remove' END AS change, id FROM t WHERE fit AND (before OR now)
    UNION ALL SELECT 'paid', 'reset', NULL UNION ALL SELECT 'paid', 'put', rel.id FROM rel LEFT JOIN c ON c.id = rel.id WHERE coalesce(after, rel.payment_status) = 'PAID'""",
)
def _live_row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four readers are told when every ninth record changes, and one of them asks anew."""
    store, rows = _store(spark, sf_dir), R.orders(spark, sf_dir, False).select(*_STORED)
    changed = rows.where("CAST(id AS BIGINT) % 9 = 0").withColumn("payment_status", F.expr(_AFTER))
    readers = spark.createDataFrame([(*r, True, 1) for r in _READERS], live_rows.PARAMETERS)
    told, _ = live_rows.apply(store, readers.where("reader <> 'paid'"), changed, readers.where("reader = 'paid'"), "updated_at")
    return told.select("reader", "change", "row.id")


# A shuffle without a sort --------------------------------------------------------------------------
@entry("shuffled_positions", "SELECT row_number() OVER () - 1 AS position FROM lineitem")
def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered by order and line, and their places in a shuffle: every place once."""
    lines = R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return dataset.shuffled(dataset.numbered(lines, lines.columns), "number").select("position")


# Names in texts ------------------------------------------------------------------------------------
@entry("order_name_leaks", "SELECT o_orderkey, lower(c.c_name) AS name FROM orders JOIN customer c ON o_custkey = c.c_custkey")
def _order_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers' names against the sentences of all orders."""
    rows = _sentences(spark, sf_dir).select("o_orderkey", F.col("text").alias("prompt"), F.lit(None).cast("string").alias("entity"))
    return targets.entity_leaks(rows, R.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))).select("o_orderkey", "name")


@entry("benchmark_openings_in_documents", "WITH b AS (SELECT DISTINCT lower(trim(substr(text, 1, 60))) AS name FROM benchmark WHERE trim(substr(text, 1, 60)) <> '') SELECT doc_id, name FROM documents JOIN b ON contains(lower(text), name)")
def _openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = R.table(spark, sf_dir, "benchmark").select(F.substring("text", 1, 60).alias("name"))
    rows = R.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), F.lit(None).cast("string").alias("entity"))
    return targets.entity_leaks(rows, names).select("doc_id", "name")


# Near-duplicates by class --------------------------------------------------------------------------
_CLASSES = f"WITH s AS ({_SETS}), k AS (SELECT doc_id, len(w) AS n, w, array_to_string(list_sort(w), ' ') AS t FROM s WHERE len(w) > 0), c AS (SELECT t, min(doc_id) AS class FROM k GROUP BY t)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@entry("jaccard_classes", f"{_CLASSES} SELECT doc_id AS id, class FROM k JOIN c USING (t)")
def _jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.set_classes(_docs(spark, sf_dir))


_RANKED = """, r AS (SELECT class, w, len(w) AS n FROM k JOIN c ON k.t = c.t AND doc_id = class), e AS (SELECT class, n, unnest(w) AS t FROM r), f AS (SELECT t, count(*) AS f FROM e GROUP BY t),
    o AS (SELECT class, n, e.t, row_number() OVER (PARTITION BY class ORDER BY f, e.t) AS k FROM e JOIN f ON e.t = f.t)"""


@entry(
    "jaccard_class_pairs",
    f"""{_CLASSES}{_RANKED}, p AS (SELECT * FROM o WHERE k <= n - ceil(80 * n / 100.0) + 1),
    m AS (SELECT DISTINCT a.class AS class_a, b.class AS class_b FROM p a JOIN p b ON a.t = b.t AND a.class < b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n))
    SELECT class_a, class_b, len(list_intersect(x.w, y.w)) / CAST(len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)) AS DOUBLE) AS similarity FROM m JOIN r x ON x.class = class_a JOIN r y ON y.class = class_b
    WHERE 100 * len(list_intersect(x.w, y.w)) >= 80 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))""",
)
def _jaccard_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_classes(_docs(spark, sf_dir), 80)[1]


# Mentions ------------------------------------------------------------------------------------------
_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[''’]s\\b', '', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
#: What is asked for, for every customer: the name, a part of it that one or that many names have, a longer text around it, a token beside a strange one, nobody.
_MENTIONS = {
    0: ("upper(c_name) || '''s'", lambda n, k: F.concat(F.upper(n), F.lit("'s"))),
    1: ("substr(c_name, 10)", lambda n, k: F.substring(n, 10, 100)),
    2: ("substr(c_name, 10, 7)", lambda n, k: F.substring(n, 10, 7)),
    3: ("'milk of ' || c_name || ' today'", lambda n, k: F.concat(F.lit("milk of "), n, F.lit(" today"))),
    4: ("'Mister ' || substr(c_name, 10)", lambda n, k: F.concat(F.lit("Mister "), F.substring(n, 10, 100))),
    5: ("'a customer'", lambda n, k: F.lit("a customer")),
    6: ("'nobody ' || CAST(c_custkey % 50 AS VARCHAR)", lambda n, k: F.concat(F.lit("nobody "), (k % 50).cast("string"))),
    7: ("' - '", lambda n, k: F.lit(" - ")),
}


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, key = F.col("c_name"), F.col("c_custkey")
    turn = F.pmod(key, F.lit(len(_MENTIONS)))
    said = F.coalesce(*(F.when(turn == i, made(name, key)) for i, (_, made) in _MENTIONS.items()))
    return R.table(spark, sf_dir, "customer").select(key, said.alias("mention"))


_ASKED_SQL = f"SELECT c_custkey, CASE c_custkey % {len(_MENTIONS)} {' '.join(f'WHEN {i} THEN {sql}' for i, (sql, _) in _MENTIONS.items())} END AS mention FROM customer"
_TOKENS_OF = "list_distinct(list_filter(string_split({}, ' '), lambda t: length(t) >= 2))"


@entry(
    "resolve_mentions",
    f"""WITH {R.FARMERS_SQL}, a AS (SELECT DISTINCT mention, {_PLAIN.format("mention")} AS asked FROM ({_ASKED_SQL})), k AS (SELECT farmer_id, farmer_name, {_PLAIN.format("normalized_name")} AS known FROM reg WHERE is_active),
    q AS (SELECT DISTINCT asked FROM a WHERE asked <> ''),
    c AS (SELECT asked, CASE WHEN asked = known THEN 1 ELSE 2 END AS how, length(known) AS size, farmer_id, farmer_name FROM q JOIN k ON known <> '' AND (contains(known, asked) OR contains(asked, known))),
    t AS (SELECT asked, 3 AS how, 0 AS size, farmer_id, farmer_name, token, count(*) OVER (PARTITION BY asked, token) AS per FROM (SELECT asked, unnest({_TOKENS_OF.format("asked")}) AS token FROM q WHERE asked NOT IN (SELECT asked FROM c))
      JOIN (SELECT farmer_id, farmer_name, unnest({_TOKENS_OF.format("known")}) AS token FROM k) USING (token)),
    b AS (SELECT asked, how, size, farmer_id, farmer_name FROM c QUALIFY how = min(how) OVER (PARTITION BY asked)),
    s AS (SELECT asked, how, count(*) AS n, count(*) FILTER (WHERE size = top) AS n_top, min(struct_pack(i := farmer_id, m := farmer_name)) FILTER (WHERE size = top) AS w FROM (SELECT *, max(size) OVER (PARTITION BY asked) AS top FROM b) GROUP BY 1, 2),
    u AS (SELECT asked, 3 AS how, max(per) AS per, count(DISTINCT farmer_id) AS n, min(struct_pack(i := farmer_id, m := farmer_name)) AS w FROM t GROUP BY 1),
    r AS (SELECT asked, how, how = 1 OR n_top = 1 AS won, w, n FROM s UNION ALL SELECT asked, how, n = 1, w, CASE WHEN n = 1 THEN 1 ELSE greatest(per, 2) END FROM u)
    SELECT mention, CASE WHEN how IS NULL THEN 'NOT_FOUND' WHEN won THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN won THEN w.i END AS farmer_id, CASE WHEN won THEN w.m END AS farmer_name, how, CAST(coalesce(n, 0) AS BIGINT) AS n_candidates FROM a LEFT JOIN r USING (asked)""",
)
def _resolve_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.resolve_all(_asked(spark, sf_dir).select("mention"), R.farmers(spark, sf_dir))


@entry(
    "mentions_in_texts",
    f"""WITH x AS (SELECT c_custkey AS key, ' ' || {_PLAIN.format("mention")} || ' ' AS asked FROM ({_ASKED_SQL})), n AS (SELECT c_name AS name, {_PLAIN.format("c_name")} AS known FROM customer),
    w AS (SELECT key, min(name) AS mention FROM (SELECT key, name, known FROM x JOIN n ON contains(asked, ' ' || known || ' ') QUALIFY rank() OVER (PARTITION BY key ORDER BY length(known) DESC) = 1) GROUP BY key),
    t AS (SELECT DISTINCT unnest({_TOKENS_OF.format("known")}) AS token FROM n),
    f AS (SELECT key, arg_min(token, instr(asked, ' ' || token || ' ')) AS token FROM x JOIN t ON contains(asked, ' ' || token || ' ') WHERE key NOT IN (SELECT key FROM w) GROUP BY key)
    SELECT x.key, coalesce(w.mention, upper(f.token[1]) || f.token[2:]) AS mention FROM x LEFT JOIN w ON w.key = x.key LEFT JOIN f ON f.key = x.key""",
)
def _mentions_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _asked(spark, sf_dir).select(F.col("c_custkey").alias("key"), F.col("mention").alias("text"))
    return entities.mentions_in(texts, R.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))


# Answers of a model --------------------------------------------------------------------------------
_ANSWERS = [
    ('<think>{{"no"}}</think>```json\n{{"target":"MILK_RECORDS","entity":"{0}","limit":"{1}"}}\n```', "c_name", "CAST(o_orderkey % 20 AS BIGINT)"),
    ('Here: {{"type":"QUERY","entity":"{0}","limit":{1}}} - that is all }}.', "c_name", "CAST(o_orderkey % 20 AS BIGINT)"), ("nothing about {0} {1}", "NULL", "NULL"), ('{{"entity":"{0}"', "NULL", "NULL"),
]


@entry("model_answers", "SELECT o_orderkey, entity, \"limit\" FROM (SELECT o_orderkey, CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN {e}" for i, (_, e, _) in enumerate(_ANSWERS)) + " END AS entity, CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN {n}" for i, (_, _, n) in enumerate(_ANSWERS)) + " END AS \"limit\" FROM orders JOIN customer ON o_custkey = c_custkey)")
def _model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer about every order, read as a target."""
    c = R.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = R.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    answer = F.get(F.array(*(F.lit(a.format("@who", "@n")) for a, _, _ in _ANSWERS)), F.pmod("o_orderkey", F.lit(len(_ANSWERS))).cast("int"))
    answer = F.replace(F.replace(answer, F.lit("@who"), F.col("c_name")), F.lit("@n"), (F.col("o_orderkey") % 20).cast("string"))
    t = targets.canonical(targets.parsed(targets.json_object(answer)))
    return o.select("o_orderkey", t.alias("t")).select("o_orderkey", "t.entity", "t.limit")


# Many questions ------------------------------------------------------------------------------------
_QUESTIONS = "SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user'"
_ASKED_TERMS = "list_filter(regexp_split_to_array(lower(question), '[^a-zA-Z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains([{}], t))".format(", ".join(f"'{w}'" for w in sorted(retrieval.STOP_WORDS)))


_RANKED_DOCS = f"""WITH q AS (SELECT qid, {_ASKED_TERMS} AS asked FROM ({_QUESTIONS})), t AS (SELECT qid, len(asked) AS n, unnest(asked) AS term FROM q WHERE len(asked) > 0),
    d AS (SELECT doc_id AS id, lower(lang) AS lang, lower(source) AS source, lower(text) AS content FROM documents),
    h AS (SELECT term, id, CASE WHEN contains(lang, term) OR contains(source, term) THEN 3.5 ELSE 0 END + CASE WHEN contains(lang, term) THEN 2.5 ELSE 0 END + CASE WHEN contains(source, term) THEN 1.5 ELSE 0 END + CASE WHEN contains(content, term) THEN 1.0 ELSE 0 END AS w
      FROM (SELECT DISTINCT term FROM t) JOIN d ON contains(content, term) OR contains(lang, term) OR contains(source, term)),
    s AS (SELECT qid, id, least(CAST(sum(w) AS DOUBLE) / (3.0 * any_value(n)), 1.0) AS score FROM t JOIN h USING (term) GROUP BY 1, 2),
    r AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank, max(score) OVER (PARTITION BY qid) AS top FROM s)
"""


@entry(
    "retrieve_for_conversations",
    _RANKED_DOCS + "SELECT qid, rank, id, score FROM r WHERE rank <= 5 AND top >= 0.2",
)
def _retrieve_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of the conversations against every document."""
    c = R.table(spark, sf_dir, "conversations").where("role = 'user'")
    return retrieval.search_all(_corpus(spark, sf_dir), c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question")), 5)


@entry("answer_conversations", _RANKED_DOCS + f", b AS (SELECT qid, id FROM r WHERE rank = 1 AND top >= 0.2) SELECT x.qid, b.id, md5(CASE WHEN b.id IS NULL THEN '{retrieval.NO_ANSWER}' ELSE text END) AS digest FROM ({_QUESTIONS}) x LEFT JOIN b ON b.qid = x.qid LEFT JOIN documents ON doc_id = b.id")
def _answer_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document's text for every question, or that no document answers it."""
    c = R.table(spark, sf_dir, "conversations").where("role = 'user'")
    found = retrieval.answers(_corpus(spark, sf_dir), c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question")), told=lambda c: F.md5(c.cast("binary")))
    return found.select("qid", "id", F.col("answer").alias("digest"))


# Results in words ----------------------------------------------------------------------------------
_BY_NAME = "coalesce(lower(trim(farmer_name)), 'unknown')"


def _told(name: str, q: Query, sql: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return render.group_texts(q, compiler.compile(q, R.orders(spark, sf_dir), AS_OF, R.farmers(spark, sf_dir)))

    entry(name, f"WITH {R.ORDERS_SQL} {sql}")(build)


_sum = "floor(sum(quantity) * 100.0 + 0.5) / 100.0"
_told("group_texts", Query(group_by=("FARMER_NAME",), aggregations=(Aggregation("SUM", "QUANTITY"),)), f"SELECT {_BY_NAME} AS group_key, any_value(farmer_name) || ': total quantity ' || printf('%.1f', {_sum}) || ' L' AS text FROM rel GROUP BY 1")
_told("group_texts_paid", Query(group_by=("PAYMENT_STATUS",), aggregations=(Aggregation("MAX", "PAYABLE_AMOUNT"),)), "SELECT lower(payment_status) AS group_key, any_value(payment_status) || ': greatest payable amount ₹' || printf('%.2f', max(payable_amount)) AS text FROM rel GROUP BY 1")
for _way, _desc, _word in (("top", True, "highest"), ("bottom", False, "lowest")):
    _told(
        f"{_way}_1_text", Query(group_by=("FARMER_NAME",), aggregations=(Aggregation("COUNT_RECORDS"),), order=Order("QUANTITY", "SUM", _desc), limit=1),
        f"SELECT {_BY_NAME} AS group_key, any_value(farmer_name) || ' had the {_word}: ' || CAST(count(*) AS VARCHAR) || ' records.' AS text FROM rel GROUP BY 1 ORDER BY {_sum} {'DESC' if _desc else 'ASC'}, 1 LIMIT 1",
    )
