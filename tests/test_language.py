"""The query language on small tables: three-valued resolution, two-valued filters, periods, parsing, validation."""

from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom import model
from tallyloom.functions import columns as C
from tallyloom.functions import extraction as X
from tallyloom.model import Aggregation, Conditional, Filter, Having, Order, Period, Query
from tallyloom.operators import dataset, retrieval, similar
from tallyloom.plans import compiler, entities, predicates, temporal
from tallyloom.plans.entities import match_all, mention_in, normalize, resolve
from tallyloom.plans.questions import parse
from tallyloom.plans.validate import query_errors, record_errors, split_valid
from tallyloom.sources import relations as R
from tallyloom.streaming import live

NOW, YESTERDAY = datetime(2026, 9, 28, 12), datetime(2026, 9, 27, 12)


@pytest.fixture(scope="module")
def records(spark):
    row = lambda i, f, name, q, fat, snf, s, m=None, ref=None, paid_at=None, due=None, paid=None, at=NOW, org="ORG001": (i, org, "WORKER001", f, name, q, fat, snf, s, m, ref, paid_at, due, paid, at, at, "PENDING")
    rows = [
        row("rec-1", "farmer-1", "Suresh Kumar", 25.0, 4.6, 8.6, "RECORDED_LOCALLY", "UPI", "UPI-7788", datetime(2026, 9, 28, 11), 950.0, 950.0),
        row("rec-2", "farmer-2", "Suresh Gowda", 15.0, 4.1, 8.4, "PENDING", due=550.0, at=YESTERDAY),
        row("rec-3", "farmer-3", "Ramesh Naik", 22.5, 4.8, 8.7, "PENDING", due=880.0),
        row("rec-null", None, "Guest", 12.0, 4.0, 8.5, "PENDING", "upi", at=YESTERDAY, org=""),
        row("rec-foreign", "farmer-99", "Far Away", 30.0, 4.0, 8.0, "PENDING", org="ORG_OTHER"),
    ]
    return spark.createDataFrame(rows, R.RECORD).cache()


@pytest.fixture(scope="module")
def registry(spark):
    names = [("farmer-1", "Suresh Kumar"), ("farmer-2", "Suresh Gowda"), ("farmer-3", "Ramesh Naik"), ("farmer-4", "Mahesh"), ("farmer-5", "Old One")]
    return spark.createDataFrame([(i, n, normalize(n), NOW, i != "farmer-5") for i, n in names], R.FARMER).cache()


def run(records, registry, **q):
    return compiler.compile(Query(**q), records, NOW, registry, org="ORG001", worker="WORKER001")


@pytest.mark.parametrize(
    ("mention", "status", "who"),
    [
        ("  ramesh   naik  ", "RESOLVED", "Ramesh Naik"), ("Ramesh Naik's", "RESOLVED", "Ramesh Naik"), ("Ramesh", "RESOLVED", "Ramesh Naik"), ("Suresh", "AMBIGUOUS", None), ("Naik of Ramesh", "RESOLVED", "Ramesh Naik"),
        ("NonexistentFarmer", "NOT_FOUND", None), ("", "NOT_FOUND", None), ("   ", "NOT_FOUND", None), ("Old One", "NOT_FOUND", None),
    ],
)
def test_resolution(registry, mention, status, who):
    found = resolve(registry, mention)
    assert (found.status, found.farmer_name) == (status, who)


def test_the_longest_containing_name_wins(spark):
    both = spark.createDataFrame([("1", "Suresh", "suresh", NOW, True), ("2", "Suresh Kumar", "suresh kumar", NOW, True)], R.FARMER)
    assert resolve(both, "Suresh Kumar").farmer_id == "2"
    assert resolve(both, "Suresh").farmer_id == "1"
    assert resolve(both, "suresh kumar gowda").farmer_id == "2"


def test_token_matching_set_at_a_time(spark, registry):
    mentions = spark.createDataFrame([("suresh",), ("nobody",)], "mention string")
    assert {tuple(r) for r in match_all(mentions, registry).collect()} == {("suresh", "farmer-1"), ("suresh", "farmer-2")}


def test_tokens_that_all_names_share(spark, sf_dir, monkeypatch):
    from tallyloom.operators import registry as engine

    assert engine.queries()["mentions_match"](spark, sf_dir).count() == 15 * 1500  # each name asked for against all
    monkeypatch.setattr(entities, "DEALT", 7)
    known = [(str(i % 90), f"farmer {i % 4}x {i}") for i in range(100)]
    asked = ["Farmer 3x", "farmer 2x 17", "2x", "95", "nobody", "farmer farmer", None]
    found = match_all(spark.createDataFrame([(m,) for m in asked * 2], "mention string"), spark.createDataFrame(known, "farmer_id string, normalized_name string"))
    want = {(m, i) for m in asked if m for i, n in known if set(m.lower().split()) & {t for t in n.split() if len(t) > 1}}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_statuses_are_not_empty_results(records, registry):
    assert run(records, registry, mention="Suresh", specific=True).status == "AMBIGUOUS"
    assert run(records, registry, mention="Nobody", specific=True).status == "NOT_FOUND"
    assert run(records, registry, limit=0).status == "INVALID"
    assert run(records, registry, request="UNSUPPORTED", unsupported_reason="no").status == "UNSUPPORTED"


def ids(made):
    return {r.id for r in made.df.collect()}


def test_scope_entity_period_filters(records, registry):
    assert ids(run(records, registry)) == {"rec-1", "rec-2", "rec-3", "rec-null"}
    assert ids(run(records, registry, mention="ramesh", specific=True)) == {"rec-3"}
    assert ids(run(records, registry, time=Period("RELATIVE", "TODAY"))) == {"rec-1", "rec-3"}
    assert ids(run(records, registry, time=Period("RELATIVE", "YESTERDAY"))) == {"rec-2", "rec-null"}
    assert len(ids(run(records, registry, time=Period("RANGE", None, "2020-01-01", "2030-12-31")))) == 4
    assert ids(run(records, registry, filters=(Filter("FAT", "GREATER_THAN", "4.5"), Filter("PAYMENT_STATUS", "EQUALS", "pending")))) == {"rec-3"}
    assert ids(run(records, registry, filters=(Filter("FAT", "GREATER_THAN", "4.7"), Filter("PAYMENT_METHOD", "EQUALS", "Upi")), any_filter=True)) == {"rec-1", "rec-3", "rec-null"}


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (Filter("PAYMENT_METHOD", "NOT_EQUALS", "UPI"), {"rec-2", "rec-3"}), (Filter("PAYMENT_METHOD", "IS_NULL"), {"rec-2", "rec-3"}), (Filter("PAYMENT_METHOD", "CONTAINS", "PI"), {"rec-1", "rec-null"}),
        (Filter("QUANTITY", "EQUALS", "25.0"), {"rec-1"}), (Filter("QUANTITY", "EQUALS", "25"), set()), (Filter("AMOUNT_PAID", "LESS_THAN", "1000"), {"rec-1"}), (Filter("QUANTITY", "IN_RANGE", "15", "22.5"), {"rec-2", "rec-3"}),
        (Filter("QUANTITY", "IN_RANGE", "x", "22.5"), set()), (Filter("PAYMENT_TIMESTAMP", "GREATER_THAN", "0"), {"rec-1"}), (Filter("PAYMENT_STATUS", "EQUALS", "PAID"), set()),
    ],
)
def test_filters_are_two_valued(records, f, want):
    rows = records.where("org_id != 'ORG_OTHER'")
    hit, miss = rows.where(predicates.condition(f)), rows.where(~predicates.condition(f))
    assert {r.id for r in hit.collect()} == want
    assert miss.count() == 4 - len(want)


def test_groups_aggregates_and_reports(records, registry):
    top = run(records, registry, group_by=("FARMER_NAME",), aggregations=(Aggregation("SUM", "QUANTITY"),), order=Order("QUANTITY", "SUM"), limit=1).df.collect()
    assert [(r.display, r.sum_quantity) for r in top] == [("Suresh Kumar", 25.0)]
    having = run(records, registry, group_by=("FARMER_NAME",), aggregations=(Aggregation("SUM", "QUANTITY"),), having=Having("SUM", "QUANTITY", "GREATER_THAN", 20.0)).df
    assert {r.display for r in having.collect()} == {"Suresh Kumar", "Ramesh Naik"}
    methods = {r.group_key: (r.display, r.count_records) for r in run(records, registry, group_by=("PAYMENT_METHOD",)).df.collect()}
    assert methods["unknown"] == ("Unknown", 2) and methods["upi"][1] == 2
    one = run(records, registry, aggregations=(Aggregation("SUM"), Aggregation("AVG", "AMOUNT_PAID"), Aggregation("MIN", "AMOUNT_PAID"), Aggregation("COUNT_DISTINCT_FARMERS"), Aggregation("COUNT_RECORDS"))).df.first()
    assert tuple(one) == (74.5, 237.5, 0.0, 3, 4)
    assert run(records, registry, aggregations=(Aggregation("SUM"),), filters=(Filter("QUANTITY", "GREATER_THAN", "999"),)).df.count() == 0
    limited = run(records, registry, aggregations=(Aggregation("SUM"),), order=Order("QUANTITY"), limit=2).df.first()
    assert limited[0] == 47.5
    assert tuple(run(records, registry, exists=True, limit=1, filters=(Filter("FAT", "GREATER_THAN", "4"),)).df.first()) == (True, 3)
    paid = run(records, registry, mention="Suresh Kumar", specific=True, conditional=Conditional()).df.first()
    assert (paid.matched, paid.payment_method, paid.payable_amount) == (True, "UPI", None)
    due = run(records, registry, mention="Ramesh Naik", specific=True, conditional=Conditional()).df.first()
    assert (due.matched, due.payment_status, due.payable_amount) == (False, "PENDING", 880.0)
    assert run(records, registry, mention="Suresh Kumar", specific=True, scope="ALL").df.first().all_paid is True
    assert run(records, registry, mention="Ramesh Naik", specific=True, scope="ANY").df.first().any_paid is False


@pytest.mark.parametrize(
    ("as_of", "period", "start", "end"),
    [
        ("1998-08-19 12:00", "THIS_WEEK", "1998-08-17", "1998-08-20 12:00:00.001"), ("1998-08-19 12:00", "LAST_WEEK", "1998-08-10", "1998-08-17"), ("1998-08-19 12:00", "LAST_MONTH", "1998-07-01", "1998-08-01"),
        ("1998-08-19 12:00", "LAST_SUNDAY", "1998-08-16", "1998-08-17"), ("1998-08-16 09:00", "LAST_SUNDAY", "1998-08-16", "1998-08-17"), ("1998-08-16 09:00", "THIS_WEEK", "1998-08-10", "1998-08-17 09:00:00.001"),
        ("1998-08-17 00:00", "SINCE_MONDAY", "1998-08-17", "1998-08-18 00:00:00.001"), ("1998-01-01 05:00", "LAST_MONTH", "1997-12-01", "1998-01-01"), ("1998-03-01 05:00", "YESTERDAY", "1998-02-28", "1998-03-01"),
        ("1998-08-01 05:00", "THIS_MONTH", "1998-08-01", "1998-08-02 05:00:00.001"), ("1998-08-19 12:00", "TODAY", "1998-08-19", "1998-08-20"),
    ],
)
def test_periods(as_of, period, start, end):
    at = datetime.fromisoformat
    assert temporal.bounds(Period("RELATIVE", period), at(as_of)) == (at(start), at(end))


def test_dates_and_period_words():
    assert [str(temporal.parse_date(d)) for d in ("2026-09-05", "05/09/2026", "05-09-2026", "2026/09/05")] == ["2026-09-05"] * 4
    assert temporal.parse_date("2026-9-5") is None and temporal.parse_date("2026-09-28xyz") is None
    assert temporal.from_text("what came on 28/09/2026 today?").start == "28/09/2026"
    assert temporal.from_text("weekly total").period == "THIS_WEEK" and temporal.from_text("nothing") is None
    assert temporal.parse_token("previous week") == "LAST_WEEK" and temporal.parse_token("sunday") == "LAST_SUNDAY"


def test_predicates_reach_the_scan(spark, sf_dir):
    plan = R.orders(spark, sf_dir, False).where(temporal.within("created_at", datetime(1997, 1, 1), datetime(1997, 2, 1)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "lineitem" not in text


def test_json_forms():
    text = 'so {not json} <think>{"a": 1}</think>```json\n{"requestType": "QUERY", "aggregations": [{"type": "COUNT"}], "groupBy": ["farmer name", "x"], "havingFilter": {"agg": "SUM", "field": "QUANTITY", "op": "GREATER_THAN", "value": 3}, "paymentScope": "ALL", "filters": [{"field": "FAT", "op": "GREATER_THAN", "value": 4.5}, {"field": "?", "op": "EQUALS"}], "limit": 2} trailing'
    q = model.from_json(text)
    assert q.aggregations == (Aggregation("COUNT_RECORDS"),) and q.group_by == ("FARMER_NAME",) and q.having.value == 3.0 and q.scope == "ALL"
    assert q.filters == (Filter("FAT", "GREATER_THAN", "4.5"),) and q.limit == 2
    assert model.from_json("no object here") is None
    assert model.canonical(Query(select=("FAT", "SNF", "FAT"))) == model.canonical(Query(select=("SNF", "FAT")))


def test_questions():
    names = ["Ramesh Naik", "Suresh Kumar"]
    assert parse("Ramesh gave 18.5 litres, fat 4.2 and SNF 8.6. Payment is pending.").write_args["quantity"] == "18.5"
    asked = parse("Which farmers gave more than 20 litres yesterday?")
    assert asked.request == "QUERY" and asked.filters == (Filter("QUANTITY", "GREATER_THAN", "20"),) and asked.time.period == "YESTERDAY"
    most = parse("Who gave the most milk this week?")
    assert (most.group_by, most.limit, most.order.aggregation) == (("FARMER_NAME",), 1, "SUM")
    assert parse("How much did Suresh Kumar give today?", names).mention == "Suresh Kumar" and mention_in("and ramesh?", names) == "Ramesh"
    assert parse("What is the rejection policy?").target == "KNOWLEDGE_BASE" and parse("who am i").target == "WORKER_PROFILE"
    assert parse("Why was Suresh paid late?").request == "UNSUPPORTED"
    assert not query_errors(most)


@pytest.mark.parametrize(
    "q",
    [
        Query(specific=True), Query(aggregations=(Aggregation("SUM", "FARMER_NAME"),)), Query(filters=(Filter("FARMER_NAME", "GREATER_THAN", "1"),)), Query(filters=(Filter("FAT", "CONTAINS", "1"),)), Query(filters=(Filter("FAT", "IN_RANGE", "1"),)),
        Query(group_by=("QUANTITY",)), Query(having=Having("SUM", "QUANTITY", "GREATER_THAN", 1)), Query(group_by=("FARMER_NAME",), having=Having("SUM", "QUANTITY", "CONTAINS", 1)), Query(order=Order("QUANTITY", "SUM")), Query(order=Order("FARMER_ID")),
        Query(time=Period("DATE", None, "soon")), Query(time=Period("RANGE", None, "2026-01-02", "2026-01-01")), Query(limit=0), Query(target="KNOWLEDGE_BASE"), Query(request="WRITE"), Query(request="CLARIFY"), Query(request="UNSUPPORTED"),
    ],
)
def test_invalid_queries(q):
    assert query_errors(q)


def test_record_errors(spark):
    rows = [("ok", "18.0", "4.2", "8.6", "PENDING", None, None, ""), ("", "abc", "25", "-1", "UNKNOWN", None, None, "name,quantity,fat,snf,status"), ("x", "1001", "4", "8", "PAID", "UPI", " ", "name,quantity,reference"), ("Asha", "0.0", "4", "8", "PAID", "CASH", "", "quantity"), (None, None, None, None, None, None, None, "name,quantity,fat,snf,status"), ("Asha", "5", "4", "8", "PAID", "BANK_TRANSFER", "NEFT-1", "")]
    df = spark.createDataFrame(rows, "n string, q string, f string, s string, st string, m string, r string, want string")
    errors = record_errors(*(F.col(c) for c in ("n", "q", "f", "s", "st", "m", "r")))
    assert all(r.got == r.want for r in df.select(F.array_join(errors, ",").alias("got"), "want").collect())
    good, bad = split_valid(df, errors)
    assert (good.count(), bad.count()) == (2, 4)


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(C.payable_amount(F.lit(18.0), F.lit(4.2), F.lit(8.6))) == 702.0
    assert value(C.half_up(F.lit(1.005))) == 1.0
    assert value(C.normalized_name(F.lit("  Ramesh   NAIK's. "))) == "ramesh naik"
    assert normalize("Ramesh Naik's") == "ramesh naik"
    names = spark.createDataFrame([(i, "A. B") for i in range(5)], "i long, n string").select(C.varied_spelling(F.col("n"), F.col("i")))
    assert [r[0] for r in names.collect()] == ["A. B", "a. b", "A. B", "A B", "A.  B"]


def test_capitals_are_those_of_sql(spark, duck, tmp_path):
    """Of every letter; upper() has two letters for ß and some others, and its SQL one."""
    letters = [chr(i) for i in range(1, 0x1F000) if not 0xD800 <= i < 0xE000] + ["", "a\u0301", "\u0301a", None]
    path = str(tmp_path / "letters.parquet")
    spark.createDataFrame([(c and c + "xß",) for c in letters], "t string").coalesce(1).write.parquet(path)
    want = duck.execute(f"SELECT t, upper(t[1]) || t[2:] FROM '{path}/*.parquet'").fetchall()
    got = [tuple(r) for r in spark.read.parquet(path).select("t", C.capitalized(F.col("t"))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and ("ßxß", "ẞxß") in got
    assert mention_in("ßeta came", ["ßeta"]) == "ßeta" and mention_in("for ßeta", ["ßeta rao"]) == "ẞeta"


def test_extraction(spark):
    said = "Ramesh gave 18.5 litres, fat 4.2 and SNF 8.6. Payment is pending."
    df = spark.createDataFrame([(said, "18", "4"), ("Ramesh gave 80 litres.", None, "0.0"), ("22 liters", "22.0", None), (None, None, None)], "t string, q string, f string")
    got = df.select(X.reconciled(X.quantity(F.col("t")), F.col("q")), X.reconciled(X.fat(F.col("t")), F.col("f")), X.name(F.col("t"), F.lit("")), X.payment(F.col("t"))["status"], X.draft(F.col("t"))["snf"]).collect()
    assert [tuple(r) for r in got] == [("18.5", "4.2", "Ramesh", "PENDING", "8.6"), ("80", None, "Ramesh", None, ""), ("22.0", None, None, None, ""), (None, None, None, None, None)]


def test_retrieval(spark):
    docs = spark.createDataFrame([("A", "Handbook", "Payment Settlement", "Payment is complete when", ["payment", "paid"]), ("B", "Manual", "Quality", "minimum fat", ["quality"])], "id string, document_title string, section_title string, content string, keywords array<string>")
    assert [r.id for r in retrieval.search(docs, "When is payment considered complete?", bonuses=[retrieval.Bonus("A", (("payment",), ("complete",)))]).collect()] == ["A"]
    assert retrieval.search(docs, "capital of France").count() == 0 and retrieval.search(docs, " ").count() == 0


def test_dataset_operators(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "a", "Hello there"), (2, "b", " hello THERE "), (3, "b", "x y z"), (4, "a", None)], "i long, split string, p string")
    assert {r.i for r in dataset.first_of_prompt(prompts, "p", "i").collect()} == {1, 3}
    assert [tuple(r) for r in dataset.exact_overlaps(prompts, "split", "p").collect()] == [("a", "b", "hello there")]
    a = spark.createDataFrame([(1, "schön ist das Leben"), (2, "ganz anders")], "id long, text string")
    assert sorted(tuple(r) for r in similar.near_duplicates(a, a.withColumn("id", F.col("id") + 10), 92).collect()) == [(1, 11, 1.0), (2, 12, 1.0)]
    R.write_jsonl(prompts, f"{tmp_path}/out", "split")
    assert R.read_jsonl(spark, f"{tmp_path}/out/split=b", prompts.drop("split").schema).count() == 2


def test_live_equals_batch(spark, records, tmp_path):
    records.limit(3).write.parquet(f"{tmp_path}/in")
    count = lambda df: df.groupBy("payment_status").agg(F.count(F.lit(1)).alias("n"))
    q = live.follow(spark, f"{tmp_path}/in", records.schema, count, "followed")
    try:
        q.processAllAvailable()
        records.where("id = 'rec-foreign'").write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
        want = {tuple(r) for r in count(spark.read.parquet(f"{tmp_path}/in")).collect()}
        assert {tuple(r) for r in spark.table("followed").collect()} == want
    finally:
        q.stop()
    seen = []
    again = live.on_change(spark, f"{tmp_path}/in", records.schema, count, lambda df, _: seen.append({tuple(r) for r in df.collect()}), f"{tmp_path}/check")
    try:
        again.processAllAvailable()
        assert seen[-1] == want
    finally:
        again.stop()


@settings(max_examples=40, deadline=None)
@given(st.dates(datetime(1990, 1, 2).date(), datetime(2030, 1, 1).date()), st.sampled_from(model.PERIODS))
def test_period_bounds_hold_together(day, period):
    start, end = temporal.bounds(Period("RELATIVE", period), datetime(day.year, day.month, day.day, 13))
    assert start < end and start.time() == datetime.min.time()
    assert start <= datetime(day.year, day.month, day.day, 13)


def test_asking(spark, records, registry):
    from tallyloom.engine import Engine, Profile

    docs = spark.createDataFrame([("A", "Handbook", "Rejection", "Spoiled milk is rejected.", ["rejected", "rejection"])], "id string, document_title string, section_title string, content string, keywords array<string>")
    me = Profile("WORKER001", "ORG001", "Asha", "Center 1", "Route 2", ("record",))
    e = Engine(records, registry, me, NOW, docs, "The union", ("Suresh Kumar", "Suresh Gowda", "Ramesh Naik"))
    assert e.ask("Who gave the most milk?").text == "Suresh Kumar had the highest: total quantity 25.0 L."
    assert e.ask("How much did Ramesh Naik give today?").text == "Total quantity 22.5 L."
    assert e.ask("Was Suresh paid?").text.startswith("Several names match: Suresh Gowda, Suresh Kumar")
    assert e.ask('{"entity": {"mention": "Nobody"}, "exists": true}').text == "Nobody isn't in the registry."
    assert e.ask('{"filters": [{"field": "FAT", "op": "GREATER_THAN", "value": 4.5}], "exists": true}').text == "Yes, 2 records match."
    assert e.ask('{"entity": {"mention": "Suresh Kumar"}, "paymentScope": "ALL"}').text == "All 1 payments are completed."
    assert e.ask('{"entity": {"mention": "Ramesh Naik"}, "paymentScope": "ANY"}').text == "No payment has been received."
    assert "Center 1" in e.ask("who am i").text and e.ask("which union is it").text == "The union"
    assert e.ask("What is the rejection policy?").text == "Spoiled milk is rejected."
    low = e.run(Query(group_by=("FARMER_NAME",), aggregations=(Aggregation("SUM", "QUANTITY"),), order=Order("QUANTITY", "SUM", False), limit=1))
    assert low.text == "Guest had the lowest: total quantity 12.0 L."
    assert e.run(Query(limit=0)).made.status == "INVALID" and me.frame(spark).first().permissions == ["record"]


def test_partitions_and_reports(spark, tmp_path):
    from tallyloom.sources import reports

    made = dataset.generated(spark.range(12), "id", "How much did {who} give {when}?", {"who": ["Asha", "Ravi"], "when": ["today", "this week"]}).withColumn("category", F.when(F.col("gen_idx") % 2 == 0, "a").otherwise("b"))
    quotas = spark.createDataFrame([("a", 1), ("b", 5)], "category string, quota int")
    errors = dataset.fidelity_errors(F.col("prompt"), period=F.lit("TODAY"))
    filled, lacking = dataset.build_partition(made, errors, quotas, ["category"])
    assert {r.prompt for r in filled.collect()} == {"How much did Asha give today?", "How much did Ravi give today?"}
    assert [tuple(r) for r in lacking.collect()] == [("b", 4)]
    reports.write_json(f"{tmp_path}/r.json", lacking=lacking)
    reports.write_markdown(f"{tmp_path}/r.md", "Audit", lacking=lacking)
    assert '"lacks": 4' in (tmp_path / "r.json").read_text() and "| b | 4 |" in (tmp_path / "r.md").read_text()


def test_answers_that_are_malformed():
    q = model.from_json('{"havingFilter": {"op": "EQUALS"}, "limit": "many", "orderBy": 3, "filters": [1], "aggregations": ["SUM"], "writeArgs": [], "conditionalSpec": {}}')
    assert q == Query(conditional=Conditional())
    q = model.from_json({"limit": "7", "havingFilter": {"agg": "count", "op": "greater_than", "value": "2"}})
    assert q.limit == 7 and q.having == Having("COUNT_RECORDS", "QUANTITY", "GREATER_THAN", 2.0)


def test_numbers_are_plain():
    assert [predicates.number(x) for x in ("1_000", "nan", "inf", "", None, "0x1", " -2.5e1 ", ".5")] == [None] * 6 + [-25.0, 0.5]


def test_ambiguous_names_are_counted(spark):
    names = spark.createDataFrame([(str(i), f"Asha {i:03d}", f"asha {i:03d}", None, True) for i in range(70)], R.FARMER)
    found = resolve(names, "asha")
    assert found.status == "AMBIGUOUS" and found.n_candidates == 70 and len(found.candidates) == 50 and found.candidates[0] == "Asha 000"


def test_decomposed_names_match(spark):
    names = spark.createDataFrame([("1", "José", "jose\u0301", None, True)], R.FARMER)
    assert resolve(names, "JOSÉ").farmer_id == "1"


def test_seed(spark):
    from tallyloom.sources.seed import seed, seeded

    farmers, rows = seed(spark, datetime(2026, 1, 2, 12))
    assert farmers.columns == R.FARMER.names and rows.columns == R.RECORD.names and rows.count() == 3
    assert seeded(farmers.limit(0), rows.limit(0), datetime(2026, 1, 2, 12))[0].count() == 3
    assert seeded(farmers.limit(1), rows.limit(0), datetime(2026, 1, 2, 12))[1].count() == 0


def test_a_live_query_outlives_its_last_reader_for_a_while():
    import time

    class Made:
        stopped = False

        def stop(self):
            self.stopped = True

    made = []
    shared = live.Shared(lambda: made.append(Made()) or made[-1], grace=0.5)
    with shared as a, shared as b:
        assert a is b
    with shared as c:  # back in time
        assert c is a
        time.sleep(0.8)
        assert not a.stopped
    time.sleep(1.2)
    assert a.stopped
    with shared as d:
        assert d is not a and len(made) == 2


def test_insertions_one_after_another(spark):
    """Sets of rows that collide in two keys, against inserting them one by one."""
    import random

    rnd = random.Random(3)
    for _ in range(4):
        rows = [(rnd.choice("abcdef"), rnd.choice("uvwxyz"), i) for i in range(12)]
        want, seen_a, seen_b = set(), {"a"}, {"u"}
        for a, b, i in rows:
            if a not in seen_a and b not in seen_b:
                want.add((a, b, i))
                seen_a.add(a)
                seen_b.add(b)
        have = spark.createDataFrame([("a", "u", -1)], "a string, b string, i int")
        got = R.insert_absent(have, spark.createDataFrame(rows, "a string, b string, i int"), ["a", "b"], "i")
        assert {tuple(r) for r in got.collect()} == want | {("a", "u", -1)}


def one_by_one(have, rows):
    """What inserting rows one after another leaves: a null key collides with nothing."""
    seen, out = [{r[k] for r in have if r[k] is not None} for k in (0, 1)], list(have)
    for r in sorted(rows, key=lambda r: r[2]):
        if not any(r[k] is not None and r[k] in seen[k] for k in (0, 1)):
            out.append(r)
            for k in (0, 1):
                seen[k].add(r[k])
    return sorted(out, key=str)


def test_insert_of_a_long_chain(spark):
    """Each row collides with the one before it; in rounds alone that would be 5,000 of them."""
    rows = [(f"f{i // 2}", f"n{(i + 1) // 2}", i) for i in range(10_000)]
    schema = "a string, b string, i int"
    have, new = spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)
    got = R.insert_absent(have, new, ["a", "b"], "i")
    assert sorted((tuple(r) for r in got.collect()), key=str) == one_by_one([], rows)
    size = len(got._jdf.queryExecution().toString())
    parts = R.insert_absent(have, new, ["a", "b"], "i", in_order=3000)  # several steps of rounds and rows in order
    assert sorted((tuple(r) for r in parts.collect()), key=str) == one_by_one([], rows)
    assert len(parts._jdf.queryExecution().toString()) < 1.2 * size


@pytest.mark.parametrize("in_order", [1, 7, 1000])
def test_insert_of_odd_keys(spark, in_order):
    """Null keys, rows that are repeated, one key that a third of all rows have, keys that are there already."""
    import random

    rnd = random.Random(in_order)
    rows = [(None if i % 17 == 0 else "hot" if i % 3 == 0 else f"a{rnd.randrange(40)}", None if i % 13 == 0 else f"b{rnd.randrange(60)}", i) for i in range(150)]
    rows += [rows[5], rows[0]]
    have = [("a1", "b1", -1), (None, "b2", -2), ("a3", None, -3)]
    schema = "a string, b string, i int"
    got = R.insert_absent(spark.createDataFrame(have, schema), spark.createDataFrame(rows, schema), ["a", "b"], "i", in_order)
    assert sorted((tuple(r) for r in got.collect()), key=str) == one_by_one(have, rows)
    none = R.insert_absent(spark.createDataFrame(have, schema), spark.createDataFrame([], schema), ["a", "b"], "i", in_order)
    assert none.count() == 3


def test_splits_share_no_names():
    from tallyloom.operators import generation

    names = [n for s in generation.SPLITS for n in (*generation.vocabulary(s), *generation.strangers(s))]
    assert len(names) == len(set(names)) and all((len(generation.vocabulary(s)), len(generation.strangers(s))) == n for s, n in generation.SPLITS.items())
    assert [sum(generation.quotas(s).values()) for s in ("pilot", "train", "validation")] == [500, 5950, 850]


def test_examples_follow_the_rules(spark):
    from tallyloom.operators import generation, targets

    rows = generation.examples(spark, "test", 3000).withColumn("t", targets.canonical(targets.parsed("target")))
    reasons = {e for r in targets.checked(rows, "prompt", "t", "gen_idx").select("errors").distinct().collect() for e in r.errors}
    assert reasons <= {"duplicate_prompt"}
    assert {r.c for r in rows.select(targets.category_id(F.col("category"), F.col("register")).alias("c")).distinct().collect()} == set(range(1, 47))
    odd = spark.createDataFrame([("",), ("no json",), (None,), ("[]",), ("{}",)], "x string").select(targets.canonical(targets.parsed("x")).alias("t"))
    assert [targets_ok for r in odd.select(F.size(targets.errors(F.col("t"))).alias("n")).collect() for targets_ok in [r.n]][-1] == 0
