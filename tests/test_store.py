"""Records as stored state, and live lists over them."""

from __future__ import annotations

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyloom.sources.scratch import shared_folder
from tallyloom.sources.store import create
from tallyloom.streaming import rows as live

SCHEMA = "id string, farmer_name string, payment_status string, upload_status string, v long"


def record(i, name="Asha", paid="PENDING", up="PENDING", v=0):
    return (f"r{i}", name, paid, up, v)


def files(store):
    """Files of each bucket and their sizes."""
    top = Path(store.path.removeprefix("file://"))
    return {d.name: {p.name: os.path.getsize(p) for p in d.iterdir() if p.suffix == ".parquet"} for d in top.iterdir() if d.is_dir() and "=" in d.name}


def changed(before, after):
    """(buckets with other files, bytes in them)."""
    other = [b for b in after if after[b] != before.get(b)]
    return len(other), sum(sum(after[b].values()) for b in other)


@pytest.fixture
def store(spark):
    return create(spark.createDataFrame([record(i, f"Asha {i % 5}") for i in range(5000)], SCHEMA), shared_folder(spark, "store"), "id", 50)


def rows_of(store, spark):
    return {r.id: tuple(r) for r in store.read(spark).collect()}


def test_a_change_writes_the_buckets_it_touches(spark, store):
    have, sizes = rows_of(store, spark), files(store)
    whole = sum(sum(b.values()) for b in sizes.values())
    assert len(sizes) == 50 and all(len(b) == 1 for b in sizes.values())
    changes = [record(7, "Ravi", v=1), record(7, "Rao", v=3), record(7, "Li", v=2), record(9999, "New", v=1)]
    n = store.upsert(spark.createDataFrame(changes, SCHEMA), "v")
    now = files(store)
    touched, written = changed(sizes, now)
    assert n == touched <= 2 and written < 0.1 * whole
    assert rows_of(store, spark) == have | {"r7": record(7, "Rao", v=3), "r9999": record(9999, "New", v=1)}
    # Three rows by id, one of which doesn't fit; then nothing at all.
    ids = spark.createDataFrame([("r1",), ("r2",), ("r2",), ("gone",), (None,)], "x string")
    before = files(store)
    assert store.update(spark, F.col("farmer_name") != "Asha 2", {"payment_status": F.lit("PAID"), "v": F.col("v") + 5}, ids) == 1
    assert changed(before, files(store))[0] == 1 and store.lookup(spark, "r1").first() == record(1, "Asha 1", "PAID", v=5)
    before = files(store)
    assert store.update(spark, F.lit(None).cast("boolean"), {"v": F.lit(1)}) == 0 and store.upsert(spark.createDataFrame([], SCHEMA)) == 0
    assert files(store) == before
    plan = store.lookup(spark, "r2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan.split("PartitionFilters")[1][:60]
    assert [r.id for r in store.among(ids).orderBy("id").collect()] == ["r1", "r2"]
    assert store.update(spark, F.lit(True), {"upload_status": F.lit("UPLOADED")}) == 5001
    with pytest.raises(ValueError, match="without id"):
        store.upsert(spark.createDataFrame([(None, "x", "", "", 1)], SCHEMA))


def test_a_store_of_nothing(spark):
    store = create(spark.createDataFrame([], SCHEMA), shared_folder(spark, "store"), "id", 4)
    assert store.read(spark).collect() == [] and store.update(spark, F.lit(True), {"v": F.lit(1)}) == 0
    assert store.upsert(spark.createDataFrame([record(1)], SCHEMA)) == 1 and rows_of(store, spark) == {"r1": record(1)}


def wanted(rows, p):
    _, name, paid, up, active, _ = p
    low = lambda x: (x or "").strip()
    return {r[0] for r in rows if active and (name or "").lower() in r[1].lower() and low(paid) in ("", r[2]) and low(up) in ("", r[3])}


def test_live_lists_follow_records_and_parameters(spark, tmp_path):
    """Random batches of records and parameters: what each reader was told adds up to a query over all rows; a batch opens only its buckets."""
    rnd = random.Random(6)
    store = create(spark.createDataFrame([record(i) for i in range(30)], SCHEMA), shared_folder(spark, "store"), "id", 16)
    folder = shared_folder(spark, "live")
    places = {n: f"{tmp_path}/{n}" for n in ("records", "parameters")}
    empty = {"records": SCHEMA, "parameters": live.PARAMETERS}
    for n, p in places.items():
        spark.createDataFrame([], empty[n]).coalesce(1).write.parquet(p)
    lists, told = {}, []

    def emit(df, number):
        rows = df.collect()
        told.append((number, len(rows)))
        for r in sorted(rows, key=lambda r: r.change != "reset"):
            own = lists.setdefault(r.reader, {})
            if r.change == "reset":
                own.clear()
            elif r.change == "put":
                own[r.row.id] = tuple(r.row)
            else:
                del own[r.row.id]

    streams = {n: spark.readStream.schema(empty[n]).parquet(p) for n, p in places.items()}
    query = live.follow(spark, streams["records"], streams["parameters"], store, "v", emit, folder)
    rows, readers, v = {f"r{i}": record(i) for i in range(30)}, {}, 0
    try:
        for turn in range(4):
            batch, ask = [], []
            for _ in range(rnd.randrange(1, 8) if turn else 0):
                v += 1
                r = record(rnd.randrange(40), rnd.choice(["Asha", "Ravi"]), rnd.choice(["PENDING", "PAID"]), rnd.choice(["PENDING", "UPLOADED"]), v)
                rows[r[0]] = r
                batch.append(r)
            for reader in rnd.sample(["a", "b", "c"], 3 if turn == 0 else turn % 2):
                v += 1
                p = (reader, rnd.choice(["", "ash", None]), rnd.choice([None, "PAID"]), rnd.choice(["", "PENDING"]), turn != 3, v)
                readers[reader] = p
                ask.append(p)
            for n, some in (("records", batch), ("parameters", ask)):
                if some:
                    spark.createDataFrame(some, empty[n]).coalesce(1).write.mode("append").parquet(places[n])
            query.processAllAvailable()
            assert rows_of(store, spark) == rows
            for reader, p in readers.items():
                assert set(lists.get(reader, {})) == wanted(rows.values(), p) and all(lists[reader][k] == rows[k] for k in lists[reader])
    finally:
        query.stop()


def test_a_batch_that_is_run_again_tells_the_same(spark):
    store = create(spark.createDataFrame([record(i) for i in range(20)], SCHEMA), shared_folder(spark, "store"), "id", 8)
    known = spark.createDataFrame([("a", "", "PENDING", None, True, 1)], live.PARAMETERS)
    none, path = known.limit(0), shared_folder(spark, "told")
    batch = spark.createDataFrame([record(1, paid="PAID", v=1), record(2, v=1), record(30, v=1)], SCHEMA)
    tell = lambda: sorted((r.reader, r.change, r.row.id) for r in live.apply(store, known, batch, none, "v", path)[0].collect())
    first = tell()
    assert first == [("a", "put", "r2"), ("a", "put", "r30"), ("a", "remove", "r1")] and tell() == first
    assert store.read(spark).count() == 21
