from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

TOP = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, TOP)
os.environ["PYTHONPATH"] = os.pathsep.join([TOP, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same_rows(df, con, sql: str) -> None:
    """Rows and columns of a DataFrame equal those of a query, in any order."""
    columns = sorted(df.columns)
    plain = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    got = sorted((plain(tuple(r[c] for c in columns)) for r in df.collect()), key=str)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((plain(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall()), key=str)
    assert got == want
