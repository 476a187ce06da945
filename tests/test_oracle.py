"""Every query of the engine against its SQL."""

from __future__ import annotations

import pytest

from tallyloom.operators import registry
from tests.conftest import same_rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, SQL[name])


def test_entry_module(spark):
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.oracle_sql())
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1
