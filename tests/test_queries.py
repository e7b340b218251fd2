"""Every registered query against its DuckDB text, over whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import check, connect

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, data, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, data).count() > 0
        return
    problems = check(spark, duck, name, QUERIES[name], ORACLES[name], data)
    assert [p for p in problems if p != "no rows"] == []


def test_entry_is_lazy_and_has_rows(spark):
    page = entry(spark)
    assert page.columns[:2] == ["id", "source_id"]
    assert page.count() > 0


def test_texts_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
