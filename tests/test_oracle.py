"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as E
from data_paths import SF01
from gazette.plans.registry import ORACLE, QUERIES, load_all
from oracle_compare import compare, duck_connect

# the other queries of the entry module have their own tests
load_all()
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF01)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, registry, con, name):
    q, o = registry
    info = compare(q[name](spark, SF01), con, o[name])
    assert info["ok"], info


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["articleId", "title", "publishDate", "summary", "thumbnailPath", "media"]
    assert 0 < len(rows) <= 10
