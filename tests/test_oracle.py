"""Every registered query against its DuckDB oracle (the driver's gate), on
the smallest driver tables so the suite stays quick; the driver repeats it at
sf0.01 (also run by ``python tests/oracle_compare.py``)."""

import pytest

from __spark_entry__ import entry, oracle_sql
from hybridlake.plans.driver import QUERIES
from oracle_compare import compare, duck

from conftest import SF_SMALL

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, key, SF_SMALL, con)
    if key in oracle_sql():
        assert res["status"] == "match", res
    else:
        assert res["status"] == "rows-only" and res["spark_rows"] > 0


def test_every_query_but_approximate_search_has_an_oracle():
    assert set(QUERIES) - set(oracle_sql()) == {"knn_ivf_trained", "knn_pq"}


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["conv_id", "turn", "prompt"]
    assert df.count() > 0
