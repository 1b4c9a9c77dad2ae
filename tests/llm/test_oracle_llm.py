import pytest
from oracle_compare import compare, duck

from hybridlake.llm.oracle import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_its_sql(spark, key):
    assert compare(spark, key, SF, duck(SF))["status"] == "match"
