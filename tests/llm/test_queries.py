import pytest

import __spark_entry__
from tests import oracle
from voltlake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    oracle.assert_equal(spark, QUERIES[name], ORACLE_SQL[name])


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
