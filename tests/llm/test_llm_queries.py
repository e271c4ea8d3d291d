import pytest

from ostinato.llm.queries import ORACLE_SQL, QUERIES

from ..compare import same


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLE_SQL[name])


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
