import pytest
from oracle import compare

from trigrove.llm.queries import oracle_sql, queries


def test_ten_operators_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    compare(spark, queries()[name], oracle_sql()[name], "/root/testdata/sf0.001")
