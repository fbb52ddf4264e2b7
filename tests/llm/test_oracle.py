"""The queries that SQL can express, against DuckDB."""

import compare
import pytest

from stayline.llm.oracle import ORACLE
from stayline.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, data, name):
    con = compare.connect(data)
    df = QUERIES[name](spark, data)
    assert compare.spark_rows(df) == compare.duck_rows(con, ORACLE[name])
    assert (lambda x: x[0] == x[1])(compare.types_of(df, con, ORACLE[name]))


def test_one_query_per_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
