"""Every registered query against DuckDB, on the given tables and on tables with a hot customer."""

import compare
import duckdb
import pytest

import __spark_entry__ as contract
from stayline.plans.oracle import ORACLE
from stayline.plans.queries import QUERIES


def check(spark, folder, name):
    con = compare.connect(folder)
    df = QUERIES[name](spark, folder)
    assert compare.spark_rows(df) == compare.duck_rows(con, ORACLE[name])
    ours, theirs = compare.types_of(df, con, ORACLE[name])
    assert ours == theirs


def test_every_query_has_an_oracle_and_is_registered():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, data, name):
    check(spark, data, name)


@pytest.fixture(scope="module")
def skewed(data, tmp_path_factory):
    """The same tables, with a third of all orders, items and events given to one key each."""
    folder = tmp_path_factory.mktemp("skewed")
    con = compare.connect(data)
    changed = {
        "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey)",
        "lineitem": "* REPLACE (CASE WHEN hash(l_orderkey, l_linenumber) % 3 = 0 THEN 6"
        " ELSE l_orderkey END AS l_orderkey)",
        "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id,"
        " CASE WHEN event_id % 3 = 0 THEN 5.0 ELSE value END AS value)",
    }
    for (name,) in con.execute("SELECT view_name FROM duckdb_views() WHERE NOT internal").fetchall():
        con.execute(
            f"COPY (SELECT {changed.get(name, '*')} FROM {name}) TO '{folder}/{name}.parquet'"
        )
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle_with_hot_keys(spark, skewed, name):
    check(spark, skewed, name)


def test_skew_is_there(skewed):
    orders = duckdb.sql(f"SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM "
                        f"'{skewed}/orders.parquet' GROUP BY o_custkey)").fetchall()[0][0]
    assert orders > 0.3
