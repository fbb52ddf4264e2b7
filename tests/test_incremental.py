"""A panel advanced day by day equals one worked out from all days at once."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stayline.functions import numbers
from stayline.operators import incremental

D = date(2024, 5, 1)
SCORES = ("a", "b")
SCHEMA = "cpe_date date, mdn_5g string, cust_id string, a double, b double, extra string"


def made(days=8):
    rng = random.Random(2)
    rows = []
    for n in range(days):
        if n == 3:
            continue  # a day without telemetry
        for line in range(20):
            if rng.random() < 0.7:
                value = rng.choice([None, float("nan"), float("inf"), rng.uniform(-1e6, 1e6), 0.005, 1e-13])
                rows.append((D + timedelta(days=n), f"m{line}", f"c{line}", value, rng.choice([None, 0.1]), "x"))
    return rows


def whole(df):
    return df.groupBy("mdn_5g", "cust_id").agg(
        F.count("*").alias("n_rows"), F.min("cpe_date").alias("first_day"), F.max("cpe_date").alias("last_day"),
        *[numbers.mean_2dp(F.col(s)).alias(s) for s in SCORES],
    )


@pytest.fixture
def store(spark, tmp_path):
    return incremental.StateStore(spark, f"file://{tmp_path}/state", SCORES)


def advance(store, df, n):
    day = D + timedelta(days=n)
    return store.advance(str(day), df.where(F.col("cpe_date") == F.lit(day)))


def test_daily_advances_equal_the_whole(spark, store):
    df = spark.createDataFrame(made(), SCHEMA)
    assert store.features().count() == 0
    for n in range(8):
        assert advance(store, df, n)
        if n in (2, 5):
            before = sorted(map(str, store.features().collect()))
            assert not advance(store, df, n)  # the same day again changes nothing
            assert not advance(store, df, 0)
            assert sorted(map(str, store.features().collect())) == before
        upto = df.where(F.col("cpe_date") <= F.lit(D + timedelta(days=n)))
        assert sorted(map(str, store.features().collect())) == sorted(map(str, whole(upto).collect()))
    assert [r.version for r in store.log().orderBy("version").collect()] == list(range(1, 9))


def test_days_may_come_in_any_order(spark, store):
    df = spark.createDataFrame(made(), SCHEMA)
    for n in (5, 0, 7, 2, 1, 6, 4, 3):
        assert advance(store, df.repartition(3), n)
    assert sorted(map(str, store.features().collect())) == sorted(map(str, whole(df).collect()))


def test_a_job_that_dies_before_the_log_leaves_no_trace(spark, store, monkeypatch):
    df = spark.createDataFrame(made(), SCHEMA)
    advance(store, df, 0)
    before = sorted(map(str, store.features().collect()))
    # The state is written, and the job ends before its line in the log.

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", dies)
        with pytest.raises(RuntimeError, match="lost"):
            advance(store, df, 1)
    assert sorted(map(str, store.features().collect())) == before
    assert advance(store, df, 1)  # simply run again
    upto = df.where(F.col("cpe_date") <= F.lit(D + timedelta(days=1)))
    assert sorted(map(str, store.features().collect())) == sorted(map(str, whole(upto).collect()))


def test_an_advance_reads_that_day_and_the_state_alone(spark, store, tmp_path):
    df = spark.createDataFrame(made(), SCHEMA)
    root = f"{tmp_path}/panel"
    df.write.partitionBy("cpe_date").parquet(root)
    advance(store, df, 0)
    day = spark.read.parquet(root).where(F.col("cpe_date") == F.lit(D + timedelta(days=1)))
    text = incremental.partial_state(day, SCORES)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cpe_date" in text and "extra" not in text.split("ReadSchema")[-1]
    assert store.advance("second", day) and store.state().count() >= 1


def test_merging_is_associative(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    parts = [incremental.partial_state(df.where(F.dayofmonth("cpe_date") % 3 == k), SCORES) for k in range(3)]
    left = incremental.merged(incremental.merged(parts[0].unionByName(parts[1]), SCORES).unionByName(parts[2]), SCORES)
    right = incremental.merged(parts[0].unionByName(incremental.merged(parts[1].unionByName(parts[2]), SCORES)), SCORES)
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect())) == sorted(map(str, incremental.partial_state(df, SCORES).collect()))
