"""What the physical plans promise: splitting of hot keys, pruning, no Python in the data path."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stayline.operators import activity as acts
from stayline.operators import history, panel, ranking
from stayline.plans import standins as st
from stayline.plans.queries import QUERIES, TRAINING
from stayline.sources import readers, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    before = {}

    def put(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            before[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_data_as_if_large(put):
    """Thresholds so low that a few thousand rows count as too big to broadcast or hold at once."""
    put(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
    )


def hot_rows(spark, n=60_000, days=3650):
    """A third of the rows belong to customer 1, spread over ``days``."""
    who = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000 + 2).cast("string")
    return spark.range(0, n, 1, 16).select(
        who.alias("cust_id"),
        F.lit("1").alias("cust_line_seq_id"),
        F.concat(who, F.lit("1")).alias("mtn"),
        F.date_add(F.lit(date(2010, 1, 1)), (F.col("id") % days).cast("int")).alias("activity_dt"),
        F.col("id").alias("row_id"),
    )


def test_hot_customer_is_split_in_the_profile_join(spark, settings):
    small_data_as_if_large(settings)
    rows = hot_rows(spark)
    lines = spark.range(1, 5002).selectExpr(
        "CAST(id AS STRING) AS cust_id", "concat(id, '1') AS mtn", "'D2D' AS chnl_nm"
    )
    joined = acts.with_profile(rows, lines, ["chnl_nm"])
    got = joined.agg(F.count("*"), F.countDistinct("row_id"), F.count("chnl_nm"))
    assert got.collect()[0][:] == (60_000, 60_000, 60_000)
    joined.collect()
    assert "skew=true" in plan(joined)


def test_hot_line_is_split_in_the_telemetry_check(spark, settings):
    small_data_as_if_large(settings)
    ended = hot_rows(spark).withColumnRenamed("mtn", "mdn_5g")
    days = spark.range(0, 9000).selectExpr(
        "concat(id % 3000 + 1, '1') AS mdn_5g", "CAST(id % 3000 + 1 AS STRING) AS cust_id"
    )
    kept = panel.with_telemetry(ended, days)
    wanted = sum(1 for i in range(60_000) if i % 3 == 0 or i % 5000 + 2 <= 3000)
    assert len(kept.collect()) == wanted
    assert "skew=true" in plan(kept)


def test_hot_order_is_split_before_the_daily_sums(spark, settings, tmp_path):
    small_data_as_if_large(settings)
    folder = str(tmp_path)
    spark.range(0, 60_000, 1, 16).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 6 ELSE id % 9000 END AS l_orderkey", "1.0D AS l_quantity",
        "2.0D AS l_extendedprice", "0.1D AS l_discount", "0.2D AS l_tax", "'R' AS l_returnflag",
        "'O' AS l_linestatus",
        "CAST(date_add(DATE'2020-01-01', CAST(id % 400 AS INT)) AS TIMESTAMP_NTZ) AS l_shipdate",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(0, 9000).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey").write.parquet(
        f"{folder}/orders.parquet"
    )
    sums = st.telemetry_sums(spark, folder)
    assert sum(r.rows_of_day for r in sums.collect()) == 60_000
    assert "skew=true" in plan(sums)


@pytest.mark.parametrize("span", [300, 3650])
def test_hot_line_is_spread_or_split_in_the_history_join(spark, settings, span):
    """Over ten years the line lies in ten groups; within one year its partition is split."""
    small_data_as_if_large(settings)
    rows = hot_rows(spark, days=span)
    days = rows.select("cust_id", "cust_line_seq_id", "activity_dt").distinct()
    valid = history.validity(days, ["cust_id", "cust_line_seq_id"], "activity_dt").drop(
        "activity_dt"
    )
    joined = history.scd2_join(rows, valid, acts.LINE, at="activity_dt", how="left")
    found = joined.collect()
    assert len(found) == 60_000
    assert all(r.eff_dt == r.activity_dt for r in found)
    text = plan(joined)
    assert "hashpartitioning(cust_id" in text and "_year" in text
    if span == 300:
        assert "skew=true" in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TRAINING)))
def test_no_python_and_no_cross_join(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


@pytest.mark.parametrize("name", ["roc_auc", "threshold_sweep", "class_balance", "impute_hot_deck"])
def test_only_block_totals_meet_in_one_task(spark, data, name):
    """A window over everything may only see the totals per block."""
    lines = plan(QUERIES[name](spark, data)).splitlines()
    for at, line in enumerate(lines):
        if "Exchange SinglePartition" in line and "Window" in lines[at - 2]:
            assert "_block" in lines[at - 2]


def test_column_pruning_reaches_the_scan(spark, data):
    text = QUERIES["latest_score_date"](spark, data)._jdf.queryExecution().toString()
    assert "l_extendedprice" not in text.split("== Physical Plan ==")[1]


def test_sampling_limits_rows_before_the_shuffle(spark, data):
    text = plan(QUERIES["sample_days_per_line"](spark, data))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_feature_table_shuffles_telemetry_once_by_line(spark, data, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(QUERIES["churn_feature_table"](spark, data))
    head = text.split("SortMergeJoin")[0]
    assert "Exchange" not in head  # nothing is shuffled after the join on the line
    assert "WindowGroupLimit" in head


def test_telemetry_itself_is_not_shuffled_for_its_keys(spark, data):
    text = plan(QUERIES["churned_with_telemetry"](spark, data))
    assert "lineitem" not in text


def test_block_totals_are_bounded_for_any_scale(spark):
    df = spark.range(0, 3000).select((F.col("id") * 10**14 - 5).alias("k"), F.lit(1).alias("v"))
    got = ranking.running_totals(df, "k", {"t": "v"}).collect()
    assert sorted((r.k, r.t) for r in got) == [(i * 10**14 - 5, i + 1) for i in range(3000)]
    one = ranking.running_totals(df.limit(1), "k", {"t": "v"}).collect()
    assert [r.t for r in one] == [1]


def test_range_scan_prunes_day_folders(spark, data, tmp_path):
    root = str(tmp_path / "panel")
    columns = ["cpe_date", "mdn_5g", "cust_id", "scaled_latency"]
    writers.overwrite(
        st.telemetry(spark, data).select(columns).where("cpe_date < '1995-03-01'"), root, ["cpe_date"]
    )
    stored = readers.read_partitioned_panel(spark, root, ["scaled_latency"])
    ended = spark.createDataFrame([(date(1995, 2, 20),)], "deact_dt date")
    scan = panel.scan_range(stored, panel.lookback_bounds(ended, 5))
    days = {r[0] for r in scan.select("cpe_date").distinct().collect()}
    assert days and min(days) >= date(1995, 2, 15) and max(days) <= date(1995, 2, 20)
    text = plan(scan)
    assert "PartitionFilters: [isnotnull(cpe_date" in text and "ubquery" in text


def test_hash_rank_is_one_to_n_and_independent_of_partitioning(spark):
    def ranks(parts):
        df = spark.range(0, 5000, 1, parts).withColumn("label", F.col("id") % 2)
        got = ranking.hash_rank(df, ["id"], "s", within=["label"])
        return {(r.label, r["rank"]): r.id for r in got.collect()}

    one, many = ranks(1), ranks(13)
    assert one == many
    assert sorted(r for label, r in one if label == 0) == list(range(1, 2501))


def test_running_totals_across_blocks(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 - 3000).alias("k"), F.lit(1).alias("v"))
    up = ranking.running_totals(df, "k", {"t": "v"}, width=10).collect()
    assert sorted((r.k, r.t) for r in up) == [(i * 7 - 3000, i + 1) for i in range(1000)]
    down = ranking.running_totals(df, "k", {"t": "v"}, width=64, descending=True).collect()
    assert sorted((r.k, r.t) for r in down) == [(i * 7 - 3000, 1000 - i) for i in range(1000)]


@pytest.fixture
def reads(spark, data, monkeypatch):
    """How often a query's run reads a base table: in the plans that ran for its stored tables and in its own."""
    from pyspark.sql.readwriter import DataFrameWriter

    texts, write = [], DataFrameWriter.parquet

    def recorded(self, *args, **options):
        write(self, *args, **options)

    def of(name, table):
        texts.clear()
        final = QUERIES[name](spark, data)
        final.collect()
        done = [*texts, plan(final)]
        return sum(t.split("== Initial Plan ==")[0].count(f"/{table}.parquet]") for t in done)

    def run(self, *args, **options):
        self._df.collect()
        texts.append(plan(self._df))
        return recorded(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", run)
    return of


@pytest.mark.parametrize("name", ["churn_feature_table", "one_hot_fixed", "latest_disconnect", "lead_time_curve", "active_panel"])
def test_base_tables_are_read_a_few_times(reads, name):
    assert 1 <= reads(name, "orders") <= 3
    assert reads(name, "lineitem") <= 1
