"""Readers and writers on small written tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stayline import session
from stayline.sources import contracts, readers, writers


@pytest.fixture
def day_folders(spark, tmp_path):
    root = tmp_path / "scores"
    for day in ("2024-06-01", "2024-06-02", "2024-06-04"):
        spark.createDataFrame(
            [("1", "9", 0.5, float(day[-1]))],
            "mdn_5g string, cust_id string, scaled_latency double, scaled_SNR double",
        ).write.parquet(str(root / day))
    return str(root)


def test_day_folders_are_read_in_one_scan_and_gaps_skipped(spark, day_folders):
    got = readers.read_daily_panel(
        spark, day_folders, date(2024, 6, 2), date(2024, 6, 30), ["scaled_SNR"]
    )
    assert got.columns == ["cpe_date", "mdn_5g", "cust_id", "scaled_SNR"]
    assert dict(got.dtypes)["cpe_date"] == "date"
    rows = sorted((r.cpe_date, r.scaled_SNR) for r in got.collect())
    assert rows == [(date(2024, 6, 2), 2.0), (date(2024, 6, 4), 4.0)]
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_day_folders_default_to_all_scores(spark, day_folders):
    got = readers.read_daily_panel(spark, day_folders, date(2024, 6, 1), date(2024, 6, 1))
    assert got.columns == ["cpe_date", "mdn_5g", "cust_id", *contracts.SCORES]
    assert got.first().deviceScore is None and got.count() == 1


@pytest.mark.parametrize("start, end", [((2023, 1, 1), (2023, 1, 5)), ((2024, 6, 2), (2024, 6, 1))])
def test_no_day_in_range_gives_an_empty_panel(spark, day_folders, start, end):
    got = readers.read_daily_panel(spark, day_folders, date(*start), date(*end), ["scaled_SNR"])
    assert got.count() == 0
    assert got.dtypes == [("cpe_date", "date"), ("mdn_5g", "string"), ("cust_id", "string"),
                          ("scaled_SNR", "double")]


def test_partitioned_panel_round_trip_replaces_only_its_days(spark, tmp_path):
    root = str(tmp_path / "panel")
    schema = "cpe_date date, mdn_5g string, cust_id string, scaled_SNR double"
    old = [(date(2024, 6, d), "1", "9", 0.0) for d in (1, 2, 3)]
    writers.overwrite(spark.createDataFrame(old, schema), root, ["cpe_date"])
    new = spark.createDataFrame([(date(2024, 6, 2), "2", "9", 7.0)], schema)
    writers.overwrite(new, root, ["cpe_date"])
    got = readers.read_partitioned_panel(spark, root, ["scaled_SNR"]).collect()
    assert sorted((r.cpe_date.day, r.mdn_5g, r.scaled_SNR) for r in got) == [
        (1, "1", 0.0), (2, "2", 7.0), (3, "1", 0.0),
    ]


def test_unpartitioned_overwrite_replaces_all(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.overwrite(spark.range(10), path)
    writers.overwrite(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_warehouse_read_is_split_and_has_no_built_in_account():
    options = readers.warehouse_options(
        "jdbc:example:", "SELECT 1 AS k", partition_column="k", lower=0, upper=100, partitions=8,
        login={"user": "u"},
    )
    assert options["dbtable"] == "(SELECT 1 AS k) source_rows"
    assert (options["numPartitions"], options["lowerBound"], options["upperBound"]) == (
        "8", "0", "100",
    )
    assert options["user"] == "u" and "password" not in options


def test_sql_text_takes_the_cutoff_as_a_parameter(spark):
    rows = spark.createDataFrame([(date(2023, 1, 1),), (date(2022, 12, 31),)], "d date")
    got = readers.read_sql(
        spark, "SELECT * FROM {rows} WHERE d >= :cutoff", date(2023, 1, 1), rows=rows
    )
    assert [r.d for r in got.collect()] == [date(2023, 1, 1)]


def test_durable_writes_under_the_named_folder(spark):
    df = session.durable(spark.range(100).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 9900
    files = df.inputFiles()
    assert files and all(spark.conf.get("spark.checkpoint.dir") in f for f in files)


@pytest.mark.parametrize(
    "master, checkpoint, warehouse, found",
    [
        ("yarn", "hdfs://store/ck", "file:/root/warehouse", "hdfs://store/ck/stayline-app"),
        ("yarn", None, "hdfs://store/warehouse/", "hdfs://store/warehouse/stayline-app"),
        ("yarn", None, "file:/root/warehouse", None),
        ("spark://host:7077", "", "file:/root/warehouse", None),
        ("local[8]", None, "file:/root/warehouse", "file:/root/warehouse/stayline-app"),
        ("local-cluster[3,2,1000]", "file:///shared", "file:/x", "file:///shared/stayline-app"),
    ],
)
def test_stored_tables_need_a_folder_that_all_share(master, checkpoint, warehouse, found):
    from types import SimpleNamespace

    from stayline.session import shared_folder

    settings = {"spark.checkpoint.dir": checkpoint, "spark.sql.warehouse.dir": warehouse}
    spark = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: settings[key] or default),
        sparkContext=SimpleNamespace(master=master, applicationId="app"),
    )
    if found is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(spark)
    else:
        assert shared_folder(spark) == found
