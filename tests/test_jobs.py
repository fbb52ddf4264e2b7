"""Jobs end to end on the given tables, stored and read back between the steps."""

from datetime import date

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from stayline.operators import features, model
from stayline.plans import jobs
from stayline.plans import standins as st
from stayline.plans import queries
from stayline.plans.queries import QUERIES
from stayline.sources import readers, writers
from stayline.sources.contracts import PROFILE, SCORES


@pytest.fixture(scope="module")
def stored(spark, data, tmp_path_factory):
    """Line tables and panels written to disk from raw input, as the jobs would run in production."""
    root = str(tmp_path_factory.mktemp("jobs"))
    raw = st.raw_activity(spark, data)
    profile = st.profile(spark, data)
    for field in PROFILE.fields:
        if field.name not in profile.columns:
            profile = profile.withColumn(field.name, F.lit(None).cast(field.dataType))
    jobs.write_tables(jobs.line_tables(raw, profile, st.CUTOFF), root)
    days = st.telemetry(spark, data).withColumn("cpe_date", F.trunc("cpe_date", "MM"))
    days = days.groupBy("cpe_date", "mdn_5g", "cust_id").agg(*[F.max(s).alias(s) for s in SCORES])
    writers.overwrite(days, f"{root}/scores", ["cpe_date"])
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    jobs.write_tables(
        jobs.candidate_panels(
            read(jobs.CHURNED_LINES),
            read(jobs.CUSTOMER_LINES),
            readers.read_partitioned_panel(spark, f"{root}/scores"),
        ),
        root,
    )
    return read


def test_line_tables(stored, spark, data):
    assert stored(jobs.CUSTOMER_LINES).count() == QUERIES["line_profile_left_join"](spark, data).count()
    assert stored(jobs.CHURNED_LINES).count() == QUERIES["churn_table"](spark, data).count()
    wide = stored(jobs.INSTALL_LINES)
    assert {"dwelling_type", "sales_dt", "sku_id"} <= set(wide.columns)
    assert not any("email" in c.lower() for c in wide.columns)


def test_candidate_panels(stored):
    churn, active = stored(jobs.CHURN_PANEL), stored(jobs.ACTIVE_PANEL)
    lead = F.datediff("deact_dt", "cpe_date")
    assert churn.count() > 0 and churn.where(~lead.between(0, 30)).count() == 0
    assert active.count() > 0
    both = active.join(churn, ["mdn_5g", "cust_id"], "left_semi")
    assert both.count() == 0


def test_model_from_stored_panels(stored):
    rows = jobs.model_rows(
        stored(jobs.ACTIVE_PANEL), stored(jobs.CHURN_PANEL), churn_after=st.CHURN_AFTER
    )
    labels = {r[0] for r in rows.select(features.LABEL).distinct().collect()}
    assert labels == {0, 1}
    trained = jobs.train(rows, trees=10, max_depth=5, balance_first=True, one_pass_means=True,
                         with_account=True)
    assert len(trained.inputs) == 13 + 17
    counts = trained.rows.groupBy(features.LABEL).count().collect()
    assert len({r["count"] for r in counts}) == 1
    assert trained.rows.count() == trained.scored().count()


def test_weighted_training_keeps_all_rows(spark):
    scores = {s: float(i) for i, s in enumerate(features.MODEL_SCORES)}
    rows = [
        (str(i), str(i), str(i), 1.0, int(i % 10 == 0), *[v + (i % 10 == 0) for v in scores.values()])
        for i in range(200)
    ]
    df = spark.createDataFrame(
        rows, ["mdn_5g", "cust_id", "row_key", "acct_num", features.LABEL, *scores]
    ).withColumns({c: F.lit(0) for c in features.one_hot_columns()})
    trained = jobs.train(df, weighted=True, trees=5, max_depth=3)
    got = trained.scored().collect()
    assert len(got) == 200 and all(r.label == r.prediction for r in got)


def test_trained_queries(spark, data):
    trained = queries.trained(spark, data)
    features_n = QUERIES["churn_feature_table"](spark, data).count()
    got = trained.scored().collect()
    assert len(got) == features_n
    assert all(0 <= r.probability <= 1 and r.prediction in (0, 1) for r in got)
    report = trained.report().collect()
    assert {(r.side, r["class"]) for r in report} == {
        (side, name)
        for side in ("train", "test")
        for name in ("0", "1", "accuracy", "macro avg", "weighted avg")
    }
    assert trained.confusion().agg(F.sum("n")).first()[0] == features_n
    values = [r.importance for r in trained.importances().collect()]
    assert len(values) == 29 and values == sorted(values, reverse=True)
    assert sum(values) == pytest.approx(1.0)


def test_the_forest_is_bounded(spark):
    rows = [(str(i), str(i), str(i), 1.0, i % 2, *[float((i * 37 + k) % 1009) for k in range(12)]) for i in range(1500)]
    df = spark.createDataFrame(
        rows, ["mdn_5g", "cust_id", "row_key", "acct_num", features.LABEL, *features.MODEL_SCORES]
    ).withColumns({c: F.lit(0) for c in features.one_hot_columns()})
    ready = jobs.prepare(df, fit_rows=400)
    n = ready.fit_on.count()
    assert 300 < n < 500 and ready.rows.count() == 1500
    trained = jobs.train(df, fit_rows=400, trees=3, min_leaf=20)
    assert all(t.numNodes < 2 * n / 20 for t in trained.model.trees)
    exact = jobs.train(df, trees=1, max_depth=2, max_bins=2048)
    assert exact.model.getOrDefault("maxBins") == 2048


@pytest.fixture(scope="module")
def large_matrix(spark, tmp_path_factory):
    """A design matrix whose balanced training rows are more than 200,000."""
    path = f"file://{tmp_path_factory.mktemp('large')}/rows"
    key = F.col("id").cast("string")
    scores = {s: (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(500)) / 100 + F.col("id") % 2).cast("double") for s in features.MODEL_SCORES}
    spark.range(300_000, numPartitions=4).select(
        key.alias("mdn_5g"), key.alias("cust_id"), key.alias("row_key"), F.lit(1.0).alias("acct_num"),
        *[v.alias(s) for s, v in scores.items()], *[F.lit(0).alias(c) for c in features.one_hot_columns()],
        (F.col("id") % 2).cast("int").alias(features.LABEL),
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", ["feature_importance", "rf_evaluation", "rf_train_score"])
def test_the_forest_sees_every_training_row(spark, monkeypatch, large_matrix, name):
    fit, seen = model.train_forest, []

    def recorded(train, inputs, **options):
        seen.append([r[0] for r in train.groupBy(features.LABEL).count().select("count").collect()])
        return fit(train, inputs, **(options | {"trees": 2, "max_depth": 2}))

    monkeypatch.setattr(model, "train_forest", recorded)
    monkeypatch.setattr(queries, "_matrix", lambda *_: large_matrix)
    assert QUERIES[name](spark, "").count() == {"feature_importance": 29, "rf_evaluation": 10, "rf_train_score": 300_000}[name]
    sides = features.split_train_test(large_matrix, ["mdn_5g", "cust_id"]).where("not is_test").groupBy(features.LABEL).count().collect()
    assert seen == [[min(r["count"] for r in sides)] * 2] and sum(seen[0]) > 200_000


def test_the_bins_come_from_every_row(spark, monkeypatch):
    # Spark cuts bins from all rows only if these are no more than the bins squared (or 10,000).
    seen, fit = [], RandomForestClassifier.fit

    def recorded(self, df, *args):
        seen.append(self.getMaxBins())
        return fit(self, df, *args)

    monkeypatch.setattr(RandomForestClassifier, "fit", recorded)
    df = spark.range(12_000).select((F.col("id") % 2).alias("y"), (F.col("id") % 97).cast("double").alias("a")).orderBy("id")
    for bins in (16, 200):
        model.train_forest(df, ["a"], label="y", trees=1, max_depth=1, max_bins=bins)
    assert seen == [110, 200]


def test_the_forest_keeps_the_rows_places(spark, monkeypatch):
    rows = [(i % 2, *[float((i * 37 + k) % 101) for k in range(3)]) for i in range(300)]
    seen, fit = [], RandomForestClassifier.fit

    def recorded(self, df, *args):
        seen.append(self.getCacheNodeIds())
        return fit(self, df, *args)

    monkeypatch.setattr(RandomForestClassifier, "fit", recorded)
    df = spark.createDataFrame(rows, ["y", "a", "b", "c"])
    forest = model.train_forest(df, ["a", "b", "c"], label="y", trees=2, max_depth=3)
    assert spark.sparkContext.getCheckpointDir() is not None  # the tests' session names one
    assert seen == [True] and forest.getNumTrees == 2


def stored_panels(spark, monkeypatch, work):
    """What ``work`` stores, and its result: telemetry of one line that left, one that stayed, and one that is in question nowhere."""
    stored, keep = [], jobs.durable

    def recorded(df, **options):
        stored.append(df)
        return keep(df, **options)

    for place in (jobs, features):
        monkeypatch.setattr(place, "durable", recorded, raising=False)
    scores = {s: F.lit(1.0) for s in features.MODEL_SCORES}
    day = F.expr("date_add(date'1997-01-01', cast(id % 40 as int))").alias("cpe_date")
    panel = spark.range(120).select(day, F.expr("concat('m', cast(id div 40 as string))").alias("mdn_5g"), F.lit("c").alias("cust_id")).withColumns(scores)
    return work(panel), stored


def log(spark, rows):
    names = ["mdn_5g", "cust_id", "activity_cd", *features.LINE_COLUMNS[2:]]
    return spark.createDataFrame([(m, "c", code, *["1"] * (len(names) - 3)) for m, code in rows], names)


def test_candidate_panels_store_rows_of_the_lines_in_question_once(spark, monkeypatch):
    customers = log(spark, [("m1", "AC"), ("m2", "AC"), ("m2", "AC"), (None, "AC")])
    churned = log(spark, [("m0", "DE"), (None, "DE")]).withColumnRenamed("activity_cd", "deact_cd").withColumn("deact_dt", F.lit("1997-02-01").cast("date"))
    found, stored = stored_panels(spark, monkeypatch, lambda panel: jobs.candidate_panels(churned, customers, panel))
    assert len(stored) == 1 and {r[0] for r in stored[0].select("mdn_5g").distinct().collect()} == {"m0", "m1"}
    counts = {name: {r[0]: r[1] for r in df.groupBy("mdn_5g").count().collect()} for name, df in found.items()}
    assert counts == {jobs.CHURN_PANEL: {"m0": 31}, jobs.ACTIVE_PANEL: {"m1": 31}}


def test_feature_table_leaves_other_lines_out_before_the_shuffle(spark, monkeypatch):
    activity = log(spark, [("m1", "AC"), ("m2", "AC"), ("m2", "AC")])
    ended = log(spark, [("m0", "DE")]).withColumnRenamed("activity_cd", "deact_cd").withColumn("deact_dt", F.lit("1997-02-01").cast("date"))
    places = activity.select("mdn_5g", "cust_id", "market_type", "order_fulfilment")
    table = lambda panel: features.feature_table(activity, places, ended, panel, churn_after=date(1996, 1, 1))
    got, stored = stored_panels(spark, monkeypatch, table)
    assert len(stored) == 1 and "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.mdn_5g, r.churn_label) for r in got.collect()) == [("m0", "Y"), ("m1", "N")]
