"""Preparation learned once: what it learns, that it survives storing, and a whole model stored and used on other rows."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stayline.operators import features
from stayline.operators.preparation import Preparation, PreparationModel
from stayline.plans import jobs

ROOT = Path(__file__).resolve().parent.parent
SMALL = dict(categories=["kind", "place"], scores=["a", "b"], drawn="a", keys=["id"])
COLUMNS = "id bigint, kind string, place string, a double, b double"


@pytest.fixture
def training(spark):
    nan, inf = float("nan"), float("inf")
    return spark.createDataFrame(
        [(1, "x", "north", 1.0, 10.0), (2, "y", None, None, 20.0), (3, "x", "south", 3.0, None), (4, "z", "north", nan, inf)], COLUMNS
    )


def test_levels_donors_and_means_come_from_the_training_rows(spark, training):
    model = Preparation(**SMALL).fit(training)
    assert model.levels == {"kind": ["x", "y", "z"], "place": ["north", "south"]}
    assert model.inputs() == ["a", "b", "kind_x", "kind_y", "kind_z", "place_north", "place_south"]
    assert {r.value for r in model.donors.collect()} == {1.0, 3.0} and model.n_donors == 2
    assert model.means["b"] == 15.0
    other = spark.createDataFrame([(9, "new", "south", None, None), (10, None, None, 7.0, -1.0)], COLUMNS)
    first, second = model.transform(other).orderBy("id").collect()
    assert first.a in (1.0, 3.0) and first.b == 15.0 and (second.a, second.b) == (7.0, -1.0)
    assert [first[c] for c in model.flags()] == [0, 0, 0, 0, 1] and [second[c] for c in model.flags()] == [0] * 5


def test_a_stored_preparation_does_the_same(spark, training, tmp_path):
    model = Preparation(**SMALL, salt="other").fit(training)
    path = f"file://{tmp_path}/preparation"
    model.write().save(path)
    again = PreparationModel.load(path)
    assert (again.levels, again.means, again.n_donors, again.uid) == (model.levels, model.means, model.n_donors, model.uid)
    assert again.of("salt") == "other" and again.of("categories") == ["kind", "place"]
    rows = spark.range(200).select(
        "id", F.lit("x").alias("kind"), F.lit("south").alias("place"), F.lit(None).cast("double").alias("a"), F.lit(1.0).alias("b")
    )
    drawn = {r.id: r.a for r in model.transform(rows).collect()}
    assert drawn == {r.id: r.a for r in again.transform(rows.repartition(7)).collect()} and set(drawn.values()) == {1.0, 3.0}
    model.write().overwrite().save(path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        model.write().save(path)


def test_no_rows_no_donors_no_categories(spark, training):
    empty = Preparation(**SMALL).fit(training.limit(0))
    out = empty.transform(training).orderBy("id").collect()
    assert empty.flags() == [] and [r.a for r in out] == [1.0, None, 3.0, None] and [r.b for r in out] == [10.0, 20.0, None, None]
    plain = Preparation(**{**SMALL, "categories": [], "drawn": ""}).fit(training)
    assert plain.inputs() == ["a", "b"] and [r.a for r in plain.transform(training).orderBy("id").collect()] == [1.0, 2.0, 3.0, 2.0]
    assert plain.transform(training.limit(0)).count() == 0
    with pytest.raises(ValueError, match="not categories"):
        Preparation(**{**SMALL, "maxLevels": 4}).fit(training)


def test_odd_names_and_repeated_rows(spark, training):
    # Columns of the table that are called like inner ones stay; repeated rows draw alike.
    rows = training.unionByName(training).withColumns({"donor": F.lit("mine"), "value": F.lit("mine"), "_count": F.lit(1)})
    out = Preparation(**SMALL).fit(training).transform(rows)
    assert out.where("donor = 'mine' and value = 'mine'").count() == 8
    assert out.groupBy("id").agg(F.count_distinct("a").alias("n")).where("n > 1").count() == 0


def feature_rows(spark, n=400):
    """Lines whose churn shows in the first score alone; one score is the same noise for all."""
    first, *others = features.MODEL_SCORES
    churned = F.col("id") % 2 == 0
    noise = (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).cast("double")
    return spark.range(n).select(
        F.concat(F.lit("k"), "id").alias("row_key"), F.col("id").cast("string").alias("mdn_5g"), F.col("id").cast("string").alias("cust_id"),
        F.when(churned, "Y").otherwise("N").alias(features.LABEL),
        F.when(F.col("id") % 7 == 0, None).otherwise(F.when(churned, 5.0).otherwise(1.0) + noise).alias(first),
        *[(noise + i).alias(c) for i, c in enumerate(others)],
        F.when(F.col("id") % 3 == 0, "others").otherwise("FSNO21VA").alias("eqp_prod_nm"), F.lit("4G LTE Home").alias("coe_pplan_sub_type_desc"),
        F.when(F.col("id") % 5 == 0, "East").otherwise("unknown").alias("market_type"), F.lit("SHIPPED").alias("order_fulfilment"),
    )


def test_a_stored_model_scores_other_rows_in_another_session(spark, tmp_path):
    rows = feature_rows(spark)
    fitted = jobs.fit_model(rows.where("CAST(mdn_5g AS INT) < 200"), trees=10, max_depth=4)
    path, table = f"file://{tmp_path}/model", f"file://{tmp_path}/rows"
    fitted.write().save(path)
    other = rows.where("CAST(mdn_5g AS INT) >= 200").withColumn("market_type", F.lit("Mars"))
    other.write.parquet(table)
    here = {r.row_key: r.score for r in jobs.score_rows(PipelineModel.load(path), other).collect()}
    right = jobs.score_rows(fitted, other).where(F.col("prediction") == F.col(features.LABEL)).count()
    assert len(here) == 200 and right > 150
    code = f"""
import json, sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.ml import PipelineModel
from stayline.plans import jobs
from stayline.session import local_session
spark = local_session(2, **{{"spark.checkpoint.dir": {str(tmp_path / "ck")!r}}})
rows = spark.read.parquet({table!r})
print("SCORES" + json.dumps({{r.row_key: r.score for r in jobs.score_rows(PipelineModel.load({path!r}), rows.drop("churn_label")).collect()}}))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert "SCORES" in out.stdout, out.stderr[-2000:]
    assert json.loads(out.stdout.split("SCORES", 1)[1].splitlines()[0]) == here


def test_permutation_finds_the_telling_score(spark):
    rows = feature_rows(spark)
    fitted = jobs.fit_model(rows.where("CAST(mdn_5g AS INT) < 200"), trees=10, max_depth=4)
    found = jobs.permutation_importances(fitted, rows.where("CAST(mdn_5g AS INT) >= 200")).orderBy(F.col("importance").desc()).collect()
    assert found[0].feature == features.MODEL_SCORES[0] and found[0].importance > 0.3
    assert all(abs(r.importance) < 0.06 for r in found[1:]) and len(found) == len(fitted.stages[0].inputs())


def test_weighted_and_bounded_fits(spark):
    rows = feature_rows(spark, 300).where("churn_label = 'Y' OR CAST(mdn_5g AS INT) % 5 = 1")
    fitted = jobs.fit_model(rows, weighted=True, trees=3, max_depth=3, fit_rows=100)
    assert jobs.score_rows(fitted, rows).count() == rows.count()
    assert all(t.numNodes < 2 * 140 / 5 for t in fitted.stages[2].trees)


def test_a_fit_takes_every_row_unless_told(spark, monkeypatch):
    fit, seen = jobs.model.train_forest, []

    def recorded(train, inputs, **options):
        seen.append(train.count())
        return fit(train, inputs, **(options | {"trees": 1, "max_depth": 1}))

    monkeypatch.setattr(jobs.model, "train_forest", recorded)
    jobs.fit_model(feature_rows(spark, 210_000), weighted=True)
    assert seen == [210_000]
