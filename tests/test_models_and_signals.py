"""Segment models, restarting alarms, survival, replicates, drift and permutation against plain versions."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import drift, experiment, permutation, ranking, segment_models, signals, survival

D = date(2024, 1, 1)


# ---- segment models


def lines(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.choice(["a", "a", "a", "b", "c", None])
        x, z = rng.gauss(0, 1), rng.randint(0, 3)
        y = int(rng.random() < 1 / (1 + math.exp(-(0.3 + (1.2 if s == "a" else -0.8) * x + 0.2 * z))))
        rows.append((s, x, float(z), y, rng.choice([1.0, 2.0, 0.5])))
    bad = [("a", None, 1.0, 1, 1.0), ("a", float("nan"), 1.0, 0, 1.0), ("a", 1.0, float("inf"), 0, 1.0), ("a", 1.0, 1.0, None, 1.0)]
    few = [("few", 1.0, 1.0, 1, 1.0), ("few", 2.0, 2.0, 0, 1.0), ("same", 1.0, 2.0, 1, 1.0), *[("same", 1.0, 2.0, 0, 1.0)] * 9]
    return rows, bad, few


LINES = "segment string, x double, z double, y int, w double"


def by_segment(rows):
    return {s: np.array([r[1:] for r in rows if r[0] == s], float) for s in {r[0] for r in rows}}


def test_least_squares_per_segment(spark):
    rows, bad, few = lines()
    df = spark.createDataFrame(rows + bad + few, LINES)
    found = {r.segment: r for r in segment_models.least_squares(df, "segment", ["x", "z"], "y", "w").collect()}
    assert set(found) == {"a", "b", "c", None, "few", "same"} and found["few"].b_0 is None and found["same"].b_1 is None and found["same"].n == 10
    for s, m in by_segment(rows).items():
        x, root = np.c_[np.ones(len(m)), m[:, :2]], np.sqrt(m[:, 3])[:, None]
        exact = np.linalg.lstsq(x * root, m[:, 2] * root[:, 0], rcond=None)[0]
        assert [found[s].b_0, found[s].b_1, found[s].b_2] == pytest.approx(exact.tolist(), abs=1e-8) and found[s].n == len(m)
    again = segment_models.least_squares(df.repartition(7), "segment", ["x", "z"], "y", "w").collect()
    assert {r.segment: r for r in again} == found  # to the last digit
    assert segment_models.least_squares(df.limit(0), "segment", ["x"], "y").count() == 0


def test_logistic_per_segment(spark):
    rows, bad, few = lines(2)
    parted = [("parted", float(i), 0.0, int(i > 5), 1.0) for i in range(10)]
    df = spark.createDataFrame(rows + bad + few + parted, LINES)
    model = segment_models.logistic(df, "segment", ["x", "z"], "y", rounds=10)
    found = {r.segment: r for r in model.collect()}
    assert found["few"].b_0 is None and found["same"].b_0 is None and found["parted"].b_0 is None
    for s, m in by_segment(rows).items():
        x, y, b = np.c_[np.ones(len(m)), m[:, :2]], m[:, 2], np.zeros(3)
        for _ in range(25):
            q = 1 / (1 + np.exp(-x @ b))
            b = b + np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]), x.T @ (y - q))
        assert [found[s].b_0, found[s].b_1, found[s].b_2] == pytest.approx(b.tolist(), abs=1e-6)
        assert (found[s].n, found[s].n_labelled) == (len(m), int(y.sum()))
    rated = segment_models.local_rates(df, model, "segment", ["x", "z"])
    assert rated.where("rate < 0 or rate > 1").count() == 0 and rated.where("segment = 'few' and rate is not null").count() == 0
    # Each segment's own model tells more than its rate.
    right = rated.where("segment = 'a' and x is not null").agg(F.avg(((F.col("rate") >= 0.5).cast("int") == F.col("y")).cast("int"))).first()[0]
    assert right > 0.6


def test_a_hot_segment_is_added_up_where_it_lies(spark):
    df = spark.range(0, 60_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("segment"),
        (F.col("id") % 11).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"),
    )
    model = segment_models.least_squares(df, "segment", ["x"], "y")
    assert model.count() == 51
    text = model._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in text and "Window" not in text


# ---- alarms


def plain_alarms(days, limit, rest):
    total = n = k = 0
    until, out = None, []
    for d, x in sorted((d, x) for d, x in days if x is not None and d is not None):
        if until is not None and d <= until:
            continue
        total, n = max(0, total + x), n + 1
        if total >= limit:
            k += 1
            out.append((k, d, total, n))
            total, n, until = 0, 0, d + timedelta(days=rest)
    return out


@pytest.mark.parametrize("limit, rest", [(10, 0), (25, 7), (1, 3), (10**9, 0)])
def test_alarms_against_a_plain_fold(spark, limit, rest):
    rng = random.Random(limit)
    rows = [
        (f"m{i % 7}", f"c{i % 7}", D + timedelta(days=i // 7), rng.choice([None, *range(-6, 9)])) for i in range(2000) if rng.random() < 0.8
    ]
    rows += [("m0", "c0", None, 50), ("twice", "t", D, 4), ("twice", "t", D, 8), ("twice", "t", D, -3), ("nothing", "n", D, None)]
    df = spark.createDataFrame(rows, "mdn_5g string, cust_id string, cpe_date date, v int").withColumn("alarm", F.lit("mine"))
    found = {}
    for r in signals.cusum_alarms(df, F.col("v"), limit, rest).collect():
        found.setdefault(r.mdn_5g, []).append((r.alarm, r.alarm_dt, r.peak, r.days))
    expected = {m: plain_alarms([(d, v) for x, _, d, v in rows if x == m], limit, rest) for m in {r[0] for r in rows}}
    assert {m: sorted(a) for m, a in found.items()} == {m: a for m, a in expected.items() if a}
    assert signals.cusum_alarms(df.limit(0), F.col("v"), limit).count() == 0


# ---- survival


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_product_limit_against_its_definition(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 150), rng.random() < 0.4) for _ in range(900)]
    rows += [("gone", d, True) for d in (3, 3, 5)] + [("all on", 9, False)] * 4 + [("bad", None, True), ("bad", -1, True), ("bad", 3, None)]
    df = spark.createDataFrame(rows, "segment string, t int, e boolean")
    found = {(r.segment, r.day): r for r in survival.product_limit(df, "segment", "t", "e", block).collect()}
    known = [r for r in rows if r[0] != "bad"]
    assert {(s, t) for s, t, _ in known} == set(found)
    for s in {r[0] for r in known}:
        alive, hazard = 1.0, 0.0
        own = [r for r in known if r[0] == s]
        for t in sorted({r[1] for r in own}):
            risk, ended = sum(r[1] >= t for r in own), sum(r[1] == t and r[2] for r in own)
            alive, hazard = alive * (1 - ended / risk), hazard + ended / risk
            r = found[s, t]
            assert (r.at_risk, r.n_ended, r.n_censored) == (risk, ended, sum(x[1] == t and not x[2] for x in own))
            assert r.survival == pytest.approx(alive, abs=1e-12) and r.hazard_sum == pytest.approx(hazard, abs=1e-12)
    medians = {r.segment: r.median_day for r in survival.median_lifetime(survival.product_limit(df, "segment", "t", "e"), "segment").collect()}
    assert medians["gone"] == 3 and medians["all on"] is None
    assert survival.product_limit(df.limit(0), "segment", "t", "e").count() == 0


def test_lifetimes_are_censored_at_the_end_of_the_data(spark):
    day = lambda n: D + timedelta(days=n)
    rows = spark.createDataFrame([(1, day(0), day(5)), (2, day(0), None), (3, day(2), day(50)), (4, None, day(3))], "id int, a date, b date")
    t, e = survival.lifetimes(F.col("a"), F.col("b"), F.lit(day(10)))
    assert [(r.t, r.e) for r in rows.orderBy("id").select(t.alias("t"), e.alias("e")).collect()] == [(5, True), (10, False), (8, False), (None, True)]


# ---- replicates


def arms(spark, n=3000):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 3 == 0, "control").otherwise("treated").alias("arm"),
        F.when(F.col("id") % 3 == 0, (F.col("id") % 5 < 2).cast("int")).otherwise((F.col("id") % 5 < 1).cast("int")).alias("churned"),
    )


def test_weights_are_poisson(spark):
    drawn = experiment.replicate_weights(spark.range(2000), ["id"], 50, "s")
    weights = [r.weight for r in drawn.select("weight").collect()]
    n = 2000 * 50
    counts = {k: sum(w == k for w in weights) for k in range(1, 6)} | {0: n - len(weights)}
    for k, seen in counts.items():
        expected = n * math.exp(-1) / math.factorial(k)
        assert abs(seen - expected) < 5 * math.sqrt(expected)
    assert drawn.agg(F.max("replicate")).first()[0] == 49


def test_interval_of_the_lift(spark):
    df = arms(spark)
    point = experiment.holdout_lift(df.where("arm is not null").withColumns({"revenue_cents": F.lit(1), "cost_cents": F.lit(1)})).first().rate_difference
    found = experiment.lift_interval(df, ["id"]).first()
    n = {a: df.where(F.col("arm") == a).count() for a in ("treated", "control")}
    p = {a: df.where(F.col("arm") == a).agg(F.avg("churned")).first()[0] for a in n}
    error = math.sqrt(sum(p[a] * (1 - p[a]) / n[a] for a in n))
    assert found.n_replicates == 200 and found.low < point < found.high and abs(found.median - point) < error / 2
    assert (found.high - found.low) == pytest.approx(2 * 1.96 * error, rel=0.25)
    assert experiment.lift_interval(df.repartition(9), ["id"]).first() == found
    none = experiment.lift_interval(df.limit(0), ["id"]).first()
    assert (none.n_replicates, none.low, none.share_positive) == (0, None, None)
    assert experiment.lift_interval(df.where("arm = 'control'"), ["id"]).first().n_replicates == 0


def test_replicates_are_added_up_before_the_shuffle(spark):
    df = experiment.lift_replicates(arms(spark), ["id"])
    assert "partial_sum" in df._jdf.queryExecution().executedPlan().toString().split("Exchange")[1]


# ---- drift


def test_distances_against_both_distribution_functions(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 4), rng.choice([None, rng.randint(-50, 50), int(rng.gauss(0, 10**6))])) for _ in range(1500)]
    rows += [(9, 10**15), (None, 3)]
    found = {r.period: r for r in drift.distances(spark.createDataFrame(rows, "p int, v bigint"), "p", "v").collect()}
    own = {p: [v for q, v in rows if q == p and v is not None] for p in found}
    every = sorted({v for vs in own.values() for v in vs})
    for p, vs in own.items():
        gap = max(abs(sum(x <= v for x in vs) / len(vs) - sum(x <= v for x in own[0]) / len(own[0])) for v in every)
        assert found[p].n == len(vs) and found[p].distance == pytest.approx(gap, abs=1e-12)
    assert found[0].distance == 0 and set(found) == {0, 1, 2, 3, 4, 9}
    assert drift.distances(spark.createDataFrame([], "p int, v bigint"), "p", "v").count() == 0


def test_summaries_add_up_and_bound_the_error(spark):
    rng = random.Random(5)
    rows = [(i % 3, i % 9, rng.choice([rng.randint(-100, 100), int(rng.paretovariate(0.3)) % 10**15, -int(rng.paretovariate(0.5)) % 10**9])) for i in range(3000)]
    df = spark.createDataFrame(rows + [(0, 0, None)], "m int, d int, v bigint")
    daily = drift.summaries(df, ["m", "d"], "v")
    shares = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    once = {r.m: r for r in drift.quantiles(drift.summaries(df, ["m"], "v"), ["m"], shares).collect()}
    assert once == {r.m: r for r in drift.quantiles(drift.added(daily, ["m"]), ["m"], shares).collect()}
    for m, r in once.items():
        own = sorted(v for x, _, v in rows if x == m)
        for name, share in shares.items():
            exact = own[math.ceil(len(own) * share - 1e-9) - 1]
            assert 0 <= r[name] - exact <= abs(exact) / 2 ** (drift.BITS - 1)


# ---- permutation


def test_permuted_rows_are_a_derangement(spark):
    rows = spark.range(500).select("id", (F.col("id") * 10).alias("a"), (F.col("id") * 100).alias("b"), F.lit("x").alias("_other"))
    out = permutation.permuted(rows, ["id"], ["a", "b"]).collect()
    assert len(out) == 1500
    for name, scale in (("a", 10), ("b", 100)):
        own = [r for r in out if r.shuffled == name]
        other = "b" if name == "a" else "a"
        assert all(r[name] != r.id * scale and r[other] == r.id * (1000 // scale) for r in own)
        assert sorted(r[name] for r in own) == [i * scale for i in range(500)]
    one = permutation.permuted(rows.limit(1), ["id"], ["a"]).collect()
    assert len(one) == 2 and one[0].a == one[1].a
    assert permutation.permuted(rows.limit(0), ["id"], ["a"]).count() == 0


def test_useless_and_leaked_inputs(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("leaked"), (F.col("id") % 7).alias("useless"), (F.col("id") % 2).alias("y"))
    found = permutation.importances(rows, ["id"], ["leaked", "useless"], lambda df: df.withColumn("prediction", F.col("leaked")), "y").collect()
    by = {r.feature: r for r in found}
    assert by["useless"].importance == 0 and by["leaked"].accuracy == 1 and 0.4 < by["leaked"].importance < 0.6


# ---- running totals


def test_no_block_holds_much_more_than_its_share(spark):
    """One number far from all others, which would put them into one block of equal width."""
    rows = spark.range(0, 40_000, 1, 16).select(F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")).alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for down in (False, True):
            out = ranking.running_totals(rows, "k", {"t": "v"}, descending=down)
            got = {r.k: r.t for r in out.collect()}
            keys = sorted(got, reverse=down)
            assert [got[k] for k in keys] == list(range(1, 40_001))
        parts = rows.repartitionByRange("k").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 4 and max(r["count"] for r in parts) < 2 * 40_000 / len(parts)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_totals_within_classes(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("c"), (F.col("id") * 7 % 3000).alias("k"), F.lit(2).alias("v"), F.lit("x").alias("_of_block"))
    rows = rows.withColumn("c", F.when(F.col("c") > 0, F.col("c")))
    out = ranking.running_totals(rows.drop("_of_block"), "k", {"t": "v"}, within=["c"]).collect()
    for c in (None, 1, 2):
        own = sorted((r.k, r.t) for r in out if r.c == c)
        assert [t for _, t in own] == list(range(2, 2002, 2))
