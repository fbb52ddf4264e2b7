"""Dyadic nodes, joins on intervals of any length, and histories from contradicting records."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stayline.operators import intervals
from stayline.operators.history import OPEN_END

D = date(1990, 1, 1)


def day(n):
    return D + timedelta(days=n)


def test_nodes_make_up_the_interval(spark):
    rng = random.Random(1)
    spans = [(0, 0), (0, 3), (1, 4), (5, 5), (3, 66_000), (-70, 20), (15, 16), (0, 65_535), (1, 65_536), (9, 8)]
    spans += [(a := rng.randint(-9000, 30_000), a + int(rng.paretovariate(0.4))) for _ in range(300)]
    rows = spark.createDataFrame([(i, a, min(b, 70_000)) for i, (a, b) in enumerate(spans)], "i int, a int, b int")
    found = rows.select("i", "a", "b", intervals.nodes(F.col("a"), F.col("b")).alias("n")).collect()
    for r in found:
        covered = sorted(d for n in r.n for d in range(n.node << 2 * n.level, (n.node + 1) << 2 * n.level))
        assert covered == list(range(r.a, r.b + 1))  # every day once


def test_copies_grow_with_the_logarithm(spark):
    """At most six nodes per size that fits in, so 50 years make fewer than 50 copies, where years would make 51 and days 18,263."""
    lengths = [1, 30, 365, 3650, 18_263]
    rows = spark.createDataFrame([(n, s) for n in lengths for s in range(0, 4000, 37)], "n int, s int")
    most = {
        r.n: r.most for r in rows.select("n", F.size(intervals.nodes(F.col("s"), F.col("s") + F.col("n") - 1)).alias("k")).groupBy("n").agg(F.max("k").alias("most")).collect()
    }
    assert most[1] == 1 and all(most[n] <= 6 * (1 + len(f"{n:b}") / 2) for n in lengths) and most[18_263] < 50


FACTS = [("a", day(0)), ("a", day(5)), ("a", day(9)), ("a", day(18_000)), ("b", day(5)), (None, day(5)), ("a", None), ("c", day(1)), ("a", day(5))]
HISTORY = [
    ("a", day(0), day(4), "p"), ("a", day(5), day(5), "q"), ("a", day(3), day(17_999), "long"), ("a", day(18_000), OPEN_END, "open"),
    ("a", day(9), None, "no end"), ("a", day(7), day(6), "never"), ("a", None, day(9), "no start"), (None, day(0), day(99), "no key"), ("c", day(2), day(3), "z"),
]


def tables(spark):
    facts = spark.createDataFrame(FACTS, "k string, d date").withColumn("_node", F.lit("mine"))
    return facts, spark.createDataFrame(HISTORY, "k string, eff_dt date, exp_dt date, v string")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_interval_join_against_all_pairs(spark, how):
    facts, history = tables(spark)
    expected = []
    for k, d in FACTS:
        hits = [h[3] for h in HISTORY if k is not None and d is not None and h[0] == k and h[1] is not None and h[1] <= d <= (h[2] or OPEN_END)]
        expected += [(k, d, *([] if how == "left_semi" else [v])) for v in (hits[:1] if how == "left_semi" else hits)] or ([(k, d, None)] if how == "left" else [])
    out = intervals.interval_join(facts, history, ["k"], at="d", how=how)
    got = out.select("k", "d", *([] if how == "left_semi" else ["v"])).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert out.where("_node = 'mine'").count() == len(expected)


def test_interval_join_of_empty_tables(spark):
    facts, history = tables(spark)
    assert intervals.interval_join(facts.limit(0), history, ["k"], at="d").count() == 0
    assert intervals.interval_join(facts, history.limit(0), ["k"], at="d").where("v is null").count() == len(FACTS)
    assert intervals.interval_join(facts, history.limit(0), ["k"], at="d", how="inner").count() == 0
    with pytest.raises(ValueError):
        intervals.interval_join(facts, history, ["k"], at="d", how="outer")


def by_day(records, last):
    """{key: {day: value}}, the highest (priority, value) of each day."""
    out = {}
    for k, a, b, p, v in records:
        if k is None or a is None:
            continue
        for n in range((a - D).days, min(last, ((b or OPEN_END) - D).days) + 1):
            rank = (p is not None, p or 0, v is not None, v or "")
            if n not in out.setdefault(k, {}) or out[k][n][0] < rank:
                out[k][n] = (rank, v)
    return {k: {n: v for n, (_, v) in days.items()} for k, days in out.items()}


def unfolded(rows, last):
    out = {}
    for r in rows:
        for n in range((r.eff_dt - D).days, min(last, (r.exp_dt - D).days) + 1):
            assert n not in out.setdefault(r.k, {}), "overlap"
            out[r.k][n] = r.v
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randint(0, 300)
        b = rng.choice([day(a + rng.randint(0, 3)), day(a + rng.randint(0, 200)), OPEN_END if i % 40 == 0 else day(a), None if i % 60 == 0 else day(a + 30)])
        rows.append((rng.choice("abc"), day(a), b, rng.choice([1, 2, 3, None, i]), rng.choice(["x", "y", None])))
    return rows + [("d", day(5), day(4), 1, "never"), ("d", None, day(4), 1, "no start"), (None, day(1), day(4), 1, "no key"), *rows[:5]]


SCHEMA = "k string, eff_dt date, exp_dt date, p int, v string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolved_against_every_single_day(spark, seed):
    rows = made(seed)
    found = intervals.resolved(spark.createDataFrame(rows, SCHEMA), ["k"], ["v"], ["p"]).collect()
    assert unfolded(found, 1200) == by_day(rows, 1200)
    for k in "abc":  # no two that adjoin have the same value
        own = sorted((r.eff_dt, r.exp_dt, r.v) for r in found if r.k == k)
        assert all(x[1] < y[0] and (x[1] + timedelta(days=1) < y[0] or x[2] != y[2]) for x, y in zip(own, own[1:]))


def test_late_records_close_split_and_replace(spark):
    history = [("a", day(0), day(99), "x"), ("a", day(100), OPEN_END, "y"), ("b", day(0), day(9), "x"), ("untouched", day(3), OPEN_END, "u"), (None, day(0), day(1), "n")]
    late = [("a", day(40), day(49), 1, "z"), ("a", day(45), day(110), 2, "w"), ("b", day(0), OPEN_END, 1, "v"), ("new", day(1), day(1), 1, None)]
    out = intervals.with_late_records(
        spark.createDataFrame(history, "k string, eff_dt date, exp_dt date, v string"), spark.createDataFrame(late, SCHEMA), ["k"], ["v"], ["p"]
    )
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [
        ("a", day(0), day(39), "x"), ("a", day(40), day(44), "z"), ("a", day(45), day(110), "w"), ("a", day(111), OPEN_END, "y"),
        ("b", day(0), OPEN_END, "v"), ("untouched", day(3), OPEN_END, "u"), (None, day(0), day(1), "n"), ("new", day(1), day(1), None),
    ]))


def test_merging_late_records_in_turn_is_resolving_all(spark):
    rows = [r for r in made(7, 80) if r[3] is not None and r[0] is not None]
    rows = [(k, a, b, i, v) for i, (k, a, b, _, v) in enumerate(rows)]
    whole = intervals.resolved(spark.createDataFrame(rows, SCHEMA), ["k"], ["v"], ["p"]).collect()
    history = intervals.resolved(spark.createDataFrame(rows[:30], SCHEMA), ["k"], ["v"], ["p"])
    for low in (30, 60):
        history = intervals.with_late_records(history, spark.createDataFrame(rows[low : low + 30], SCHEMA), ["k"], ["v"], ["p"])
    assert sorted(map(str, history.collect())) == sorted(map(str, whole))


def test_empty_and_hot_histories(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert intervals.resolved(none, ["k"], ["v"], ["p"]).count() == 0
    # 30,000 records of one key in 300 days leave at most 300 rows a step.
    hot = spark.range(30_000).select(
        F.lit("hot").alias("k"), F.date_add(F.lit(D), (F.col("id") % 300).cast("int")).alias("eff_dt"),
        F.date_add(F.lit(D), (F.col("id") % 300 + F.col("id") % 17).cast("int")).alias("exp_dt"), F.col("id").cast("int").alias("p"), F.lit("x").alias("v"),
    )
    found = intervals.resolved(hot, ["k"], ["v"], ["p"]).collect()
    assert [(r.eff_dt, r.exp_dt) for r in found] == [(day(0), day(315))]


def test_a_resolved_history_shuffles_days_and_cells_once_by_key(spark):
    """The nodes are keys of a shuffle where records become cells and nowhere else; a day is not copied before it is shuffled."""
    plan = intervals.resolved(spark.createDataFrame(made(4), SCHEMA), ["k"], ["v"], ["p"])._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sum("_node" in line for line in exchanges) == 1 and len(exchanges) == 3


def test_nodes_of_a_join_cover_the_interval_with_few_copies(spark):
    rng = random.Random(2)
    spans = [(0, 0), (63, 64), (64, 127), (60, 200), (-70, 20), (9, 8), (0, 65_535), *((a := rng.randint(-9000, 30_000), a + rng.randint(0, 18_250)) for _ in range(200))]
    rows = spark.createDataFrame([(a, b) for a, b in spans], "a int, b int")
    for r in rows.select("a", "b", intervals.nodes(F.col("a"), F.col("b"), 3).alias("n")).collect():
        covered = [d for n in r.n for d in range(n.node << 2 * n.level, (n.node + 1) << 2 * n.level)]
        assert len(covered) == len(set(covered)) and set(range(r.a, r.b + 1)) <= set(covered)
        assert len(covered) <= r.b - r.a + 1 + 126 and all(n.level >= 3 for n in r.n) and (r.a <= r.b or not r.n)
        assert len(r.n) <= 2 + (r.b - r.a + 1) // 64 and len(r.n) <= 30


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_interval_join_at_the_edges_of_nodes(spark, how):
    rng = random.Random(3)
    facts = [(rng.choice("ab"), day(rng.randint(-80, 400)), i) for i in range(150)]
    ends = [-64, -1, 0, 1, 62, 63, 64, 65, 127, 128, 255, 256, 300]
    history = [(k, day(a), rng.choice([None, *(day(b) for b in ends if b >= a - 1)]), a) for k in "ab" for a in ends for _ in range(2)]
    expected = []
    for k, d, i in facts:
        hits = [h[3] for h in history if h[0] == k and h[1] <= d <= (h[2] or OPEN_END)]
        expected += [(i,)] * bool(hits) if how == "left_semi" else [(i, v) for v in hits or ([None] if how == "left" else [])]
    out = intervals.interval_join(
        spark.createDataFrame(facts, "k string, d date, i int"), spark.createDataFrame(history, "k string, eff_dt date, exp_dt date, v int"), ["k"], at="d", how=how
    )
    assert sorted(map(str, map(tuple, out.select("i", *([] if how == "left_semi" else ["v"])).collect()))) == sorted(map(str, expected))
