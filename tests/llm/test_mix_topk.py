import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import mixing, topk


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, "d": 7, "e": 0, "f": 900, None: 50}
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = mixing.with_targets(mixing.source_weights(rows)).collect()
    assert {r.source: r.weight for r in found} == weight
    assert {r.source: r.target for r in found} == pytest.approx(target)


def test_taken_words_come_near_the_targets(tables):
    docs = mixing.mixed(tables("documents").withColumn("source", F.when(F.col("source") != "src1", F.col("source"))))
    sums = docs.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("repeats")).alias("taken"), F.max("size").alias("most")).collect()
    assert len(sums) == 20 and all(r.target - r.most <= r.taken <= r.target for r in sums)
    assert docs.where("repeats > 2").count() == 0
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, mixing.mixed(tables("documents").withColumn(
        "source", F.when(F.col("source") != "src1", F.col("source"))).repartition(5)).collect()))


def test_a_long_document_at_a_low_place_leaves_no_gap(spark):
    """A source of 1,000 documents of 10 words and one of 9,000 that comes before most of them."""
    places = {r.id: r.place for r in spark.range(3000).select("id", mixing.place(F.col("id")).alias("place")).collect()}
    low = min(range(1000, 3000), key=lambda i: abs(int(places[i], 16) / 16**mixing.DIGITS - 0.05))
    rows = [(i, "w " * 10, "s") for i in range(1000)] + [(low, "w " * 9000, "s"), (5000, "w " * 9000, "t"), (5001, "w " * 3000, "t")]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    sums = found.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("repeats")).alias("taken")).collect()
    own = {r.source: r for r in sums}["s"]
    assert own.target - 10 < own.taken <= own.target


def test_turns_against_one_place_after_the_other(spark):
    units = [(s, mixing_place, size) for s in ("a", "b", None) for mixing_place, size in places_of(s)]
    budgets = [("a", 5000, 90_000.0), ("b", 70, 500.0), (None, 0, 0.0)]
    table = spark.createDataFrame(units, "source string, place string, size bigint")
    turns = mixing.fitting(table, spark.createDataFrame(budgets, "source string, budget bigint, target double"), near=10**9)
    plan = {r.source: r.turns for r in turns.collect()}
    for source, budget, _ in budgets:
        room, expected = budget, set()
        for _, place, size in sorted(u for u in units if u[0] == source) if source else sorted((u for u in units if u[0] is None), key=lambda u: u[1]):
            if 0 < size <= room:
                room -= size
                expected.add(place)
        found = {
            p for s, p, n in units if s == source and n > 0
            and any(p > t.after and (t.below is None or p < t.below) and n <= t.most for t in plan[source])
        }
        assert found == expected


def places_of(source):
    import hashlib
    import random

    rng = random.Random(str(source))
    return [(hashlib.md5(f"{source}{i}".encode()).hexdigest()[: mixing.DIGITS], int(rng.paretovariate(0.7)) % 4000) for i in range(300)]


def test_budgets_nest(spark):
    sized = spark.range(5000).select(F.lit("s").alias("source"), mixing.place(F.col("id")).alias("place"), (F.col("id") % 50).alias("size"))
    kept = []
    for budget in (0, 10, 1000, 60_000):
        below = mixing.thresholds(sized, spark.createDataFrame([("s", budget)], "source string, budget bigint")).first()["below"]
        own = sized.where(F.col("place") < below)
        assert (own.agg(F.sum("size")).first()[0] or 0) <= budget < (sized.where(F.col("place") <= below).agg(F.sum("size")).first()[0])
        kept.append({r.place for r in own.collect()})
    assert kept[0] <= kept[1] <= kept[2] < kept[3]


def test_mix_of_odd_documents(spark, odd_docs, no_docs):
    found = mixing.mixed(odd_docs)
    assert found.count() == 10 and found.where("size = 0 and doc_id not in (2, 3)").count() == 0
    assert found.where("doc_id = 1").select("repeats").distinct().count() == 1
    assert mixing.mixed(no_docs).count() == 0
    empty = mixing.mixed(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string"))
    assert [(r.target, r.repeats) for r in empty.collect()] == [(0.0, 0), (0.0, 0)]


def test_place_parts_one_hash_bucket(spark):
    # All of a source in one document that does not fit.
    docs = spark.createDataFrame([(1, "w " * 100, "a"), (2, "w " * 3, "b"), (3, "w " * 4, "b")], "doc_id bigint, text string, source string")
    found = {r.doc_id: (r.repeats, r.target) for r in mixing.mixed(docs).collect()}
    assert found[1][0] in (1, 2) and found[1][0] * 100 <= found[1][1]


# ---- exact top-k


def brute(rows, queries, k):
    out = []
    for q, a in queries:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize(("width", "spread"), [(2, 3), (8, 2), (16, 1000)])
def test_top_k_with_ties_against_all_pairs(spark, width, spread):
    rng = np.random.default_rng(width)
    rows = [(i * 3, rng.integers(-spread, spread + 1, width).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    found = topk.top_k(df, df.where("vec_id % 20 = 0"), 9)
    assert sorted(map(tuple, found.collect())) == brute(rows, [r for r in rows if r[0] % 20 == 0], 9)


def test_the_bound_stops_before_all_rows_are_read(monkeypatch):
    rng = np.random.default_rng(0)
    rows = rng.integers(-50, 50, (20_000, 3))
    read = []
    flat = np.flatnonzero
    monkeypatch.setattr(topk.np, "flatnonzero", lambda x: read.append(int(x.sum())) or flat(x))
    topk.threshold_topk(rows[:4], np.arange(4), rows, np.arange(20_000), 5)
    assert sum(read) < 20_000 / 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.26]), (20, [1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf]), (5, []), (6, [0.1, 0.2, 3.0]),
            (None, [1.0, 1.0]), (7, [0.5, -0.26]), (7, [0.5, -0.26])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("mine"))
    vectors = df.select("vec_id", topk.whole_vector(F.col("embedding")).alias("vector"))
    found = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)
    usable = [(0, [32, -17, 0]), (20, [64, 0, 0]), (5, [0, 0, 0]), (6, [6, 12, 192]), (7, [32, -17, 0]), (7, [32, -17, 0])]
    assert sorted(map(tuple, found.collect())) == brute(usable, usable[:2], 20)
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 20).count() == 0
    assert topk.top_k(vectors, vectors.limit(0), 20).count() == 0
