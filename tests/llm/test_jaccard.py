"""The n-gram join against all pairs: groups of copies around the threshold, shared passages, chains, odd input."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayline.llm import groups, jaccard
from stayline.llm.batches import joined

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def expected(rows, up=90, down=100):
    """(doc_id, n_shingles, component_id) of every row, by comparing all pairs of documents."""
    sets = [(d, frozenset(shingles(t))) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    full = sorted({(d, s) for d, s in sets if s and d is not None}, key=lambda x: x[0])
    for i, (d, a) in enumerate(full):
        for e, b in full[i + 1 :]:
            both = len(a & b)
            if both and down * both >= up * (len(a) + len(b) - both):
                low, high = sorted((root(d), root(e)))
                parent[high] = low
    return Counter((d, len(s), d if not s or d is None else root(d)) for d, s in sets)


def found(df, **limits):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined_sets(df, **limits).collect())


def made(n=250, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]

    def text(size):
        return [rng.choice(vocabulary) for _ in range(size)]

    def edited(base, times):
        out = list(base)
        for i in rng.sample(range(len(out)), times):
            out[i] = rng.choice(vocabulary)
        return out

    base, chain, passage = text(400), text(150), text(70)
    docs = [text(rng.randint(1, 200)) for _ in range(80)]
    docs += [edited(base, rng.randint(0, 12)) for _ in range(n)]  # most are near the threshold, on both sides
    for _ in range(15):
        docs.append(chain)
        chain = edited(chain, 2)
    docs += [passage + text(12) for _ in range(60)]  # a passage that many share, and little else
    docs += [text(5) + passage + text(2) for _ in range(20)]
    docs += [base[: 400 - k] for k in range(0, 60, 5)]  # shorter and shorter
    docs += [["a", "b"], ["A", "B"], ["a"], ["a", "b", "c"], ["a", "b", "c", "a", "b", "c", "a"]]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_components_against_all_pairs(spark):
    rows = made()
    rows += [(5000 + i, "  " + t.upper()) for i, t in rows[::9]] + [(1, None), (2, ""), (3, " \n\t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(df) == expected(rows)


def test_a_large_group_around_the_threshold(spark):
    """1,000 copies of one text, each with changes of its own: many are isolated, none may be lost."""
    rng = random.Random(8)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(1000):
        out = list(base)
        for k in rng.sample(range(150), rng.choice((0, 1, 2, 2, 3, 3, 4))):
            out[k] = rng.choice(("x", "y", "z"))
        rows.append((i, " ".join(out)))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == expected(rows)


def test_small_groups_and_slices_change_nothing(spark, monkeypatch):
    rows = made(60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = found(df)
    monkeypatch.setattr(groups, "GROUP_DOCS", 4)
    assert found(df) == whole == expected(rows)


def test_tokens_of_the_same_bits_lose_no_link(spark, monkeypatch):
    rows = made(60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "KEY_BITS", 7)
    assert found(df) == expected(rows)


def test_texts_that_are_not_wanted_stay_where_they_lie(spark):
    docs = spark.range(6000).select((F.col("id") * 37 - 5000).alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "n")], "doc_id bigint, text string"))
    wanted = docs.where("doc_id % 100 = 0").select("doc_id")
    ids = {r.doc_id for r in wanted.collect()}
    left = [r.doc_id for r in jaccard.rows_with(docs, wanted).collect()]
    assert len(ids) == 60 and ids <= set(left) and len(left) == len(set(left)) < 1000
    assert not jaccard.rows_with(docs, wanted.where("false")).collect()


def test_one_set_of_repeated_rows(spark):
    rows = [(1, "a b c d"), (1, "A b c d"), (1, "e f g"), (1, "a b c d"), (2, "a b c d"), (3, "e f g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    wanted = spark.createDataFrame([(7, 1, "a b c d"), (8, 1, "e f g")], "id bigint, doc_id bigint, text string")
    sets = jaccard.whole_sets(docs, wanted.select("id", "doc_id", F.xxhash64("text").alias("raw")))
    assert sorted((r.id, r["size"], len(r.tokens)) for r in sets.collect()) == [(7, 2, 2), (8, 1, 1)]
    # The tokens, several times a text's bytes, are not shuffled once more.
    plan = sets._jdf.queryExecution().sparkPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")


def test_another_limit(spark):
    rows = made(60)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string"), up=7, down=10) == expected(rows, 7, 10)


def test_all_documents(tables):
    docs = tables("documents")
    assert found(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == expected(rows)
    assert found(no_docs) == Counter()
    # One id with two texts is one document.
    two = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "E f g h"), (3, "a b c d"), (4, "q")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.joined_sets(two).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_sets_of_texts():
    texts = ["a b c a b c a", "", None, " one ", "A\tB\nc", "x " * 50, "é ß 中 é ß 中"]
    keys, at = jaccard.shingle_sets(*joined(pa.array(texts)))
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
    same = [set(keys[at[i] : at[i + 1]].tolist()) for i in (0, 4)]
    assert len(same[0] & same[1]) == len(shingles(texts[0]) & shingles(texts[4])) == 1
    assert all((np.diff(keys[a:b]) > 0).all() for a, b in zip(at[:-1], at[1:]))


def test_overlaps_over_slices(monkeypatch):
    rng = np.random.default_rng(2)
    sides = []
    for n in (7, 5):
        sets = [rng.choice(400, rng.integers(0, 200), replace=False) for _ in range(n)]
        sides.append((sets, np.concatenate(sets).astype(np.int64), np.r_[0, np.cumsum([len(s) for s in sets])]))
    (a, ta, at), (b, tb, bt) = sides
    exact = [[len(set(x) & set(y)) for y in b] for x in a]
    for width in (3, 64, 10_000):
        monkeypatch.setattr(groups, "SLICE", width)
        assert groups.overlaps(ta, at, tb, bt).tolist() == exact


@pytest.mark.parametrize("up, down", [(90, 100), (4, 5), (1, 2)])
def test_missing_tokens_of_linked_sets(up, down):
    sizes = np.arange(1, 300)
    for n, m in zip(sizes.tolist(), jaccard.missing(sizes, up, down).tolist()):
        # An overlap of n - m is enough for a subset of that size, one less never is.
        assert down * (n - m) >= up * n and down * (n - m - 1) < up * n


def test_groups_that_cannot_qualify_are_not_opened(spark):
    columns = groups.matrix(
        spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, 3, 20), (4, 4, 30)], "id bigint, class bigint, group bigint"),
        spark.createDataFrame(
            [(1, list(range(10))), (2, list(range(5, 15))), (3, list(range(1, 11))), (4, list(range(8, 18)))], "id bigint, tokens array<bigint>"
        ),
        3, 10,
    )
    pairs = spark.createDataFrame([(10, 20), (10, 30), (20, 30)], "a bigint, b bigint")
    kept = {tuple(r) for r in groups.qualifying(pairs, columns, 9, 10).collect()}
    assert kept == {(10, 20)}
    first = columns.where("group = 10").first()
    assert len(first.union) == 15 and first.links == [2, 1]  # 5 of 15 in common


def test_of_two_groups_the_smaller_one_travels(spark, monkeypatch):
    # A class of 40 sets meets 30 classes of one set each; every other of these has a set that is linked with some of the large class.
    large = {i: range(i, i + 100) for i in range(40)}
    small = {1000 + k: range(k, k + 100) if k % 2 == 0 else [*range(k, k + 20), *range(10_000 + 100 * k, 10_080 + 100 * k)] for k in range(30)}
    sets = spark.createDataFrame([(i, len(t), list(t)) for i, t in (large | small).items()], "id bigint, size bigint, tokens array<bigint>")
    classes = spark.createDataFrame([*((i, 0) for i in large), *((i, i) for i in small)], "id bigint, class bigint")
    members = spark.createDataFrame([x for k in range(30) for x in ((k, k), (k, 1000 + k))] + [(0, i) for i in large if i], "bucket bigint, id bigint")
    plain, seen = groups.qualifying, []
    monkeypatch.setattr(groups, "qualifying", lambda pairs, columns, up, down: seen.append((pairs, columns)) or plain(pairs, columns, up, down))
    links = groups.links_between(members, sets, classes, 9, 10).collect()
    (pairs, columns), = seen
    unions = {r.group: len(r.union) for r in columns.collect()}
    met = pairs.collect()
    assert len(met) == 30 and all(unions[a] >= unions[b] for a, b in met)
    assert sorted(a for a, _ in links) == [1000 + k for k in range(0, 30, 2)]
    for a, b in links:
        x, y = set(small[a]), set(large[b])
        assert 10 * len(x & y) >= 9 * len(x | y)
