"""Decontamination, language, quality and near-duplicates: planted cases, held-out accuracy, brute force, odd input."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayline.llm import decontaminate, language, near_dedup, quality
from stayline.llm.batches import joined

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- decontamination


def hits(text, items, width=13):
    own, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        size = min(width, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


def check_hits(docs, bench):
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = defaultdict(list)
    for r in decontaminate.scanned(docs.select("doc_id", "text", "source"), bench).collect():
        got[r.doc_id, r.text].append(r)
    for row in docs.select("doc_id", "text").collect():
        r = got[row.doc_id, row.text][0]
        n, hit, found = hits(row.text, items)
        assert (r.n_words, r.n_hit, r.n_items, r.items) == (n, hit, len(found), found)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        spans = [w for s in r.spans for w in words(row.text[s.start : s.end])]
        assert len(spans) == hit


def test_hits_in_all_documents(tables):
    check_hits(tables("documents"), tables("benchmark"))


def test_hits_in_odd_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(
        [(1, "Quick BROWN fox"), (2, None), (3, ""), (10, "word3 word4"), (10, "one more text for the item"), (4, "中文"),
         (5, " ".join(f"word{i % 977}" for i in range(970, 1000))), (None, "without any id")],
        "item_id bigint, text string",
    )
    docs = odd_docs.where("doc_id is not null")
    check_hits(docs, bench.where("item_id is not null"))
    assert decontaminate.scanned(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.scanned(odd_docs, bench).where("items = array('null')").select("doc_id").first().doc_id is None
    assert decontaminate.scanned(no_docs, bench).count() == 0
    assert decontaminate.scanned(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_shards_together_find_what_one_automaton_finds(tables, monkeypatch):
    def rows():
        return sorted(map(tuple, decontaminate.scanned(tables("documents").select("doc_id", "text"), tables("benchmark")).collect()))

    whole = rows()
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 3000)
    assert len(list(decontaminate.shards(tables("benchmark")))) > 2
    assert rows() == whole


# ---- language


def test_language_of_held_out_documents(tables):
    docs = tables("documents")
    learned = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.classify(docs, learned).where(language.held_out(F.col("doc_id")))
    right, n, rejected = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert right / n > 0.95 and rejected / n < 0.02
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_of_odd_documents(odd_docs, no_docs, tables):
    learned = language.learn(tables("documents"))
    found = language.classify(odd_docs, learned)
    assert found.columns[: len(odd_docs.columns) - 1] == [c for c in odd_docs.columns if c != "score"]
    by_id = {r.doc_id: r for r in found.collect()}
    assert found.count() == 10
    assert all(by_id[i].lang_pred == "und" and by_id[i].rejected and by_id[i].score == 0 for i in (2, 3, 4))
    assert all(by_id[i].lang_pred != "und" for i in (1, 5, 6, 7, 8))
    assert language.classify(no_docs, learned).count() == 0
    nothing = language.learn(no_docs)
    assert nothing.content == {} and language.classify(odd_docs, nothing).where("lang_pred <> 'und'").count() == 0
    only = language.classify(odd_docs, language.Dictionaries({"en": b"the quick brown fox"})).where("doc_id = 1").first()
    assert (only.lang_pred, only.score, only.margin) == ("en", 1.0, 1.0)


def test_language_of_long_unmixed_documents(spark, tables):
    docs = tables("documents")
    rows = [r for r in docs.select("doc_id", "lang", "text").collect() if r.text]
    long = []
    for i, lang in enumerate(sorted({r.lang for r in rows})):
        own = " ".join(r.text for r in sorted(rows, key=lambda r: r.doc_id) if r.lang == lang)
        for n in (100_000, 300_000, 3_000_000):
            long.append((n + i, (own + " ") * (n // len(own) + 1), lang))
    learned = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.classify(spark.createDataFrame(long, "doc_id bigint, text string, lang string"), learned).collect()
    assert len(found) == len(long)
    assert all(r.lang_pred == r.lang and not r.rejected and r.margin > 0.02 for r in found)


def test_dictionaries_do_not_depend_on_partitions(tables):
    docs = tables("documents")
    assert language.learn(docs) == language.learn(docs.repartition(7))


# ---- quality


def test_forward_backward_against_all_state_sequences():
    rng = np.random.default_rng(1)
    first = np.array([0, 1, 4, 6])
    scores, ties = rng.normal(size=6), rng.normal(size=(2, 2))
    p, expected = quality.forward_backward(scores, ties, first)
    marginal, moves = np.zeros(6), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        n, total, one, pair = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            weight = np.exp(sum(scores[a + i] * y[i] for i in range(n)) + sum(ties[y[i], y[i + 1]] for i in range(n - 1)))
            total += weight
            one += weight * np.array(y)
            for i in range(n - 1):
                pair[y[i], y[i + 1]] += weight
        marginal[a:b], moves = one / total, moves + pair / total
    assert np.allclose(p, marginal) and np.allclose(expected, moves)


def test_quality_of_held_out_documents(tables):
    docs, labels = tables("documents"), tables("labels")
    field = quality.learn(docs, labels)
    found = quality.score(docs, field).join(labels.select("doc_id", "quality"), "doc_id").where(language.held_out(F.col("doc_id")))
    right, n = found.agg(F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert right / n > 0.9


def test_quality_of_odd_documents(odd_docs, no_docs, tables):
    field = quality.learn(tables("documents"), tables("labels"))
    found = quality.score(odd_docs, field).collect()
    assert len(found) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    one = [r.score for r in found if r.doc_id == 1]
    assert one[0] == one[1]
    assert quality.score(no_docs, field).count() == 0
    labels = tables("labels")
    assert quality.learn(no_docs, labels) is None and quality.learn(odd_docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(odd_docs, None).collect()} == {0.5}


def test_line_features_of_one_text_do_not_depend_on_the_others():
    texts = ["a b\nA B!!\na b", "", "x|y\n\nz", "same same same\nsame"]
    whole, lengths, first = quality.line_features(*joined(pa.array(texts)))
    for i, text in enumerate(texts):
        alone, own, _ = quality.line_features(*joined(pa.array([text])))
        assert np.allclose(alone, whole[first[i] : first[i + 1]]) and (own == lengths[first[i] : first[i + 1]]).all()


# ---- near duplicates


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both, all_ = sum((a & b).values()), sum((a | b).values())
    return both / all_ if all_ else 0.0


def classes(docs):
    """Class of each document, by comparing all pairs that share a shingle."""
    rows = [(d, t) for d, t in docs if t and d is not None]
    sets, holders = {d: shingles(t) for d, t in rows}, defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def union(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    by_text = {}
    for d, t in rows:
        union(d, by_text.setdefault(t, d))
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        if similarity(sets[a], sets[b]) >= 0.8:
            union(a, b)
    return {d: root(d) for d in parent}


def found_classes(df):
    return {r.doc_id: r.class_id for r in near_dedup.near_classes(df).collect()}


def test_classes_of_all_documents(tables):
    docs = tables("documents")
    expected = classes([(r.doc_id, r.text) for r in docs.collect()])
    assert found_classes(docs) == expected


def made_docs():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    def edited(base, n):
        out = list(base)
        for i in rng.sample(range(len(out)), n):
            out[i] = rng.choice(vocabulary)
        return out

    docs = [text(rng.randint(3, 300)) for _ in range(150)]  # clean ones
    base = text(300)
    docs += [edited(base, rng.randint(0, 6)) for _ in range(120)]  # a large group
    chain = text(200)
    for _ in range(12):  # a chain: only neighbours are similar
        docs.append(chain)
        chain = edited(chain, 3)
    passage = text(60)
    docs += [text(20) + passage + text(20) for _ in range(60)]  # share a passage and are no copies
    docs += [["many", "words", "again"] * rng.choice((50, 51, 90)) for _ in range(12)]  # weights decide
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    return rows + [(1000 + i, t) for i, t in rows[::7]]  # exact copies


def test_classes_against_all_pairs(spark):
    rows = made_docs()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_classes(df) == classes(rows)


def test_signatures_agree_as_the_weighted_similarity():
    a, b = "x y z w v u " * 30 + "p q r s t " * 5, "x y z w v u " * 20 + "p q r s t " * 12
    keys, at = near_dedup.strips(*joined(pa.array([a, b])))
    left, right = (set(keys[at[i] : at[i + 1]].tolist()) for i in (0, 1))
    exact = similarity(shingles(a), shingles(b))
    assert len(left & right) / len(left | right) == pytest.approx(exact)
    signature = near_dedup.dart_signatures(keys, at, 4000)
    assert (signature[0] == signature[1]).mean() == pytest.approx(exact, abs=0.03)


def test_near_classes_of_odd_documents(spark, odd_docs, no_docs):
    found = sorted(map(tuple, near_dedup.near_classes(odd_docs).select("doc_id", "class_id").collect()), key=str)
    assert found == sorted([(1, 1), (1, 1), *((i, i) for i in range(2, 9)), (None, None)], key=str)
    assert near_dedup.near_classes(no_docs).count() == 0
    kept = near_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 9
    two = spark.createDataFrame([(1, "a b c d e f g h"), (1, "k l m n o p q r"), (2, "k l m n o p q r")], "doc_id bigint, text string")
    assert {tuple(r) for r in near_dedup.near_classes(two).select("doc_id", "class_id").collect()} == {(1, 1), (2, 1)}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {(r.id, r["class"]) for r in found.collect()} == {(x, root(x)) for x in linked}


def classes_by_all_pairs(rows):
    """As ``classes``, for texts of which nearly all pairs share something: each pair's strips are counted once."""
    sets = [(d, frozenset((x, i) for x, n in shingles(t).items() for i in range(n))) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[i + 1 :]:
            both = len(a & b)
            if 5 * both >= 4 * (len(a) + len(b) - both):
                low, high = sorted((root(d), root(e)))
                parent[high] = low
    return {d: root(d) for d in parent}


def test_a_large_group_around_the_least_similarity(spark, monkeypatch):
    """1,000 copies of one text with changes of their own, on both sides of 0.8, in groups of any size."""
    rng = random.Random(11)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(1000):
        out = list(base)
        for k in rng.sample(range(120), rng.choice((0, 1, 2, 3, 3, 4, 5))):
            out[k] = rng.choice(("x", "y", "z", f"own{i}"))
        rows.append((i, " ".join(out)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = classes_by_all_pairs(rows)
    assert 3 < len(set(expected.values())) < 900
    assert found_classes(df) == expected
    monkeypatch.setattr(near_dedup.groups, "GROUP_DOCS", 4)
    assert found_classes(spark.createDataFrame(rows[:300], "doc_id bigint, text string")) == classes_by_all_pairs(rows[:300])


def test_one_row_of_an_id_with_several_texts_stays(spark):
    rows = [(1, "b b b b b b", "x"), (1, "a a a a a a", "y"), (1, "a a a a a a", "x"), (2, "a a a a a a", "z"), (3, None, "n"), (3, None, "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = [sorted(map(tuple, near_dedup.deduplicated(df.repartition(n)).collect()), key=str) for n in (1, 3, 5)]
    assert kept[0] == kept[1] == kept[2] and [r[:2] for r in kept[0]] == [(1, "a a a a a a"), (3, None), (3, None)]


def test_pieces_of_darts_are_bounded_by_texts(spark, monkeypatch):
    sizes = []
    darts = near_dedup.dart_signatures
    monkeypatch.setattr(near_dedup, "dart_signatures", lambda strip, offsets, size: sizes.append(len(offsets) - 1) or darts(strip, offsets, size))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(["k"] * 2000), pa.array(["one"] * 2000)], names=["doc_id", "text_key", "text"])
    found = {}

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            found["out"] = list(run(iter([batch])))

    near_dedup.sketches(Docs())
    assert sum(b.num_rows for b in found["out"]) == 2000 and max(sizes) <= near_dedup.TEXTS


def test_scan_keeps_columns_called_like_inner_ones(spark, tables):
    docs = tables("documents").select("doc_id", "text", F.lit("mine").alias("_scan_words"), F.lit("mine").alias("_scan_ranges"), F.lit(1).alias("_scan_items"), F.lit(2).alias("_scan_row"))
    found = decontaminate.scanned(docs, tables("benchmark"))
    assert found.columns[:6] == docs.columns and found.where("_scan_words = 'mine' and _scan_items = 1 and _scan_row = 2").count() == docs.count()
    plain = decontaminate.scanned(docs.select("doc_id", "text"), tables("benchmark"))
    assert sorted(map(tuple, found.select("doc_id", "n_hit").collect())) == sorted(map(tuple, plain.select("doc_id", "n_hit").collect()))
    assert decontaminate.scanned(docs.select("text"), tables("benchmark")).columns[0] == "text"
