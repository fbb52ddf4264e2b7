"""Importance resampling against a plain version, and its cut-off and ranks against a sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayline.llm import resample
from stayline.llm.batches import joined

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def plain(docs, bench):
    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in bench for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))

    rows = []
    for d, words, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows), key=str)


def check(docs, bench):
    got = sorted((tuple(r) for r in resample.resampled(docs, bench).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])


def test_all_documents(tables):
    check(tables("documents"), tables("benchmark"))


def test_odd_documents(spark, odd_docs, no_docs, tables):
    check(odd_docs, tables("benchmark"))
    check(odd_docs, tables("benchmark").limit(0))
    assert resample.resampled(no_docs, tables("benchmark")).count() == 0
    # Very many rows without id, and one id very often: all rows draw the same noise, and ties stay in order.
    text = " ".join(f"w{i}" for i in range(30))
    many = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 9).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    check(many, tables("benchmark"))


def test_drawn_documents_are_nearer_to_the_target(tables):
    rows = resample.resampled(tables("documents"), tables("benchmark"))
    drawn, rest = (rows.where(c).agg(F.avg("weight")).first()[0] for c in ("rank is not null", "rank is null"))
    assert drawn > rest


def test_results_do_not_depend_on_partitions(tables):
    docs, bench = tables("documents"), tables("benchmark")
    one = sorted(map(tuple, resample.resampled(docs, bench).collect()), key=str)
    assert sorted(map(tuple, resample.resampled(docs.repartition(9), bench).collect()), key=str) == one


def test_buckets_of_texts():
    rng = random.Random(6)
    letters = "abcdefXYZ019éß中🙂"
    texts = ["", None, "one", "... !", "x" * 64 + " y", "a " + "x" * 65 + " b", "é" * 100 + " é"]
    texts += [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(0, 30))) for _ in range(50)]
    one, two, first = resample.features(*joined(pa.array(texts)))
    for i, text in enumerate(texts):
        own = slice(first[i], first[i + 1])
        assert Counter(one[own].tolist() + [x for x in two[own].tolist() if x >= 0]) == Counter(features(text)[1])


@pytest.mark.parametrize("wanted", [1, 2, 37, 500, 999, 1000])
def test_bracket_against_a_sort(spark, wanted):
    rng = np.random.default_rng(wanted)
    numbers = np.r_[rng.integers(-(10**6), 10**6, 700), np.full(300, 17)]
    rows = spark.createDataFrame([(int(x),) for x in numbers], "x bigint")
    assert resample.bracket(rows, "x", wanted) == sorted(numbers.tolist())[wanted - 1]


def test_ranks_over_range_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    got = resample.ranked(rows, [F.col("x")], 7).collect()
    assert all(r["rank"] == r.x + 1 for r in got) and len(got) == 5000
