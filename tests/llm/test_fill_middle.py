"""Fill-in-the-middle against a plain version, and the index of characters of several bytes."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stayline.llm import fill_middle
from stayline.llm.batches import joined

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, " ", "\n\n", "one", " one", "one ", "  a  b  ", "a<P>b", "x <M", "<S", "ends with <P", "é", "中文 字 🙂 é ", "🙂" * 50 + " " + "ß" * 7, " a b"]


def check(df):
    rows = df.select("doc_id", "text").collect()
    key = lambda r: (str(r[0]), str(r[1]))
    wanted = sorted([(r.doc_id, r.text, *plain(r.doc_id, r.text)) for r in rows], key=key)
    full = fill_middle.rebuilt(fill_middle.transformed(df))
    got = sorted([tuple(r) for r in full.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output").collect()], key=key)
    assert got == wanted
    assert full.where(F.col("restored") != F.coalesce("text", F.lit(""))).count() == 0


def test_all_documents(tables):
    check(tables("documents"))


def test_odd_texts(spark, odd_docs, no_docs):
    check(odd_docs)
    check(spark.createDataFrame([(i * 100 + k, t) for i, t in enumerate(ODD) for k in range(25)], "doc_id bigint, text string"))
    assert fill_middle.transformed(no_docs).count() == 0
    out = fill_middle.transformed(odd_docs.withColumn("form", F.lit("mine")).withColumn("key", F.lit("k")).withColumn("row", F.lit("r")))
    assert out.columns[-5:] == ["n", "form", "prefix_chars", "middle_chars", "output"] and {*odd_docs.columns, "key", "row"} <= {*out.columns}
    assert out.where("form = 'mine'").count() == 0 and out.where("key = 'k' and row = 'r'").count() == 10


def test_forms_come_at_their_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words to cut here").alias("text"))
    n = {r.form: r["count"] for r in fill_middle.transformed(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] / 4000 - 0.5) < 0.03 and abs(n["spm"] / (n["spm"] + n["psm"]) - 0.8) < 0.03
    assert fill_middle.transformed(docs, rate=100, spm=0).where("form != 'psm'").count() == 0


def test_places_and_characters_convert_both_ways():
    for text in ODD:
        data, bounds = joined(pa.array([text]))
        raw = (text or "").encode()
        index = fill_middle.Exceptions.of(data)
        assert len(index.lead) == sum(ord(c) > 127 for c in text or "")  # ASCII costs nothing
        places = np.array([len((text or "")[:k].encode()) for k in range(len(text or "") + 1)])
        numbers = np.arange(len(places))
        assert index.chars(places).tolist() == numbers.tolist() and index.bytes(numbers).tolist() == places.tolist()
        ends, first = fill_middle.unit_ends(data, bounds)
        assert [raw[a:b].decode() for a, b in zip([0, *ends], ends)] == UNIT.findall(text or "") and first.tolist() == [0, len(ends)]


def test_a_mark_never_arises_at_a_seam():
    for form in ("psm", "spm"):
        for p, m, s in (("a<P", "S>b", "<"), ("<", "<S", "M>"), ("", "", ""), ("<S", "P>", "<M")):
            parts = [x.encode() for x in (p, m, s)]
            assert fill_middle.restored(form, fill_middle.rearranged(form, *parts)) == (p + m + s).encode()
