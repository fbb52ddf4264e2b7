import corpus_pipeline
from pyspark.sql import functions as F

from stayline.llm import decontaminate, language, mixing
from test_texts import classes, hits
from test_tokens import brute, crc


def test_stages_have_their_order_and_return_documents(spark, data, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "token_ids"]
    docs = tables("documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).dtypes == docs.dtypes


def test_run_against_brute_force(spark, data, tables):
    docs = [tuple(r) for r in tables("documents").select("doc_id", "text", "source").collect()]
    learned = language.learn(tables("documents").where(~language.held_out(F.col("doc_id"))))
    machines = learned.compressors()

    def clear(text):
        plain = language.normal(text or "")
        if not plain:
            return False
        parts = [part + language._PADDING for part in language.blocks(plain.encode())]
        best, second = sorted(sum(len(m.compress(part)) for part in parts) for _, m in machines)[:2]
        return (second - best) / second >= language.MIN_MARGIN

    docs = [d for d in docs if clear(d[1])]
    group = classes([(d, t) for d, t, _ in docs])
    docs = [d for d in docs if group.get(d[0], d[0]) == d[0]]
    items = [(r.item_id, r.text) for r in tables("benchmark").collect()]

    def clean(text):
        n, hit, _ = hits(text, items)
        return not (hit and 20 * hit >= n)

    docs = [d for d in docs if clean(d[1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    repeats = {r.doc_id: r.repeats for r in mixing.mixed(frame).select("doc_id", "repeats").collect()}
    rows = sorted((d, t) for d, t, _ in docs for _ in range(repeats[d]))
    expected, start = [], 0
    for d, ids in brute(rows, 2):
        expected.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    found = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, data).collect()]
    assert sorted(found, key=lambda r: r[1]) == expected


def test_contaminated_and_copied_documents_go_and_clean_ones_stay(spark, data, tables):
    docs, bench = tables("documents"), tables("benchmark")
    kept = corpus_pipeline.decontaminate_stage(spark, docs, data)
    judged = decontaminate.scanned(docs, bench)
    assert kept.count() == judged.where("not contaminated").count() < docs.count()
    once = corpus_pipeline.dedup_stage(spark, docs, data)
    assert once.count() == once.select("text").distinct().count()


def test_stages_take_odd_documents_and_empty_tables(spark, data, odd_docs, no_docs):
    """Per stage: which of the odd documents it keeps. Null and empty texts have no language; equal rows are one after dedup."""
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, data).count() == 0
        out = stage(spark, odd_docs, data)
        if name != "token_ids":
            assert out.columns == odd_docs.columns
        kept[name] = sorted((r.doc_id for r in out.collect()), key=lambda d: (d is None, d))
    assert not {2, 3, 4} & {*kept["language"]} and {1, 5} <= {*kept["language"]}
    assert kept["near_dedup"] == [1, 2, 3, 4, 5, 6, 7, 8, None]
    assert kept["decontaminate"] == [1, 1, 2, 3, 4, 5, 6, 7, 8, None]
    repeats = {r.doc_id: r.repeats for r in mixing.mixed(plain).collect()}
    rows = [r.doc_id for r in plain.collect()]
    assert kept["mix"] == sorted((d for d in rows for _ in range(repeats[d])), key=lambda d: (d is None, d))
    assert kept["token_ids"] == sorted(rows, key=lambda d: (d is None, d))


def test_a_run_of_odd_documents(spark, tmp_path, odd_docs, tables):
    """All stages one after the other, on rows with nulls, repeated rows and empty texts, and on no rows at all."""
    for name, docs in (("odd", odd_docs.select("doc_id", "text", "lang", "source", "n_chars")), ("none", odd_docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars"))):
        folder = f"{tmp_path}/{name}"
        docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        tables("benchmark").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        assert (len(found) > 0) == (name == "odd") and all(r.n_tokens >= 1 for r in found)
        starts = sorted((r.start, r.n_tokens) for r in found)
        assert [a for a, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
