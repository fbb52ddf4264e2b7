import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayline.llm import flat_tokens, token_files
from stayline.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows, end, special_as_text=False):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = special_as_text
    return [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]) for d, t in rows]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def check_files(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected, start = [], 0
    for doc, ids in brute(rows, token_files.END_ID):
        expected.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    found = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digest(docs).collect()]
    assert sorted(found, key=lambda r: r[1]) == expected


def test_every_document_like_the_whole_text(tables):
    check_files(tables("documents"))


def test_odd_documents(odd_docs, no_docs):
    check_files(odd_docs)
    assert token_files.token_digest(no_docs).count() == 0


def test_words_give_the_ids_of_whole_texts():
    texts = ["", " ", "a  b\n\nc", "é ́x", "don't  we'll", "Σας ΣΑΣ. ΑΣ", "<|endoftext|> x<|endoftext|>", "a\tb c d\r\ne",
             "İstanbul İ", "###word.### 123 4", "\x00 \x1f"]
    words = token_files.WordTokenizer(PATH, False)
    ids, at = words.encode(texts, 7)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [i for _, i in brute([(0, t) for t in texts], 7)]


def test_parts_are_those_of_the_pattern():
    pattern = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
    draw = random.Random(4)
    texts = ["".join(draw.choices("'stremvlda  1²ß×!", k=draw.randrange(40))) for _ in range(2000)]
    texts += ["".join(chr(draw.randrange(32, 256)) for _ in range(200)).lower() for _ in range(50)]
    for text in [*texts, "", " ", "'", "'s", "x'", "''s", "'s's", "'re'v", "'l"]:
        data = text.encode("latin-1")
        begins, inside = token_files.part_bounds(np.frombuffer(data, np.uint8))
        ends = np.r_[begins[1:], len(data)].tolist()
        assert [data[a:b].decode("latin-1").rstrip(" ") for a, b in zip(begins.tolist(), ends)] == pattern.findall(text)
        assert bytes(data[i] for i in np.flatnonzero(inside)).decode("latin-1") == text.replace(" ", "")


def test_a_part_is_looked_up_once_for_all_texts_encoded_together():
    class Counting(dict):
        asked = 0

    def counted(name):
        def method(self, *args):
            Counting.asked += 1
            return getattr(dict, name)(self, *args)

        return method

    for name in ("get", "__getitem__", "__contains__"):
        setattr(Counting, name, counted(name))
    words = token_files.WordTokenizer(PATH, False)
    words.numbers = Counting()
    texts = ["the same words again, " * 500, None, "the same\nwords " * 500, "Ŝi the same " * 3]
    ids, at = words.encode(texts, 7)
    assert Counting.asked == 5 + 3  # the, same, words, again, comma; three words of the text that is not Latin-1
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [i for _, i in brute(enumerate(texts), 7)]


@pytest.mark.parametrize("texts", [[], [None], ["Ŝ"], ["Ŝ", None, "a", " ", "Ŝ a"], ["\n"]])
def test_plain_and_other_texts_keep_their_places(texts):
    ids, at = token_files.WordTokenizer(PATH, False).encode(texts, 7)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [i for _, i in brute(enumerate(texts), 7)]


def test_files_have_small_row_groups_indexes_and_encodings(spark, tables):
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(tables("documents"), folder)
    plan = token_files.read_tokens(spark, folder).select("doc_id", "n_tokens").where("doc_id = 5")
    text = plan._jdf.queryExecution().toString()
    assert "ids" not in text.split("ReadSchema")[-1] and "EqualTo(doc_id,5)" in text
    files = spark.read.parquet(folder).inputFiles()
    for name in files:
        with open(name.removeprefix("file://"), "rb") as f:
            meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("ids"):
                    assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings)


@pytest.mark.parametrize("block", [8, 64, 1 << 20])
def test_separator_scan_over_any_blocks(spark, tables, block):
    docs = tables("documents").where("doc_id < 20").select("doc_id", F.substring("text", 1, 200).alias("text"))
    folder = scratch_path(spark, "flat")
    flat_tokens.write_flat(docs, folder)
    counts = flat_tokens.token_counts(spark, folder, block_bytes=block)
    found = counts.join(flat_tokens.document_ids(spark, folder), ["file", "doc_no"])
    expected = {d: len(i) for d, i in brute([(r.doc_id, r.text) for r in docs.collect()], flat_tokens.END_ID, True)}
    assert {r.doc_id: r.n_tokens for r in found.collect()} == expected
    assert counts.where("not complete").count() == 0


def test_counts_of_all_documents(tables, odd_docs, no_docs):
    for docs in (tables("documents"), odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        expected = sorted((-1 if d is None else d, len(i)) for d, i in brute(rows, flat_tokens.END_ID, True))
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in flat_tokens.counted(docs).collect()) == expected
    assert flat_tokens.counted(no_docs).count() == 0


def test_file_without_end_id_has_an_incomplete_document(spark, tmp_path):
    (tmp_path / "a.tokens").write_bytes(struct.pack("<7H", 1, 2, 49407, 49407, 5, 6, 7))
    (tmp_path / "b.tokens").write_bytes(b"")
    found = flat_tokens.token_counts(spark, f"file://{tmp_path}", block_bytes=8).orderBy("start").collect()
    assert [(r.file, r.doc_no, r.start, r.n_tokens, r.complete) for r in found] == [
        ("a", 0, 0, 3, True), ("a", 1, 3, 1, True), ("a", 2, 4, 3, False)
    ]


def test_a_job_touches_only_its_own_files(spark, tables, tmp_path):
    folder = f"file://{tmp_path}/flat"
    docs = tables("documents").where("doc_id < 30")
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "notes.txt").write_text("mine")
    (tmp_path / "flat" / "old.tokens").write_bytes(struct.pack("<2H", 5, flat_tokens.END_ID))
    flat_tokens.write_flat(docs.where("doc_id < 10"), folder)
    flat_tokens.write_flat(docs.where("doc_id >= 10"), folder)  # a second append
    assert (tmp_path / "flat" / "notes.txt").read_text() == "mine"
    counts = flat_tokens.token_counts(spark, folder)
    assert counts.where("file = 'old'").count() == 1 and counts.count() == docs.count() + 1
    ids = flat_tokens.document_ids(spark, folder)
    assert {r.doc_id for r in ids.collect()} == {r.doc_id for r in docs.collect()}


def test_a_failed_job_leaves_earlier_files_alone(spark, tables, tmp_path):
    folder = f"file://{tmp_path}/flat"
    docs = tables("documents").where("doc_id < 30").select("doc_id", "text")
    flat_tokens.write_flat(docs, folder)
    before = sorted(p.name for p in (tmp_path / "flat").iterdir())
    broken = docs.repartition(3).withColumn("text", F.when(F.col("doc_id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        flat_tokens.write_flat(broken, folder)
    assert sorted(p.name for p in (tmp_path / "flat").iterdir()) == before
    assert flat_tokens.token_counts(spark, folder).count() == docs.count()


def test_files_of_an_attempt_that_did_not_count_are_not_read(tmp_path):
    folder = tmp_path / "flat"
    folder.mkdir()
    options = {"path": f"file://{folder}", "width": "u2", "end_id": "9"}
    writer, other = flat_tokens.TokenWriter(options), flat_tokens.TokenWriter(options)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[3, 9]], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    kept, lost, later = writer.write(iter([batch])), writer.write(iter([batch])), other.write(iter([batch]))
    files, base = flat_tokens.store(options["path"])
    assert flat_tokens.listed(files, base) == []  # nothing counts before a job's end
    writer.commit([kept, None])
    assert {f.base_name for f in flat_tokens.listed(files, base)} == set(kept.names)
    assert not any((folder / n).exists() for n in lost.names) and all((folder / n).exists() for n in later.names)
    other.abort([later])
    assert not any((folder / n).exists() for n in later.names) and all((folder / n).exists() for n in kept.names)
