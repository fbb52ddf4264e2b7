import base64
import hashlib

import pytest

from stayline.llm import warc
from stayline.session import scratch_path

FORGED = (
    "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
)


def expected(rows):
    payloads = {p: (h or "").encode() for p, _, h in rows}
    first = {}
    for p in sorted(payloads):
        first.setdefault(payloads[p], p)
    return sorted(
        (p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == p else "revisit",
         None if first[b] == p else first[b])
        for p, b in payloads.items()
    )


def found(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.mark.parametrize("split", ["2000", "100000", "128m"])
def test_forged_records_inside_payloads_are_rejected(spark, split):
    rows = [
        (i, f"http://x/{i}", ("x" * (i * 37 % 3000)) + FORGED * (i % 4) + "é" * (i % 7) + ("WARC/1.1\r\n" if i % 5 == 0 else "")
         if i % 11 else None)
        for i in range(300)
    ]
    rows += [(500, "u", "same"), (501, None, "same"), (502, "line\r\nbreak: x", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        records = warc.archive_digest(pages)
        assert found(records) == expected(rows)
        assert {r.checked for r in records.collect() if r.record_type == "response"} == {True}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_record_far_longer_than_a_split(spark):
    rows = [(1, "u", "start"), (2, "u", (FORGED + "y" * 500) * 400), (3, "u", "end")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        assert found(warc.archive_digest(pages)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_splits_that_change_between_reading_and_collecting(spark):
    rows = [(i, "u", "x" * (i * 97 % 3000) + FORGED * (i % 5) + "y" * (i * 31 % 900)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        records = warc.archive_digest(pages)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        assert found(records) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_table_and_repeated_rows(spark):
    schema = "page_id bigint, url string, html string, payload_bytes string"
    assert warc.archive_digest(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", "a", "z"), (1, "u", "a", "z"), (2, "u", "a", None), (None, "u", "a", "z")]
    kinds = sorted((r.page_id is None, r.page_id, r.record_type, r.refers_to)
                   for r in warc.archive_digest(spark.createDataFrame(rows, schema)).collect())
    assert kinds == [(False, 1, "response", None), (False, 1, "response", None), (False, 2, "revisit", 1), (True, None, "revisit", 1)]


def test_truncated_file_keeps_the_records_before_the_break(spark):
    folder = scratch_path(spark, "cut")
    body = "".join(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
                   for i in range(3))
    spark.createDataFrame([(body[:-12],)], "value string").coalesce(1).write.option("lineSep", "\n").text(folder)
    assert sorted(r.id for r in warc.read_archives(spark, folder).collect()) == ["<urn:page:0>", "<urn:page:1>"]


def test_garbage_before_the_first_record_gives_nothing(spark):
    folder = scratch_path(spark, "bad")
    spark.createDataFrame([("junk" + FORGED,)], "value string").coalesce(1).write.text(folder)
    assert warc.read_archives(spark, folder).count() == 0
