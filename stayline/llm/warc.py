"""WARC archives: writing them with revisit records, and reading them by verified boundaries.

Writing. Every page is one record. Among pages with equal payloads the one with the smallest id is the response;
the others are revisit records that name it and hold no payload. Spark's text writer puts records after one another:
its line separator is the empty lines that end a record.

Reading. Files are split anywhere. The text reader, with the version line as separator, gives every piece between two
occurrences of that magic, and each piece in its split is a candidate record: its offset is the bytes before it, its
successor is the offset plus header, block and end. The magic may also stand inside a payload, even as
a whole forged record, so a candidate counts only if a chain of successors leads to it from the start of
its file. Each task follows the chains inside its split and emits, per candidate, where it leaves the split. Pointer
jumping over those exits (the pointer of the pointer, doubling the reach each round) finds the entry of every split,
and the candidates on the chain from the entry are the records. Pieces in between belong to the payload
of the record before them and are joined to it again. The archives are read once: Spark deals splits out anew at each
read, so the pieces are stored with what was found in them.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayline.session import durable, scratch_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LEAST_BYTES = 0  # smaller payloads are never revisits
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hex digits are four letters of five bits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digest, parts = F.sha1(data), []
    for i in range(0, 40, 5):
        number = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(number, shift).bitwiseAND(31)
            parts.append(F.substring(F.lit(letters), place + 1, F.lit(1)))
    return F.concat(*parts)


# ---- writing -----------------------------------------------------------------------------------


def described(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to); a null html is empty.

    Rows that repeat the smallest id of a payload are all responses. Null ids come after all others; a payload that
    only pages without id hold is a response each time.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    rows = rows.withColumns(
        {"payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": base32_sha1(F.col("html").cast("binary"))}
    )
    # Only payloads that occur under several ids need a lookup. It is stored, so that the join sees two plain
    # tables and can split a payload that a large part of the pages share.
    shared = durable(
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("_first").isNotNull())
        .select("_digest", "_first")
    )
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(shared, rows["payload_digest"] == shared["_digest"], "left").select(
        *rows.columns,
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("_first")).alias("refers_to"),
    )


def record(page: dict[str, Column]) -> Column:
    """One record without the magic's place in the separator and without its end: version line, header, block."""
    plain = F.regexp_replace(page["url"], r"[\x00-\x1F\x7F]", "")  # a header field is one line
    response = page["record_type"] == "response"
    block = F.concat(F.lit(HTTP), F.when(response, page["html"]).otherwise(""))

    def line(name: str, value: Column | str) -> Column:
        value = F.lit(value) if isinstance(value, str) else value.cast("string")
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    header = [
        line("WARC-Type", page["record_type"]),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page["page_id"].cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", DATE),
        line("WARC-Target-URI", plain),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), page["payload_digest"])),
        line("WARC-X-Payload-Length", page["payload_bytes"]),
        line("WARC-Refers-To", F.when(~response, F.concat(F.lit("<urn:page:"), page["refers_to"].cast("string"), F.lit(">")))),
        line("WARC-Profile", F.when(~response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block)),
    ]
    return F.concat(F.lit(MAGIC), *header, F.lit("\r\n"), block)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> None:
    """Writes ``pages`` (page_id, url, html) as uncompressed archives, one per partition."""
    rows = described(pages, least_bytes)
    rows.select(record({c: F.col(c) for c in rows.columns}).alias("value")).write.option("lineSep", END).text(folder)


# ---- reading -----------------------------------------------------------------------------------

ROW_GROUP_BYTES = 16 << 20  # of the stored pieces
_NONE = -1
_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r$")
_FIELD = re.compile(r"(?m)^([A-Za-z0-9-]+):[ \t]*(.*?)[ \t]*\r?$")
#: What a record says and what its payload is.
FIELDS = "type string, id string, uri string, digest string, refers string, said_bytes bigint"
PAYLOAD = "payload_bytes bigint, payload_digest string"


def successor(piece: bytes) -> int:
    """Length of the record that would begin with this piece, magic and end included; -1 if it is no header."""
    stop = piece.find(END.encode())
    found = _LENGTH.search(piece, 0, stop + 2) if stop >= 0 else None
    return len(MAGIC) + stop + len(END) + int(found[1]) + len(END) if found else _NONE


def parsed(record: bytes) -> tuple[tuple, bytes]:
    """``FIELDS`` of a record without magic and end, and its payload: the block behind the HTTP header."""
    header, _, block = record.partition(END.encode())
    said = {k.lower(): v for k, v in _FIELD.findall(header.decode("utf-8", "replace"))}
    _, _, payload = block.partition(END.encode())
    length = said.get("warc-x-payload-length", "")
    return (
        said.get("warc-type"), said.get("warc-record-id"), said.get("warc-target-uri"),
        said.get("warc-payload-digest"), said.get("warc-refers-to"), int(length) if length.isdigit() else None,
    ), payload


def described_payload(payload: bytes) -> tuple[int, str]:
    return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(file, split, value): the text after every occurrence of the magic, in file order within its split."""
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"),
    )


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, int, int]]]]:
    """Each batch with (file, split, number within the split) of its pieces."""
    key, n = None, 0
    for batch in batches:
        places = []
        for here in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), strict=True):
            n = n + 1 if here == key else 0
            key = here
            places.append((*here, n))
        yield batch, places


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Two rows per piece: one with what was found in it, and one with (file, split, n) and its ``value`` alone. All places
    count from the start of the split's first piece.

    ``n`` numbers the pieces of a split. ``at`` is the place of the magic, ``next`` that of the successor (-1: no
    header), ``leaves`` the first successor beyond the split that the chain from here reaches (-1: it breaks off inside),
    ``bytes`` the piece's length with its magic. The first piece of a file is what precedes the first magic: nothing, in a
    proper archive. ``FIELDS`` come from the header, ``PAYLOAD`` from a block that ends within the piece.
    """
    places = "file string, split bigint, n bigint, at bigint, next bigint, leaves bigint, bytes bigint"
    schema = f"{places}, {FIELDS}, {PAYLOAD}, value binary"

    def table(key: tuple[str, int], found: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([f[0] for f in found], np.int64)
        spans = np.array([f[1] for f in found], np.int64)
        at = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        follow = np.where(spans < 0, _NONE, at + spans)
        total, place = int(sizes.sum()), {int(a): i for i, a in enumerate(at)}
        leaves = follow.copy()
        for i in range(len(at) - 1, -1, -1):  # successors lie behind, so theirs is known already
            if 0 <= leaves[i] < total:
                j = place.get(int(leaves[i]))
                leaves[i] = _NONE if j is None else leaves[j]
        if key[1] == 0:
            at[0] = _NONE  # what precedes the first magic stands at no record's place
        rows = [(*key, i, *map(int, x), *f[2]) for i, (f, *x) in enumerate(zip(found, at, follow, leaves, sizes, strict=True))]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), pa.nulls(len(rows), pa.binary())],
            names=names,
        )

    def stored(batch: pa.RecordBatch, places: list[tuple[str, int, int]]) -> pa.RecordBatch:
        keys = list(zip(*places, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array(c, t) for c, t in zip(keys, kinds, strict=False)),
                *(pa.nulls(len(places), t) for t in kinds[3:]), batch.column("value"),
            ],
            names=names,
        )

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")[:-1]]
    nothing = (None,) * (len(kinds) - 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = None, []
        for batch, places in numbered(batches):
            yield stored(batch, places)
            for (file, split, n), value in zip(places, batch.column("value"), strict=True):
                raw = value.as_py()
                if (file, split) != key:
                    if found:
                        yield table(key, found)
                    key, found = (file, split), []
                if split == 0 and n == 0:  # no magic before it
                    found.append((len(raw), _NONE, nothing))
                    continue
                span, size = successor(raw), len(raw) + len(MAGIC)
                if span < 0:
                    said = nothing
                else:
                    said, payload = parsed(raw[: span - len(MAGIC) - len(END)])
                    said += described_payload(payload) if span <= size else (None, None)
                found.append((size, span, said))
        if found:
            yield table(key, found)

    return pieces(spark, folder).mapInArrow(run, schema)


def reachable(found: DataFrame) -> DataFrame:
    """(file, split, at, offset, size) of the candidates that a chain from their file's start reaches; ``offset`` counts
    from the start of the file."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = durable(
        found.groupBy("file", "split").agg(F.sum("bytes").alias("_n")).select(
            "file", "split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base")
        )
    )
    placed = found.where(F.col("next") >= 0).select("file", "split", "at", "next", "leaves").join(splits, ["file", "split"])
    placed = placed.select(
        "file", "split", "at", "next", "base", (F.col("base") + F.col("at")).alias("offset"),
        F.when(F.col("leaves") >= 0, F.col("base") + F.col("leaves")).alias("jump"),
    )
    # Only a file's start and places that some split's chains leave for can be entries; those are few per split.
    doors = placed.where(F.col("jump").isNotNull()).select("file", F.col("jump").alias("offset")).distinct()
    starts = placed.where(F.col("offset") == 0).select("file", "offset").distinct()
    step = durable(
        placed.join(doors.unionByName(starts).distinct(), ["file", "offset"]).select("file", "offset", "jump")
    )
    most = splits.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    entries = step.where(F.col("offset") == 0).select("file", "offset")
    for _ in range(math.ceil(math.log2(most + 1))):
        onward = entries.join(step, ["file", "offset"]).where(F.col("jump").isNotNull())
        entries = durable(entries.unionByName(onward.select("file", F.col("jump").alias("offset"))).distinct())
        second = step.select("file", F.col("offset").alias("jump"), F.col("jump").alias("_to"))
        step = durable(step.join(second, ["file", "jump"]).select("file", "offset", F.col("_to").alias("jump")))
    marked = placed.join(entries.withColumn("is_entry", F.lit(True)), ["file", "offset"], "left").select(
        "file", "split", "at", "next", "base", F.coalesce("is_entry", F.lit(False)).alias("is_entry")
    )

    def follow(group: pa.Table) -> pa.Table:
        """Follows the chain from the split's entry. A split's candidates are a bounded group of offsets."""
        at, nxt = group.column("at").to_numpy(), group.column("next").to_numpy()
        base, place, kept = group.column("base").to_numpy(), {int(a): i for i, a in enumerate(at)}, []
        for i in np.flatnonzero(group.column("is_entry").to_numpy(zero_copy_only=False)):
            while i is not None:
                kept.append(int(i))
                i = place.get(int(nxt[i]))
        rows = group.select(["file", "split", "at"]).take(pa.array(kept, pa.int64()))
        return rows.append_column("offset", pa.array((at + base)[kept], pa.int64())).append_column(
            "size", pa.array((nxt - at)[kept], pa.int64())
        )

    return marked.groupBy("file", "split").applyInArrow(
        follow, "file string, split bigint, at bigint, offset bigint, size bigint"
    )


def continued(values: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """(file, offset, record binary) of the records whose block holds the magic, put together from their pieces, the
    (file, split, n, value) of the same read as ``found``.

    Only those pieces take part; they follow one another. Their list is stored; if it is small it is broadcast by its size, and no
    payload is shuffled.
    """
    marks = found.select("file", "split", "n", "at", "next", "bytes").join(
        records.withColumnRenamed("size", "_size"), ["file", "split", "at"], "left"
    ).where((F.col("next") < 0) | F.col("offset").isNull() | (F.col("_size") > F.col("bytes")))
    order = Window.partitionBy("file").orderBy("split", "n")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file", "offset").orderBy("split", "n").rowsBetween(Window.unboundedPreceding, -1)
    parts = durable(
        marks.withColumn("offset", F.last("offset", ignorenulls=True).over(upto))
        .withColumn("size", F.last("_size", ignorenulls=True).over(upto))
        .where(F.col("offset").isNotNull())
        .withColumn("_before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        .where(F.col("_before") < F.col("size"))  # what follows a chain that broke off is in no record
        .select("file", "split", "n", "offset", "size")
    )

    both = F.expr(f"aggregate(slice(p, 2, size(p)), p[0], (a, b) -> concat(a, X'{MAGIC.encode().hex()}', b))")
    return (
        values.join(parts, ["file", "split", "n"])
        .groupBy("file", "offset", "size")
        .agg(F.array_sort(F.collect_list(F.struct("split", "n", "value"))).alias("p"))
        .select("file", "offset", "size", F.transform("p", lambda x: x["value"]).alias("p"))
        .select("file", "offset", "size", both.alias("whole"))
        .where(F.octet_length("whole") + len(MAGIC) >= F.col("size") - len(END))
        .select("file", "offset", F.substring("whole", 1, (F.col("size") - len(MAGIC) - len(END)).cast("int")).alias("record"))
    )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, FIELDS, PAYLOAD): every record that boundary chains verify, with length and digest of its payload.

    A chain that breaks off (a truncated file) gives the complete records before the break. A record of another
    writer may lack fields; they are null. An empty file gives none, and so does one that does not begin with a record.
    """
    stored = durable(candidates(spark, folder), compression="zstd", **{"parquet.block.size": str(ROW_GROUP_BYTES)})
    found = stored.where(F.col("bytes").isNotNull()).drop("value")
    values = stored.where(F.col("bytes").isNull()).select("file", "split", "n", "value")
    records = durable(reachable(found))
    names = [c.split()[0] for c in f"{FIELDS}, {PAYLOAD}".split(", ")]
    alone = found.join(records, ["file", "split", "at"]).where(F.col("size") <= F.col("bytes")).select("file", "offset", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record in batch.column("record"):
                said, payload = parsed(record.as_py())
                rows.append(said + described_payload(payload))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.int64() if c.endswith("_bytes") else pa.string() for c in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("offset"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["file", "offset", *names],
            )

    joined = continued(values, found, records).mapInArrow(run, f"file string, offset bigint, {FIELDS}, {PAYLOAD}")
    return alone.unionByName(joined)


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, checked) of archives that ``write_archives`` wrote.

    Of a response, length and digest are those of the payload read; of a revisit, what its header says of the payload.
    ``checked`` tells whether a response's header agrees with its payload (null for revisits).
    """

    def number(name: str) -> Column:
        return F.regexp_extract(F.coalesce(F.col(name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")

    full = F.col("type") == "response"
    said = F.regexp_replace("digest", "^sha1:", "")
    return read_archives(spark, folder).select(
        number("id").alias("page_id"),
        F.when(full, F.col("payload_bytes")).otherwise(F.col("said_bytes")).alias("payload_bytes"),
        F.when(full, F.col("payload_digest")).otherwise(said).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers").alias("refers_to"),
        F.when(full, (F.col("payload_digest") == said) & (F.col("payload_bytes") == F.col("said_bytes"))).alias("checked"),
    )


def archive_digest(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and returns what ``page_records`` reads back from them."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return page_records(pages.sparkSession, folder)
