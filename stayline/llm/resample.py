"""Importance resampling: documents drawn towards a target text by hashed word features.

A document's features are its words and pairs of neighbouring words, hashed into ``BUCKETS``. The corpus and the target are
counted by bucket, which gives each bucket a gain, the scaled logarithm of how much more often the target has it. A
document's weight is the mean gain of its features; noise of its id's hash (Gumbel) is added, and the highest scores are
drawn, which is sampling without replacement in proportion to the weights.

The gains are one array of ``BUCKETS`` numbers, looked up for all features of many texts at once. The scores are stored.
No sort finds the cut-off: its score is bracketed by exact counts, each pass over the stored numbers narrowing the bracket ``WAYS`` times, and
the ties at that score are cut by doc_id in the same way. Only what is drawn is ranked, by range partitions whose counts
are summed up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm import words
from stayline.llm.batches import joined, pieces
from stayline.session import durable

BUCKETS = 10_000
SCALE = 1000  # gains and noise are whole thousandths
SEED = 7
LEAST_WORDS = 20
PER_CENT = 25
WAYS = 16  # parts of a bracket that one pass counts
LONG = 64  # bytes; longer words are hashed one by one
LAST = 2**63 - 1  # the tie key of a row without id

# ---- features ----------------------------------------------------------------------------------------------


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _table()


def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k of a register, if it is b, leaves after n zero bytes. The rest follows by exclusive or."""
    out = np.zeros((LONG + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, LONG + 1):
        out[n] = _CRC[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


_SHIFT = _shifts()


def shifted(register: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers after ``lengths`` zero bytes each, at most ``LONG``."""
    out = np.zeros(len(register), np.uint32)
    for k in range(4):
        out ^= _SHIFT[lengths, k, (register >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def word_registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The register that each word's normalised bytes leave from an empty one; 0 for words over ``LONG``."""
    normal = words.NORMAL[data]
    out = np.zeros(len(starts), np.uint32)
    live = np.flatnonzero(ends - starts <= LONG)
    at = 0
    while len(live):
        live = live[starts[live] + at < ends[live]]
        byte = normal[starts[live] + at].astype(np.uint32)
        out[live] = _CRC[(out[live] ^ byte) & np.uint32(255)] ^ (out[live] >> np.uint32(8))
        at += 1
    return out


def features(data: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, buckets of all pairs (that of a text's last word is -1), and each text's first word (and of all).

    The hash is the CRC-32 of a feature's bytes. A checksum runs on from word to word, so a pair costs no second reading: what
    stands in the register shifts by the length of what follows, and what follows is added.
    """
    starts, ends = words.word_bounds(data)
    first = np.searchsorted(starts, bounds)
    lengths = ends - starts
    raw = word_registers(data, starts, ends)
    short = np.minimum(lengths, LONG)
    full = np.full(len(raw), 0xFFFFFFFF, np.uint32)
    after = shifted(full, short) ^ raw  # a word from the start register
    one = (after ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    blank = _CRC[(after ^ np.uint32(0x20)) & np.uint32(255)] ^ (after >> np.uint32(8))
    two = np.zeros(len(raw), np.int64)
    if len(raw) > 1:
        two[:-1] = shifted(blank[:-1], short[1:]) ^ raw[1:] ^ np.uint32(0xFFFFFFFF)
    if (lengths > LONG).any():
        normal = words.NORMAL[data].tobytes()
        for i in np.flatnonzero(lengths > LONG).tolist():
            one[i] = zlib.crc32(normal[starts[i] : ends[i]])
            for j in (i - 1, i):
                if 0 <= j < len(raw) - 1:
                    two[j] = zlib.crc32(normal[starts[j] : ends[j]] + b" " + normal[starts[j + 1] : ends[j + 1]])
    one, two = one % buckets, two % buckets
    last = first[1:][np.diff(first) > 0] - 1
    two[last] = -1
    return one, two, first


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of ``texts``, repeats counted; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                one, two, _ = features(*joined(piece.column("text")), buckets)
                counts += np.bincount(one, minlength=buckets) + np.bincount(two[two >= 0], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["bucket", "n"])

    parts = texts.select("text").mapInArrow(run, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain. The two count tables have ``buckets`` rows at most, whatever they were counted from."""
    counts = []
    for table in (corpus, target):
        n = np.zeros(buckets)
        rows = table.collect()
        n[[r.bucket for r in rows]] = [r.n for r in rows]
        counts.append(n)
    s, t = counts
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


# ---- scores ------------------------------------------------------------------------------------------------


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id's hash, in whole thousandths."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(uniform)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                one, two, first = features(*joined(piece.column("text")), len(gain))
                both = np.r_[0, np.cumsum(gain[one] + np.where(two >= 0, gain[two], 0))]
                n_words = np.diff(first)
                n = np.maximum(2 * n_words - 1, 0)
                weight = np.diff(both[first]) // np.maximum(n, 1)
                columns = [piece.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_words, n, weight))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return rows.withColumn("score", F.col("weight") + noise(key, seed))


def bracket(rows: DataFrame, number: str, wanted: int) -> int:
    """The smallest x with at least ``wanted`` rows whose ``number`` is at most x; there are as many rows at least.

    Each pass counts how many rows lie at or below each of ``WAYS`` - 1 places inside the bracket.
    """
    low, high = rows.agg(F.min(number), F.max(number)).first()  # the answer lies in [low, high]
    while low < high:
        places = sorted({low + (high - low) * k // WAYS for k in range(WAYS)})
        counts = rows.agg(*[F.count_if(F.col(number) <= F.lit(x)) for x in places]).first()
        enough = next((k for k, n in enumerate(counts) if n >= wanted), len(places))
        low, high = (places[enough - 1] + 1 if enough else low), (places[enough] if enough < len(places) else high)
    return low


def ranked(rows: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` from 1 in ``order``, by range partitions and the sums of the ones before."""
    spark = rows.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_place", place).join(F.broadcast(offsets), "_part").select(
        *rows.columns, (F.col("_offset") + F.col("_place")).cast("bigint").alias("rank")
    )


def drawn(rows: DataFrame, wanted: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (scored, stored, with a unique ``row``) parted into the ``wanted`` highest scores, with ``rank``, and the rest.

    Ties go to the smaller doc_id (null last), further ones to the smaller ``row``.
    """
    if wanted <= 0:
        return rows.withColumn("rank", F.lit(None).cast("bigint")).limit(0), rows
    keyed = rows.withColumn("_down", -F.col("score")).withColumn("_tie", F.coalesce("doc_id", F.lit(LAST)))
    cut = bracket(keyed, "_down", wanted)
    above, at = F.col("_down") < cut, F.col("_down") == cut
    open_ = wanted - keyed.where(above).count()
    last = bracket(keyed.where(at), "_tie", open_)
    ties = at & (F.col("_tie") == last)
    open_ -= keyed.where(at & (F.col("_tie") < last)).count()
    last_row = bracket(keyed.where(ties), "row", open_)
    taken = above | (at & (F.col("_tie") < last)) | (ties & (F.col("row") <= last_row))
    order = [F.col("_down"), F.col("_tie"), F.col("row")]
    plain = ("_down", "_tie")
    return ranked(keyed.where(taken), order).drop(*plain), keyed.where(~taken).drop(*plain)


def resampled(
    docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``docs``; ``rank`` numbers the drawn, null for all others.

    Of the rows with at least ``least_words`` words the given share with the highest scores is drawn; equal scores go to the
    smaller doc_id, rows without id last. Needs doc_id and text of ``docs`` and text of ``target``; other columns are not
    read. A null or empty text has no features and weight 0. Repeated rows count and are drawn each. Without target
    texts all gains are those of an empty target. An empty table gives no rows.
    """
    corpus = durable(bucket_counts(docs))
    gain = gains(corpus, bucket_counts(target))
    rows = durable(scored(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= least_words
    able = rows.where(enough)
    taken, rest = drawn(able, able.count() * per_cent // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    return taken.select(*columns, "rank").unionByName(rest.unionByName(rows.where(~enough)).select(*columns, none))
