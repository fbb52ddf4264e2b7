"""Jaccard join of documents by word n-grams, with a token-group matrix.

A document's set holds the hashes of its runs of ``SHINGLE`` words, each once. Equal sets are one from the start. Two sets
similar enough miss few of each other's tokens, so of the first of each, in any fixed order of the tokens, some are
the same. In the order of the hashes that leaves out at once most sets, those whose smallest tokens no others share often
enough; in the order of rarity it gives each of the rest its buckets. Every bucket's members are first compared with one leader, the member that shares most, which
connects most copies of a text. What is still apart is grouped, and groups are bounded against the matrix of token
unions and opened (see ``groups``). Components of the links are exact: no two sets that are linked end up apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm import groups, words
from stayline.llm.batches import joined, list_array, pieces
from stayline.llm.near_dedup import components, same_document
from stayline.session import durable

SHINGLE = 3
UP, DOWN = 90, 100  # linked if DOWN * intersection >= UP * union
CUT = 16  # last bits of a token that outlines leave out
KEY_BITS = 48  # of a token that buckets look at; the other bits of its number hold how many sets have it
SORTED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}  # sorted numbers are stored by their differences
MAP_BITS = 1 << 26  # of the bitmap of wanted ids at most: 8 MB
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as sorted signed hashes, and where each text's begin (and the end of all).

    Words are parted by blanks, A-Z lower-cased. A text of fewer words, but not none, is one shingle.
    """
    first, last = words.word_bounds(data, words.NOT_BLANK)
    hashes = words.word_hashes(data, first, last, words.LOWER)
    at = np.searchsorted(first, bounds)
    sizes = np.diff(at)
    counts = np.where(sizes > 0, np.maximum(sizes - shingle + 1, 1), 0)
    offsets = np.r_[0, np.cumsum(counts)]
    text = np.repeat(np.arange(len(sizes)), counts)
    start = at[:-1][text] + np.arange(offsets[-1]) - offsets[:-1][text]
    width = np.minimum(sizes, shingle)[text]
    out = width.astype(np.uint64)
    for k in range(shingle):
        part = hashes[np.minimum(start + k, max(len(hashes) - 1, 0))] if len(hashes) else out
        out = np.where(k < width, words.mix(out * _GOLD + part), out)
    keys = out.view(np.int64)
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])][: len(keys)]
    return keys[new], np.r_[0, np.cumsum(np.bincount(text[new], minlength=len(sizes)))]


def missing(size, up: int = UP, down: int = DOWN):
    """Of a set's tokens, how many a linked one can lack: the overlap is up / down of the set at least. Arrays or columns."""
    if isinstance(size, Column):
        return F.call_function("div", size * (down - up), F.lit(down))
    return size * (down - up) // down


def outlines(docs: DataFrame, up: int = UP, down: int = DOWN) -> DataFrame:
    """(doc_id, n_shingles, raw, text_key, prefix): a hash of the text, a digest of the set, null if empty, and its smallest tokens.

    With m = ``missing``, any two linked sets share one token at least of their m + 1 smallest, and generally k of their
    m + k smallest. ``prefix`` has 2 m + 1: k = m + 1 of them at least are shared with a linked set of the same size. It holds the
    tokens' first bits, as a token that is shared has these in common, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                keys, at = shingle_sets(*joined(piece.column("text")))
                n = np.diff(at)
                digests = [hashlib.md5(keys[a:b].tobytes()).hexdigest() if a < b else None for a, b in zip(at[:-1], at[1:], strict=True)]
                wanted = np.minimum(2 * missing(n, up, down) + 1, n)
                ends = np.r_[0, np.cumsum(wanted)]
                chosen = keys[np.repeat(at[:-1] - ends[:-1], wanted) + np.arange(ends[-1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array(n, pa.int64()), piece.column("raw"), pa.array(digests, pa.string()),
                        list_array(chosen >> CUT, ends, pa.int64()),
                    ],
                    names=["doc_id", "n_shingles", "raw", "text_key", "prefix"],
                )

    schema = "doc_id bigint, n_shingles bigint, raw bigint, text_key string, prefix array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("raw"), "text").mapInArrow(run, schema)


def possible(sets: DataFrame, up: int = UP, down: int = DOWN) -> DataFrame:
    """(id) of ``sets`` (id, n, prefix) that share enough of their smallest tokens with others to have a link at all."""
    spread = sets.select("id", "n", F.explode("prefix").alias("token"))
    several = spread.groupBy("token").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = spread.join(durable(several.select("token")), "token").groupBy("id", "n").agg(F.count("*").alias("_shared"))
    # A linked set has at least `least` tokens, and so k = missing(least) + 1 smallest ones in common with this one.
    least = F.call_function("div", F.col("n") * up + F.lit(down - 1), F.lit(down))
    return durable(shared.where(F.col("_shared") > missing(least, up, down)).select("id"))


def buckets(sets: DataFrame, up: int = UP, down: int = DOWN) -> DataFrame:
    """(bucket, id, share) of ``sets`` (id, size, tokens): a set's rarest tokens, those that others have among theirs, too.

    Two linked sets share one at least of the m + 1 tokens (m = ``missing``) that the fewest sets have. Tokens that no other
    set has come first and leave fewer places for the rest; a set with more than m of them has no link. ``share`` is how
    much of a set others have, by the thousand. Passages that many texts repeat are among the rarest tokens of none
    but the texts that hold little else.

    Of a token only the last bits travel, and after the count one number of them and of how many have it (up to a bound). In the
    order of these numbers the bound m + 1 holds as well: before the first that two linked sets have in common stand only
    tokens that the other lacks. Tokens of the same bits count as one and share a bucket.
    """
    last = F.lit((1 << KEY_BITS) - 1)
    one = sets.select("id", "size", F.explode("tokens").alias("token")).withColumn("token", F.col("token").bitwiseAND(last))
    counts = durable(one.groupBy("token").agg(F.count("*").alias("_n")).where("_n > 1"))
    key = F.shiftleft(F.least("_n", F.lit((1 << 63 - KEY_BITS) - 1)), KEY_BITS).bitwiseOR(F.col("token"))
    known = one.join(counts, "token").groupBy("id", "size").agg(F.array_sort(F.collect_list(key)).alias("_known"))
    places = missing(F.col("size"), up, down) + 1 - (F.col("size") - F.size("_known"))
    share = (F.size("_known") * 1000 / F.col("size")).cast("int")
    rarest = known.where(places > 0).select("id", share.alias("share"), F.explode(F.slice("_known", F.lit(1), places.cast("int"))).alias("_key"))
    spread = durable(rarest.select(F.col("_key").bitwiseAND(last).alias("bucket"), "id", "share"))
    several = spread.groupBy("bucket").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).where("_low != _high")
    return durable(spread.join(durable(several.select("bucket")), "bucket"))


def rows_with(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs`` whose doc_id may be among those of ``wanted``, and few others: a bitmap of hashed ids is held against the
    rows where they lie. It grows with ``wanted`` up to ``MAP_BITS``; with still more ids more others are left."""
    bits = min(MAP_BITS, 1 << (16 * wanted.count()).bit_length())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    bucket, bit = F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place)
    marks = wanted.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("_marks"))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").withColumns({"_bucket": bucket, "_bit": bit})
    byte = F.conv(F.hex(F.substring("_marks", F.expr("int(_bit div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    marked = F.call_function("getbit", byte, F.expr("int(_bit % 8)")) == 1
    return rows.join(F.broadcast(marks), "_bucket").where(marked).select("doc_id", "text")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, size, tokens) of the sets ``wanted`` (id, doc_id, raw): from a row of that doc_id whose text has that hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                keys, at = shingle_sets(*joined(piece.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(np.diff(at), pa.int64()), list_array(keys, at, pa.int64())], names=["id", "size", "tokens"]
                )

    rows = rows_with(docs, wanted).join(wanted, "doc_id").where(F.xxhash64("text") == F.col("raw"))
    # Both keys, so that the rows stay where the join has put them.
    each = rows.dropDuplicates(["doc_id", "id"]).select("id", "text")
    return each.mapInArrow(run, "id bigint, size bigint, tokens array<bigint>")


def leader_links(members: DataFrame, sets: DataFrame, up: int = UP, down: int = DOWN) -> DataFrame:
    """Links (a, b), a > b, of each bucket's members with its leader, the member with the largest ``share``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                a, b = (groups.flat(batch.column(c), i) for c in ("tokens_a", "tokens_b"))
                both = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(down * both >= up * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    leaders = members.groupBy("bucket").agg(F.max(F.struct("share", (-F.col("id")).alias("_to"))).alias("_l"))
    to = -F.col("_l._to")
    pairs = members.join(durable(leaders), "bucket").where(F.col("id") != to).select(F.greatest("id", to).alias("a"), F.least("id", to).alias("b"))
    left = sets.select(F.col("id").alias("a"), F.col("size").alias("_sa"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("id").alias("b"), F.col("size").alias("_sb"), F.col("tokens").alias("tokens_b"))
    fits = F.least("_sa", "_sb") * down >= F.greatest("_sa", "_sb") * up
    both = durable(pairs.distinct()).join(left, "a").join(right, "b").where(fits)
    return both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a bigint, b bigint")


def joined_sets(docs: DataFrame, up: int = UP, down: int = DOWN) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``: the size of its set, and the smallest doc_id reachable by links.

    Two sets are linked if their Jaccard similarity is at least ``up`` / ``down``, decided in whole numbers. Only doc_id
    and text are read. A null or empty text, and one of blanks alone, has an empty set and is linked with nothing; a row
    without id has a size and a null component and links nothing. Rows that repeat an id are one document: their sets
    are linked. An empty table gives no rows.
    """
    rows = durable(outlines(docs, up, down), **SORTED)
    full = rows.where("text_key is not null and doc_id is not null")
    # A set's own number is made of its digest, as an id may have several sets.
    number = F.conv(F.substring("text_key", 1, 15), 16, 10).cast("bigint")
    sets = durable(
        full.groupBy("text_key")
        .agg(F.min(F.struct("doc_id", "raw")).alias("_row"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"))
        .select(number.alias("id"), "_row.*", "n", "prefix"),
        **SORTED,
    )
    wanted = durable(possible(sets, up, down).join(sets.select("id", "doc_id", "raw"), "id"))
    tokens = durable(whole_sets(docs, wanted))
    members = buckets(tokens, up, down)
    links = durable(leader_links(members, tokens, up, down))
    more = groups.links_between(members.select("bucket", "id"), tokens, components(links), up, down)
    classes = components(links.unionByName(more).unionByName(same_document(full.select("doc_id", number.alias("id")))))
    node = full.select("doc_id", "n_shingles", number.alias("id"))
    of = durable(node.join(classes, "id", "left").select("doc_id", "n_shingles", F.coalesce("class", "id").alias("class")))
    lowest = durable(of.groupBy("class").agg(F.min("doc_id").alias("component_id")))
    linked = of.join(lowest, "class").select("doc_id", "n_shingles", "component_id")
    rest = rows.where("text_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest)
