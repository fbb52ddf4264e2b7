"""Near duplicates by DartMinHash over weighted word shingles.

A document's elements are its runs of ``SHINGLE`` words, weighted by how often they occur. An element of weight w is a
region: w unit strips beside one another, each open towards higher ranks. Darts fall into a strip as a random stream
that depends on element and strip alone: ever later ranks, each with a coordinate. Documents that share a strip
share its darts. A signature keeps for each of its coordinates the earliest dart, and two documents agree in a
coordinate with a chance equal to their weighted Jaccard similarity. Only darts up to a rank that fills all coordinates
are thrown, a number set by the signature's length and not by the document's; a document with a coordinate
left empty throws twice as deep.

Texts that are equal are one class from the start. Bands of coordinates give buckets; documents of a bucket are candidates
and are linked if their exact similarity is at least ``SIMILARITY``. Classes are the connected components of the links.
All members of a bucket are compared with two leaders first, its smallest and its largest number, which connects most copies of
one text; numbers are random, and buckets of the same documents mostly have the same two leaders, so pairs repeat and are few. The
members of buckets that then still hold several classes meet group by group (see ``groups``): no size of a bucket
changes what is compared, and no pair of documents becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm import groups, words
from stayline.llm.batches import joined, list_array, pieces
from stayline.session import durable

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4  # of 128 coordinates; a pair at 0.8 shares no band with a chance of 5e-8
TEXTS = 512  # whose darts are thrown together: about 1,000 a text, whatever its length
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# ---- elements and signatures -----------------------------------------------------------------------


def strips(data: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all unit strips, grouped by text, and each text's first (and the end of all).

    The i-th occurrence of a shingle is strip i of its element. A text of fewer words, but not none, is one shingle.
    """
    first, last = words.word_bounds(data)
    hashes = words.word_hashes(data, first, last)
    at = np.searchsorted(first, bounds)
    sizes = np.diff(at)
    counts = np.where(sizes > 0, np.maximum(sizes - shingle + 1, 1), 0)
    offsets = np.r_[0, np.cumsum(counts)]
    text = np.repeat(np.arange(len(sizes)), counts)
    start = at[:-1][text] + np.arange(offsets[-1]) - offsets[:-1][text]
    width = np.minimum(sizes, shingle)[text]
    out = width.astype(np.uint64)
    for k in range(shingle):
        more = k < width
        part = hashes[np.minimum(start + k, max(len(hashes) - 1, 0))]
        out = np.where(more, words.mix(out * _GOLD + part), out)
    # Equal shingles of a text stand together once sorted (by 40 bits of them); their place there is the strip.
    order = np.argsort((text.astype(np.uint64) << np.uint64(40)) | (out >> np.uint64(24)))
    out, text = out[order], text[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (text[1:] != text[:-1])][: len(out)]
    starts = np.flatnonzero(new)
    place = np.arange(len(out)) - np.repeat(starts, np.diff(np.r_[starts, len(out)]))
    return np.where(place > 0, words.mix(out + place.astype(np.uint64) * _GOLD), out), offsets


def dart_signatures(strip: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """For each text the earliest dart's hash in each coordinate; zeros for a text without strips."""
    texts = len(offsets) - 1
    weight = np.diff(offsets)
    signature = np.zeros((texts, size), np.uint64)
    depth = size * (math.log(size) + 3.0)
    open_ = np.flatnonzero(weight)
    while len(open_):
        limit = depth / weight[open_]  # so that about `depth` darts fall on each text
        rank = np.full((len(open_), size), np.inf)
        dart = np.zeros((len(open_), size), np.uint64)
        row = np.repeat(np.arange(len(open_)), weight[open_])
        index = np.arange(len(row)) - np.repeat(np.cumsum(weight[open_]) - weight[open_], weight[open_])
        seed = strip[offsets[open_][row] + index]
        now = np.zeros(len(seed))
        found_row, found_rank, found_dart = [], [], []
        while len(seed):
            seed = words.mix(seed + _GOLD)
            # The waiting time to the next dart of a strip has an exponential distribution.
            now = now - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            alive = now < limit[row]
            seed, now, row = seed[alive], now[alive], row[alive]
            found_row.append(row)
            found_rank.append(now)
            found_dart.append(seed)
        row, now, seed = (np.concatenate(x) for x in (found_row, found_rank, found_dart))
        drawn = words.mix(seed ^ _GOLD)
        cell = row * size + (drawn % np.uint64(size)).astype(np.int64)
        np.minimum.at(rank.ravel(), cell, now)
        earliest = now == rank.ravel()[cell]
        np.maximum.at(dart.ravel(), cell[earliest], drawn[earliest])  # equal ranks: the larger hash
        full = np.isfinite(rank).all(axis=1)
        signature[open_[full]] = dart[full]
        open_, depth = open_[~full], depth * 2
    return signature


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for k in range(rows):
        out = words.mix(out * _GOLD + signature[:, k::rows])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, bands): a digest of the text, and the buckets of its signature, none for a text without words."""
    schema = "doc_id bigint, text_key string, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                for piece in pieces(batch.slice(low, TEXTS)):
                    strip, offsets = strips(*joined(piece.column("text")))
                    hashes = band_hashes(dart_signatures(strip, offsets, BANDS * ROWS), BANDS, ROWS).view(np.int64)
                    filled = np.diff(offsets) > 0
                    ends = np.r_[0, np.cumsum(filled) * BANDS]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id"), piece.column("text_key"), list_array(hashes[filled].ravel(), ends, pa.int64())],
                        names=["doc_id", "text_key", "bands"],
                    )

    return docs.select(F.col("doc_id").cast("bigint"), F.sha2("text", 256).alias("text_key"), "text").mapInArrow(run, schema)


# ---- candidates, links, classes ------------------------------------------------------------------------


def linked(pairs: DataFrame, texts: DataFrame, up: int, down: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose weighted Jaccard similarity is at least up / down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.num_rows and (batch.num_rows << 20) // max(batch.nbytes, 1))
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                keys, at = strips(*joined(pa.concat_arrays([part.column("text_a"), part.column("text_b")])))
                kept = []
                for i in range(part.num_rows):
                    a, b = keys[at[i] : at[i + 1]], keys[at[i + part.num_rows] : at[i + part.num_rows + 1]]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    kept.append(down * both >= up * (len(a) + len(b) - both))
                yield part.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, class): the smallest id of each connected component of ``links`` (a, b).

    Every node has a parent, at first the smallest of itself and its neighbours. In a round a node takes the smallest grandparent among its
    neighbours for itself and for its parent, and its own grandparent, whichever is smallest, until the ends of each link have the same
    parent: it then is the same all over a component, and that of its smallest node is that node. Each step takes pre-aggregated minima; no
    node's neighbours meet in one place.
    """
    one = links.where("a != b")
    edges = durable(one.select("a", "b").unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    parents = durable(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("class")).withColumnRenamed("a", "id"))
    while not apart(edges, parents).isEmpty():
        up = parents.select(F.col("id").alias("class"), F.col("class").alias("grand"))
        grand = durable(parents.join(up, "class").select("id", "class", "grand"))
        near = edges.join(grand.select(F.col("id").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("low"))
        each = grand.join(near, grand["id"] == near["a"])
        own = F.struct(F.col("id"), F.least("grand", "low").alias("class"))
        parent = F.struct(F.col("class").alias("id"), F.col("low").alias("class"))
        parents = durable(
            each.select(F.explode(F.array(own, parent)).alias("p")).groupBy("p.id").agg(F.min("p.class").alias("class"))
        )
    return parents


def apart(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """The edges (a, b) whose ends have different parents."""
    left, right = (parents.select(F.col("id").alias(c), F.col("class").alias(f"_{c}")) for c in "ab")
    return edges.where("a > b").join(left, "a").join(right, "b").where("_a != _b")


def with_classes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``class``, a member's own id if it has no link."""
    return members.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))


def open_members(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows (bucket, id) of ``buckets`` whose bucket holds several classes."""
    members = durable(with_classes(buckets.select("bucket", "id"), classes))
    state = members.groupBy("bucket").agg(F.min("class").alias("_low"), F.max("class").alias("_high")).where("_low != _high")
    return durable(members.join(durable(state.select("bucket")), "bucket").select("bucket", "id"))


def strip_sets(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, size, tokens): the strips of the texts of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                keys, at = strips(*joined(piece.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(np.diff(at), pa.int64()), list_array(keys.view(np.int64), at, pa.int64())],
                    names=["id", "size", "tokens"],
                )

    wanted = texts.join(ids.select("id").distinct(), "id").select("id", "text")
    return durable(wanted.mapInArrow(run, "id bigint, size bigint, tokens array<bigint>"))


def near_links(buckets: DataFrame, texts: DataFrame, up: int, down: int) -> DataFrame:
    """Links (a, b), a > b, between members of ``buckets`` (bucket, id, leader, other) with ``texts`` (id, text). They connect
    all that any links between members of a bucket connect. ``leader`` is a bucket's smallest id, ``other`` its largest."""
    leaders = F.explode(F.array("leader", "other")).alias("_to")
    first = buckets.select("id", leaders).where("id != _to").select(F.greatest("id", "_to").alias("a"), F.least("id", "_to").alias("b"))
    links = durable(linked(first.distinct(), texts, up, down))
    classes = components(links)
    members = open_members(buckets, classes)
    if members.isEmpty():
        return links
    return links.unionByName(groups.links_between(members, strip_sets(members, texts), classes, up, down))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, text_id, links) per row of ``docs``: the smallest doc_id of the row's class, and of its equal texts.

    Rows of equal text that is not empty are of one class; texts are linked if the similarity of their shingles is at least
    ``similarity``. A null or empty text, and any text of a row without id, stays alone: its class is its own id. A
    text without words (marks alone) has equal texts but no links. ``links`` counts the other texts that the text was
    found linked with; links inside a class that is connected already are not looked for. Rows that repeat an id are one
    document: their texts are of one class. Only doc_id and text are read. An empty table gives no rows.
    """
    share = Fraction(similarity).limit_denominator(1000)
    rows = durable(sketches(docs.where("text is not null and text != '' and doc_id is not null")))
    # A text's own number is made of its digest, as an id may have several texts.
    number = F.conv(F.substring("text_key", 1, 15), 16, 10).cast("bigint")
    texts = durable(
        rows.groupBy("text_key").agg(F.min("doc_id").alias("text_id"), F.first("bands").alias("bands")).withColumn("id", number)
    )
    spread = texts.select("id", F.explode("bands").alias("bucket"))
    shared = durable(
        spread.groupBy("bucket")
        .agg(F.min("id").alias("leader"), F.max("id").alias("other"))
        .where("leader != other")
    )
    buckets = durable(spread.join(shared, "bucket").select("bucket", "id", "leader", "other"))
    wanted = buckets.select("id").distinct().join(texts.select("id", "text_id", "text_key"), "id")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("text_id"), "text")
    # Both keys, so that the rows stay where the join has put them.
    kept = durable(
        plain.join(wanted, "text_id").where(F.sha2("text", 256) == F.col("text_key")).select("text_id", "id", "text")
        .dropDuplicates(["text_id", "id"])
    )
    links = near_links(buckets, kept.select("id", "text"), share.numerator, share.denominator)
    of = rows.select("doc_id", number.alias("id"))
    classes = components(links.unionByName(same_document(of)))
    # Only texts with a link have a class; few of many, as a rule.
    linked_texts = durable(classes.join(texts.select("id", "text_id"), "id"))
    lowest = linked_texts.groupBy("class").agg(F.min("text_id").alias("class_id"))
    found = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    counts = found.groupBy("id").agg(F.count("*").alias("links"))
    named = durable(linked_texts.join(lowest, "class").join(counts, "id", "left").select("id", "class_id", "links"))
    of_rows = of.join(texts.select("id", "text_id"), "id").join(named, "id", "left").select(
        "doc_id", F.coalesce("class_id", "text_id").alias("class_id"), "text_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links")
    )
    rest = docs.where("text is null or text = '' or doc_id is null").select(F.col("doc_id").cast("bigint"))
    own = F.col("doc_id")
    return of_rows.unionByName(rest.select("doc_id", own.alias("class_id"), own.alias("text_id"), F.lit(0).cast("bigint").alias("links")))


def same_document(nodes: DataFrame) -> DataFrame:
    """Links (a, b), a > b, of the texts (id) of one doc_id with the smallest of them."""
    low = nodes.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("_high")).where("b != _high").select("doc_id", "b")
    return nodes.join(low, "doc_id").where("id != b").select(F.col("id").alias("a"), "b").distinct()


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: that of its smallest doc_id; of rows that repeat the id, that of the smallest text,
    then of the smallest other columns that can be ordered.

    Null and empty texts stay, each row of them. Rows without id stay.
    """
    keep = near_classes(docs, similarity).where("doc_id = class_id").select("doc_id").distinct()
    plain = F.col("text").isNull() | (F.col("text") == "") | F.col("doc_id").isNull()
    kept = docs.where(~plain).join(keep, "doc_id", "left_semi").select(*docs.columns)
    return one_of_each(kept).unionByName(docs.where(plain))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of the smallest text of each doc_id, then of the smallest digest of the whole row."""
    order = F.struct("text", F.xxhash64(F.to_json(F.struct(*docs.columns))))
    return docs.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
