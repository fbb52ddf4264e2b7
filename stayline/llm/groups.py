"""Links between documents that share a bucket, found group by group by a token-group matrix.

Documents are sets of tokens (sorted 64-bit hashes). Similar ones stand in a group, which has bounded tokens and documents: the
documents of one class, or those without a class whose first bucket has the same leader, cut by a hash where they are many.
A group is stored with the union of its tokens, the matrix's column. Two groups meet once if any bucket has documents of both,
however many such buckets and documents there are. A document can only be linked with one of a group if the group's union holds enough
of its tokens; the other group is opened, and its documents are read, only where some document passes that bound.
Of two groups only the one of the smaller union travels to the other, its union first: a large group that meets many others stays where it is.
A group, and an opened pair of groups, is compared whole, so no pair of documents is ever a row.

Classes are found by links, so documents of one class need none between them: two groups of the same one class do not meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.session import durable

GROUP_TOKENS = 1 << 16  # tokens of a group's documents together; a longer document is a group of its own
GROUP_DOCS = 256
SLICE = 4096  # tokens compared at a time


# ---- sets ---------------------------------------------------------------------------------------------------


def overlaps(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Common tokens of each set of ``a`` with each of ``b``. Set i has the tokens ``a[a_at[i]:a_at[i + 1]]``, each once."""
    out = np.zeros((len(a_at) - 1, len(b_at) - 1), np.float32)
    both = np.intersect1d(a, b)
    if not len(both):
        return out.astype(np.int64)

    def places(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
        found = both[column] == tokens
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.argsort(column[found], kind="stable")
        return row[found][order], column[found][order]

    (row_a, col_a), (row_b, col_b) = places(a, a_at), places(b, b_at)
    for low in range(0, len(both), SLICE):
        width = min(SLICE, len(both) - low)
        parts = []
        for row, col, n in ((row_a, col_a, len(out)), (row_b, col_b, out.shape[1])):
            own = slice(*np.searchsorted(col, (low, low + width)))
            dense = np.zeros((n, width), np.float32)
            dense[row[own], col[own] - low] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T  # whole numbers, exact up to 2^24 a slice
    return out.astype(np.int64)


def enough(both: np.ndarray, a: np.ndarray, b: np.ndarray, up: int, down: int) -> np.ndarray:
    """Whether intersections make similarities of at least up / down, in whole numbers."""
    return down * both >= up * (a[:, None] + b[None, :] - both)


def lists(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The flat values and the bounds of row i of an array<array<bigint>>."""
    low, high = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    inner = column.values
    at = inner.offsets.to_numpy()[low : high + 1].astype(np.int64)
    return inner.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def flat(column: pa.Array, i: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[i].as_py() : column.offsets[i + 1].as_py()]


# ---- groups -------------------------------------------------------------------------------------------------


def group_of(members: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, class, group) of ``members`` (bucket, id). ``sets`` has (id, size), ``classes`` (id, class) of those with a link."""
    leaders = members.groupBy("bucket").agg(F.min("id").alias("_leader"))
    first = members.groupBy("id").agg(F.min("bucket").alias("bucket"))
    known = classes.select(F.col("id").alias("_leader"), F.col("class").alias("_leader_class"))
    homes = (
        first.join(leaders, "bucket")
        .join(known, "_leader", "left")
        .join(classes, "id", "left")
        .join(sets.select("id", "size"), "id")
        .select(
            "id", F.coalesce("class", "id").alias("class"), "size",
            # Documents of a class together; the others with their first bucket's leader's class, apart from the class itself.
            F.when(F.col("class").isNotNull(), F.struct(F.lit(True).alias("own"), F.col("class").alias("of")))
            .otherwise(F.struct(F.lit(False).alias("own"), F.coalesce("_leader_class", "_leader").alias("of"))).alias("home"),
        )
    )
    homes = durable(homes)
    parts = homes.groupBy("home").agg(
        F.greatest(F.ceil(F.sum("size") / GROUP_TOKENS), F.ceil(F.count("*") / GROUP_DOCS)).cast("bigint").alias("_parts")
    )
    turn = F.pmod(F.xxhash64("id"), F.col("_parts"))
    return durable(homes.join(durable(parts), "home").select("id", "class", F.xxhash64("home.own", "home.of", turn).alias("group")))


def matrix(grouped: DataFrame, sets: DataFrame, up: int, down: int) -> DataFrame:
    """(group, ids, classes, tokens, union, links) of ``grouped`` (id, class, group); ``sets`` has (id, tokens). ``links`` are those inside
    the group, as ``linked_pairs`` gives them, one id after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unions, inside = [], []
            for i in range(batch.num_rows):
                tokens, at = lists(batch.column("tokens"), i)
                unions.append(np.unique(tokens))
                side = (tokens, at, flat(batch.column("ids"), i), flat(batch.column("classes"), i))
                inside.append(linked_pairs(side, side, up, down).T.ravel())
            added = []
            for parts in (unions, inside):
                ends = np.r_[0, np.cumsum([len(x) for x in parts])]
                added.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "union", "links"])

    rows = grouped.join(sets.select("id", "tokens"), "id").groupBy("group").agg(F.collect_list(F.struct("id", "class", "tokens")).alias("m"))
    rows = rows.select("group", "m.id", "m.class", "m.tokens").toDF("group", "ids", "classes", "tokens")
    schema = (
        "group bigint, ids array<bigint>, classes array<bigint>, tokens array<array<bigint>>, union array<bigint>, links array<bigint>"
    )
    return rows.mapInArrow(run, schema)


Side = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # tokens, their bounds, ids, classes


def linked_pairs(a: Side, b: Side, up: int, down: int) -> np.ndarray:
    """Links (larger id, smaller id), in two rows, of documents of different classes: the first found for any two classes."""
    (ta, at, ids_a, own_a), (tb, bt, ids_b, own_b) = a, b
    apart = own_a[:, None] != own_b[None, :]
    if not apart.any():
        return np.zeros((2, 0), np.int64)
    x, y = np.nonzero(enough(overlaps(ta, at, tb, bt), np.diff(at), np.diff(bt), up, down) & apart)
    classes = np.stack([np.minimum(own_a[x], own_b[y]), np.maximum(own_a[x], own_b[y])])
    _, first = np.unique(classes, axis=1, return_index=True)
    pairs = np.stack([ids_a[x[first]], ids_b[y[first]]])
    return np.stack([pairs.max(axis=0), pairs.min(axis=0)]) if len(first) else np.zeros((2, 0), np.int64)


def group_pairs(members: DataFrame, grouped: DataFrame, columns: DataFrame) -> DataFrame:
    """(a, b) of groups that share a bucket and are not of one and the same class; b is that of the smaller union in ``columns``, or else
    the smaller number."""
    span = columns.select(
        "group", F.array_min("classes").alias("_low"), F.array_max("classes").alias("_high"), F.size("union").alias("_n")
    )
    index = members.join(grouped.select("id", "group"), "id").select("bucket", "group").distinct().join(span, "group")
    index = durable(index)

    def side(s: str) -> DataFrame:
        return index.select("bucket", F.col("group").alias(s), *[F.col(f"_{c}").alias(f"_{s}{c}") for c in ("low", "high", "n")])

    one = (F.col("_alow") == F.col("_ahigh")) & (F.col("_blow") == F.col("_bhigh")) & (F.col("_alow") == F.col("_blow"))
    larger = F.struct("_an", "a") > F.struct("_bn", "b")
    return side("a").join(side("b"), "bucket").where(larger & ~one).select("a", "b").distinct()


def qualifying(pairs: DataFrame, columns: DataFrame, up: int, down: int) -> DataFrame:
    """Those of ``pairs`` (a, b) where a document of a has enough tokens in b's union. The union goes to where a's documents are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                tokens, at = lists(batch.column("tokens"), i)
                union = flat(batch.column("union"), i)
                found = np.r_[0, np.cumsum(union[np.minimum(np.searchsorted(union, tokens), len(union) - 1)] == tokens)]
                kept.append(bool((down * np.diff(found[at]) >= up * np.diff(at)).any()))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(columns.select(F.col("group").alias("b"), "union"), "b").join(
        columns.select(F.col("group").alias("a"), "tokens"), "a"
    )
    return both.select("a", "b", "tokens", "union").mapInArrow(run, "a bigint, b bigint")


def opened(pairs: DataFrame, columns: DataFrame, up: int, down: int) -> DataFrame:
    """Links (a, b), a > b, of documents of the groups ``pairs`` (a, b): one at least for any two classes that have any. The documents of b go
    to where those of a are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((2, 0), np.int64)]
            swapped = pc.greater(batch.column("a"), batch.column("b")).to_pylist()  # the group of the smaller number first, whichever came
            for i in range(batch.num_rows):
                sides = [
                    (*lists(batch.column(f"tokens_{s}"), i), flat(batch.column(f"ids_{s}"), i), flat(batch.column(f"classes_{s}"), i))
                    for s in ("ba" if swapped[i] else "ab")
                ]
                found.append(linked_pairs(*sides, up, down))
            links = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], names=["a", "b"])

    def side(s: str) -> DataFrame:
        return columns.select(F.col("group").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "classes", "tokens")])

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(run, "a bigint, b bigint")


def links_between(members: DataFrame, sets: DataFrame, classes: DataFrame, up: int, down: int) -> DataFrame:
    """Links (a, b), a > b, between documents of different classes that share a bucket: one at least for any two classes
    that have any. It may hold links of documents that share none.

    ``members`` has (bucket, id), ``sets`` (id, size, tokens), ``classes`` (id, class) of the documents that have a link
    already; all stored tables. Two sets are linked if their similarity is at least up / down.
    """
    grouped = group_of(members, sets, classes)
    columns = durable(matrix(grouped, sets, up, down))
    pairs = group_pairs(members, grouped, columns)
    across = durable(opened(qualifying(pairs, columns, up, down), columns, up, down))
    each = F.expr("explode(transform(sequence(0, size(links) - 2, 2), i -> struct(links[i] AS a, links[i + 1] AS b))) AS l")
    inside = columns.where("size(links) > 0").select(each).select("l.*")
    return across.unionByName(inside)
