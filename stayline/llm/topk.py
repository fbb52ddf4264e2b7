"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks by a hash, queries into blocks of their own; each pair of blocks is one cell. In
a cell every dimension has its list of candidates in order of value. The lists are read from both ends, deeper and
deeper, for all queries of the cell together: candidates that come up first are scored in full. What is still unread
in a dimension lies between the next values of its two ends, so the sum of a query's weights times those values
bounds all unseen scores. A query leaves as soon as its k-th score is above that bound; a tie goes on, because
a smaller id might win it. Each cell's k best per query are then ranked over all cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK = 16_384  # rows of a cell at most, about
SMALLEST_BLOCK = 512
QUERY_BLOCK = 4_096
FIRST_DEPTH = 8
EXACT = 2**53


def whole_vector(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    usable = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    # `usable` is tested inside as well: Spark may evaluate the floor of a row it drops later.
    return F.when(
        embedding.isNotNull() & usable,
        F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))),
    )


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """One row per list, short ones filled up with zeros."""
    lists = lists.combine_chunks()
    values = lists.values.to_numpy(zero_copy_only=False)
    at = lists.offsets.to_numpy()
    if len(lists) and (np.diff(at) == width).all():
        return values[at[0] : at[-1]].reshape(-1, width)
    out = np.zeros((len(lists), width), np.int64)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out[i, : b - a] = values[a:b]
    return out


def threshold_topk(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, row ids, scores) of each query's k best rows but its own; ties to the smaller row id.

    A score times the number of rows must fit 63 bits.
    """
    by_id = np.argsort(ids, kind="stable")
    rows, ids = rows[by_id], ids[by_id]
    n, width = rows.shape
    largest = max(1, np.abs(queries).max(initial=0)) * max(1, np.abs(rows).max(initial=0)) * max(1, width)
    kind = np.float64 if float(largest) < EXACT else np.int64  # doubles are exact there, and faster
    queries, rows = queries.astype(kind), rows.astype(kind)
    order = np.argsort(rows, axis=0, kind="stable")
    values = np.take_along_axis(rows, order, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    # Rows are in id order, so score and place make one whole number that ranks with the right ties.
    step, none = n + 1, np.iinfo(np.int64).min
    best = np.full((len(queries), k), none, np.int64)
    active, seen = np.arange(len(queries)), np.zeros(n, bool)
    low, high = 0, FIRST_DEPTH
    while len(active):
        high = min(high, n)
        ends = np.r_[order[low:high].ravel(), order[n - high : n - low].ravel()]
        fresh = np.zeros(n, bool)
        fresh[ends] = True
        fresh &= ~seen
        seen |= fresh
        heads = np.flatnonzero(fresh)
        if len(heads):
            keys = (queries[active] @ rows[heads].T).astype(np.int64) * step - heads
            keys[query_ids[active][:, None] == ids[heads][None, :]] = none
            both = np.concatenate([best[active], keys], axis=1)
            best[active] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        if high >= n or seen.all():
            break
        bound = up[active] @ values[n - 1 - high] + down[active] @ values[high]
        kth = best[active].min(axis=1)
        score = -(-kth // step)  # the place taken off is below one step
        active = active[(kth == none) | (score <= bound)]
        low, high = high, 2 * high
    which, at = np.nonzero(best != none)
    keys = best[which, at]
    scores = -(-keys // step)
    return query_ids[which], ids[scores * step - keys], scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all other rows, or all if fewer.

    Both tables have (vec_id bigint, vector array<bigint>); a short vector counts as followed by zeros. Rows whose id
    or vector is null, or whose vector holds a null, take no part. Rows that repeat an id are candidates of their own,
    and none of them is a candidate of the query of that id; a repeated query id is answered once, for the largest of
    its vectors. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    usable = F.col("vec_id").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    rows = vectors.where(usable).select("vec_id", "vector")
    asked = queries.where(usable).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    n_rows, n_asked = rows.count(), asked.count()
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n_rows // CANDIDATE_BLOCK), min(wanted, -(-n_rows // SMALLEST_BLOCK)), 1)
    query_blocks = max(1, -(-n_asked // QUERY_BLOCK))

    def block(count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = rows.select("vec_id", "vector", block(blocks).alias("cb"), every(query_blocks).alias("qb"))
    right = asked.select("vec_id", "vector", block(query_blocks).alias("qb"), every(blocks).alias("cb"))

    def cell(candidates: pa.Table, own: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        found = [np.zeros(0, np.int64)] * 3
        if candidates.num_rows and own.num_rows:
            lists = [t.column("vector") for t in (candidates, own)]
            width = max(int(np.diff(c.combine_chunks().offsets.to_numpy()).max()) for c in lists)
            if width:
                rows_, queries_ = (matrix(c, width) for c in lists)
            else:
                rows_, queries_ = (np.zeros((len(c), 1), np.int64) for c in lists)
            ids, query_ids = (t.column("vec_id").to_numpy() for t in (candidates, own))
            found = threshold_topk(queries_, query_ids, rows_, ids, k)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, found, strict=True)})

    best = (
        left.groupBy("cb", "qb")
        .cogroup(right.groupBy("cb", "qb"))
        .applyInArrow(cell, "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
