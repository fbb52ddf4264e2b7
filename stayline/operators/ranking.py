"""Global ranks and running totals without a global sort in one task.

Both cut the order into blocks, total the blocks, and add each block's offset to the position
inside the block. Only the block totals, whose number is bounded, meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions import hashing
from stayline.session import durable

PREFIX_DIGITS = 4  # 16^4 = 65,536 blocks of evenly spread hashes


def hash_rank(
    df: DataFrame, keys: Sequence[str], salt: str, within: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Position 1..n of every row in the random order of its key's hash, per class ``within``.

    ``keys`` identify the row; neither they nor ``within`` may be NULL. ``within`` may hold a few classes only, such as the label: a class
    is itself spread over all blocks. A block's leading hash digits are compared first, so the
    blocks are in hash order.
    """
    hashed = df.withColumn("_hash", hashing.digest(salt, keys)).withColumn(
        "_block", F.substring("_hash", 1, PREFIX_DIGITS)
    )
    group = [*within, "_block"]
    before = (
        Window.partitionBy(*within)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        hashed.groupBy(*group)
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group).orderBy("_hash", *keys)
    return (
        hashed.withColumn("_place", F.row_number().over(inside))
        .join(offsets, group)
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_hash", "_block", "_place", "_offset")
    )


def running_totals(
    df: DataFrame,
    order: str,
    totals: dict[str, str],
    *,
    within: Sequence[str] = (),
    descending: bool = False,
    width: int | None = None,
) -> DataFrame:
    """Running totals over a whole number ``order`` that is unique per row, or per class ``within``.

    ``totals`` maps new column to the column summed up to and including the row. Blocks are range partitions of the
    rows themselves, so each has about as many rows as the others however the numbers lie; with ``width`` they are stretches of that many
    numbers. One total per block, and class, meets in one task. Rows without a number are left out.
    """
    df = df.where(F.col(order).isNotNull())
    by = F.col(order).desc() if descending else F.col(order).asc()
    if width is None:
        # Stored, so that a row has the same block in its block's total and in the order inside it.
        blocks = durable(df.repartitionByRange(by).withColumn("_block", F.spark_partition_id()))
        block_order = F.col("_block").asc()
    else:
        blocks = df.withColumn("_block", F.floor(F.col(order).cast("decimal(38,0)") / F.lit(width)).cast("bigint"))
        block_order = F.col("_block").desc() if descending else F.col("_block").asc()

    before = Window.partitionBy(*within).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*within, "_block").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = blocks.groupBy(*within, "_block").agg(
        *[F.sum(src).alias(f"_sum_{new}") for new, src in totals.items()]
    )
    offsets = sums.select(
        *[F.col(c).alias(f"_of_{c}") for c in within], F.col("_block").alias("_of_block"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals],
    )
    placed = blocks.withColumns({f"_in_{new}": F.sum(src).over(inside) for new, src in totals.items()})
    same = placed["_block"] == offsets["_of_block"]
    for c in within:
        same = same & placed[c].eqNullSafe(offsets[f"_of_{c}"])
    return placed.join(offsets, same).select(
        *df.columns, *[(F.col(f"_off_{n}") + F.col(f"_in_{n}")).alias(n) for n in totals]
    )
