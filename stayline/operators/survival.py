"""Time to disconnect when many lines are still on: the product-limit estimate per segment.

Lines are summed up by segment and day of life first, so what is ordered is days, not lines. Days are cut into blocks: running
totals inside a block, from both sides, plus the totals of the blocks before and after. Only block totals of a segment are ordered as a
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64  # days


def lifetimes(start: Column, end: Column, data_end: Column) -> tuple[Column, Column]:
    """Days a line lived, and whether it ended; a line without end, or with one after the data, is censored at their end."""
    ended = end.isNotNull() & (end <= data_end)
    return F.datediff(F.when(ended, end).otherwise(data_end), start), ended


def product_limit(lines: DataFrame, segment: str, duration: str, ended: str, block: int = BLOCK) -> DataFrame:
    """(segment, day, at_risk, n_ended, n_censored, survival, hazard_sum) for each segment and day of life on which a line ended or was
    censored.

    ``at_risk`` are the lines that lived to that day at least; lines censored on a day count among those at risk that day.
    ``survival`` is the share still on after it, ``hazard_sum`` the sum of ended over at risk so far. Null is a segment
    like any other. Lines whose duration is null or negative, or of which it is not known whether they ended, are left out.
    """
    known = lines.where((F.col(duration) >= 0) & F.col(ended).isNotNull())
    days = known.groupBy(F.col(segment), F.col(duration).cast("bigint").alias("day")).agg(
        F.count_if(F.col(ended)).alias("n_ended"), F.count_if(~F.col(ended)).alias("n_censored")
    )
    blocks = days.withColumns(
        {"_block": F.floor(F.col("day") / block), "_all": F.col("n_ended") + F.col("n_censored")}
    )
    # At risk: everything from this day on. That is this block's rest and all later blocks.
    own = Window.partitionBy(segment, "_block").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(segment).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(segment, "_block").agg(F.sum("_all").alias("_n"))
    after = totals.select(F.col(segment).alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    risk = blocks.join(after, blocks[segment].eqNullSafe(after["_s"]) & (blocks["_block"] == after["_b"])).withColumn(
        "at_risk", F.sum("_all").over(own) + F.col("_later")
    )
    # A day on which all end takes survival to zero for good; its logarithm has no place in a sum.
    left = F.col("at_risk") - F.col("n_ended")
    rated = risk.withColumns(
        {
            "_log": F.when(left > 0, F.log(left.cast("double") / F.col("at_risk").cast("double"))).otherwise(F.lit(0.0)),
            "_gone": F.when(left == 0, 1).otherwise(0),
            "_hazard": F.col("n_ended").cast("double") / F.col("at_risk").cast("double"),
        }
    )
    parts = rated.groupBy(segment, "_block").agg(*[F.sum(c).alias(c) for c in ("_log", "_gone", "_hazard")])
    before = Window.partitionBy(segment).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select(
        F.col(segment).alias("_t"), F.col("_block").alias("_c"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_log", "_gone", "_hazard")]
    )
    inside = Window.partitionBy(segment, "_block").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    full = rated.drop("_s", "_b").join(sums, rated[segment].eqNullSafe(sums["_t"]) & (rated["_block"] == sums["_c"]))
    upto = {c: F.sum(c).over(inside) + F.col(f"{c}_before") for c in ("_log", "_gone", "_hazard")}
    return full.withColumns({f"{c}_upto": v for c, v in upto.items()}).select(
        segment, "day", "at_risk", "n_ended", "n_censored",
        F.when(F.col("_gone_upto") > 0, F.lit(0.0)).otherwise(F.exp("_log_upto")).alias("survival"),
        F.col("_hazard_upto").alias("hazard_sum"),
    )


def median_lifetime(table: DataFrame, segment: str) -> DataFrame:
    """(segment, median_day): the first day on which half or fewer of a segment's lines are still on; null if that is never seen."""
    return table.groupBy(segment).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("day"))).alias("median_day"))
