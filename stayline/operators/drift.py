"""Drift of a model's inputs over time: how far each period's values lie from the first period's.

The exact statistic is the largest distance between two distribution functions (Kolmogorov-Smirnov). Between two
values of a period its own function stands still while the reference's only grows, so the distance need be looked at only at the period's
values, just before and just after. Both functions are running totals over range blocks of distinct values; no period is sorted
in one task.

Beside it stand summaries that add up: counts by buckets whose width is a fixed share of their values. A month's summary is the sum
of its days', and gives every quantile within that share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.numbers import ratio
from stayline.operators.ranking import running_totals
from stayline.session import durable

BITS = 7  # leading bits of a value that its bucket keeps: relative error below 2^-6


def distances(rows: DataFrame, period: str, value: str) -> DataFrame:
    """(period, n, distance) per period: the exact two-sample statistic of its whole-number ``value`` against the first period.

    Rows without period or value are left out. The first period's distance is 0. Without rows there are no periods.
    """
    known = rows.select(F.col(period).alias("period"), F.col(value).cast("bigint").alias("value")).dropna()
    cells = durable(known.groupBy("period", "value").agg(F.count("*").alias("n")))
    first = cells.agg(F.min("period")).scalar()
    sized = cells.groupBy("period").agg(F.sum("n").alias("n_period"))
    # The reference's running total at every value that any period has.
    at = cells.groupBy("value").agg(F.sum(F.when(F.col("period") == first, F.col("n")).otherwise(0)).alias("n_ref"))
    reference = durable(running_totals(at, "value", {"ref_upto": "n_ref"}))
    own = running_totals(cells, "value", {"own_upto": "n"}, within=["period"])
    n_ref = cells.where(F.col("period") == first).agg(F.sum("n")).scalar()
    both = own.join(reference, "value").join(sized, "period")

    def gap(own_n: Column, ref_n: Column) -> Column:
        # |a / b - c / d| as one whole number over b * d.
        wide = "decimal(38,0)"
        return F.abs(own_n.cast(wide) * n_ref.cast(wide) - ref_n.cast(wide) * F.col("n_period").cast(wide))

    largest = F.greatest(gap(F.col("own_upto"), F.col("ref_upto")), gap(F.col("own_upto") - F.col("n"), F.col("ref_upto") - F.col("n_ref")))
    return both.groupBy("period", "n_period").agg(F.max(largest).alias("_gap")).select(
        "period", F.col("n_period").alias("n"),
        ratio(F.col("_gap"), F.col("n_period").cast("double") * n_ref.cast("double")).alias("distance"),
    )


def bucket(value: Column, bits: int = BITS) -> Column:
    """The largest value of the bucket of a whole number: its ``bits`` leading bits are kept, the others set."""
    size = F.abs(value)
    cut = F.greatest(F.lit(0), F.length(F.bin(size)) - bits)
    low = F.call_function("shiftleft", F.call_function("shiftright", size, cut), cut)
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), cut)
    # Of a negative number the bucket's largest value is the one nearest to zero.
    return F.when(value < 0, -low).otherwise(low + width - 1)


def summaries(rows: DataFrame, periods: Sequence[str], value: str, bits: int = BITS) -> DataFrame:
    """(periods, bucket, n) of a whole-number ``value``: a few hundred rows per period, whatever it holds. Rows without a value are
    left out. Summaries of the same bits add up (``added``)."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*periods, bucket(F.col(value).cast("bigint"), bits).alias("bucket")).agg(F.count("*").alias("n"))


def added(summary: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Summaries of fewer or coarser ``periods``, such as months of days."""
    return summary.groupBy(*periods, "bucket").agg(F.sum("n").alias("n"))


def quantiles(summary: DataFrame, periods: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """(periods, n, a column per share): the bucket of the smallest value with at least that share of values at or below it.

    At most one part in 2^(bits - 1) above that value.
    """
    order = Window.partitionBy(*periods).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*periods)
    placed = summary.withColumns({"_upto": F.sum("n").over(order), "_all": F.sum("n").over(whole)})
    points = [
        F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * share - 1e-9), F.col("bucket"))).alias(name) for name, share in shares.items()
    ]
    return placed.groupBy(*periods).agg(F.max("_all").alias("n"), *points)
