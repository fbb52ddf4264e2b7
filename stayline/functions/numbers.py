"""Arithmetic whose result does not depend on the order rows arrive in.

Sums of doubles change with task order. Values are therefore turned into whole units first, a million millionth
(1e-12) each, and added as 38-digit decimals: partial sums merge exactly, and no sum below 1e26 overflows. A mean is
rounded half up (away from zero) from the exact sum. What is not finite (NaN, infinity) is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 1_000_000_000_000
WIDE = "decimal(38,0)"


def finite(value: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def units(value: Column, per_one: int = UNITS) -> Column:
    """A double as a whole number of 1/``per_one`` units."""
    return F.rint(finite(value) * F.lit(float(per_one))).cast(WIDE)


def mean_2dp(value: Column) -> Column:
    """Aggregate: ``round(avg(value), 2)`` from exact sums; NULL if no value is finite."""
    parts = units(value)
    total, n = F.sum(parts), F.count(parts)
    step = F.lit(UNITS // 100).cast(WIDE)
    # hundredths = floor(|total| / (n * step) + 1/2)
    hundredths = F.call_function("div", F.abs(total) * 2 + n * step, n * step * 2)
    return F.when(n > 0, F.signum(total) * hundredths.cast("double") / F.lit(100.0))


def mean(value: Column) -> Column:
    """Aggregate: the mean from the exact sum; NULL if no value is finite."""
    parts = units(value)
    return F.try_divide(F.sum(parts).cast("double"), F.count(parts).cast("double") * F.lit(float(UNITS)))


def mean_of_whole(value: Column) -> Column:
    """Aggregate: ``round(avg(value), 2)`` of a bigint of any size."""
    return F.round(F.avg(value.cast("decimal(20,0)")), 2).cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as a double, 0 where the bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def fixed_point(probability: Column, digits: int = 15) -> Column:
    """A score in [0, 1] as a whole number of its fifteenth digit, so that equal scores tie and others do not."""
    return units(probability, 10**digits).cast("bigint")
