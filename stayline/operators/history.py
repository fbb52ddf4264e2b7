"""Slowly-changing histories: validity intervals and the join on them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = date(9999, 12, 31)


def date_span(rows: DataFrame, day: str) -> tuple[Column, Column]:
    """First and last date of a column (the last rounded up past its month), as values.

    Wide enough for joins at the day itself, the day after, and the end of its month.
    """
    ends = F.struct(F.min(day).alias("lo"), F.date_add(F.last_day(F.max(day)), 1).alias("hi"))
    span = rows.agg(ends.alias("ends")).scalar()  # one query for both
    return span["lo"], span["hi"]


def scd2_join(
    facts: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    *,
    at: str,
    how: str = "left",
    span: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Join rows to the history valid on the row's date ``at``; both ends of validity count.

    The key alone would make one task compare all rows of a busy line with all its history. The
    join key is therefore (keys, year): a history row is repeated for every year it covers, within
    the dates the facts have at all, so an open end costs a few copies. A hot line spreads over
    its years, and the shuffled partitions that are still too big are split by AQE.

    ``span`` must contain every date ``at``. Take it from a base table when ``facts`` is itself the
    result of joins, or those would run once more to find it.
    """
    lo, hi = span if span is not None else date_span(facts, at)
    year = F.expr("interval 1 year")
    start = F.trunc(F.greatest(F.col("eff_dt"), lo), "YEAR")
    stop = F.trunc(F.least(F.col("exp_dt"), hi), "YEAR")
    right = (
        history.where((F.col("eff_dt") <= hi) & (F.col("exp_dt") >= lo))
        .where(F.col("eff_dt") <= F.col("exp_dt"))
        .withColumn("_year", F.explode(F.sequence(start, stop, year)))
    )
    left = facts.withColumn("_year", F.trunc(at, "YEAR")).alias("l")
    right = right.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_year"]]
    on.append(F.col(f"l.{at}").between(F.col("r.eff_dt"), F.col("r.exp_dt")))
    joined = left.join(right, on, how)
    kept = [F.col(f"l.{c}") for c in facts.columns]
    if how != "left_semi":
        kept += [F.col(f"r.{c}") for c in history.columns if c not in keys]
    return joined.select(*kept)


def validity(changes: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """``eff_dt``/``exp_dt`` from change days: each row is valid until the day before the next.

    ``changes`` has one row per key and day, so a key has at most one row per calendar day.
    """
    following = F.lead(day).over(Window.partitionBy(*keys).orderBy(day))
    return changes.withColumns(
        {
            "eff_dt": F.col(day),
            "exp_dt": F.coalesce(F.date_sub(following, 1), F.lit(OPEN_END)),
        }
    )
