"""Daily telemetry panel: scans by date, lookback before a disconnect, lines that stayed.

The panel has one row per line and day (``daily`` makes it so), which bounds every per-line group
by the number of calendar days, however many raw rows a line sends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions import codes, dates, hashing
from stayline.session import durable

KEY = ("mdn_5g", "cust_id")


def daily(raw: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row per line and day; raw rows are summed up on the map side before the shuffle."""
    return raw.groupBy(*KEY, "cpe_date").agg(*[m.alias(name) for name, m in measures.items()])


def lookback_bounds(disconnects: DataFrame, days: int = 30) -> DataFrame:
    """One row: the first day of the earliest lookback and the last disconnect day."""
    return disconnects.agg(
        F.date_sub(F.min("deact_dt"), days).alias("first_day"),
        F.max("deact_dt").alias("last_day"),
    )


def scan_range(panel: DataFrame, bounds: DataFrame) -> DataFrame:
    """Panel days within the bounds. On a panel partitioned by day only those folders are read."""
    ends = bounds.select(F.struct("first_day", "last_day").alias("ends")).scalar()  # one query for both
    return panel.where((F.col("cpe_date") >= ends["first_day"]) & (F.col("cpe_date") <= ends["last_day"]))


def latest_score_date(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*KEY).agg(F.max("cpe_date").alias("latest_score_date"))


def with_telemetry(disconnects: DataFrame, panel: DataFrame) -> DataFrame:
    """Disconnects of lines that have telemetry.

    The telemetry's keys are made distinct, on the map side first, and stored: of the telemetry itself nothing is
    shuffled, and Spark can split a busy line's partition, as both sides of the join are plain tables.
    """
    return disconnects.join(durable(panel.select(*KEY).distinct()), list(KEY), "left_semi")


def lookback(
    disconnects: DataFrame, panel: DataFrame, days: int = 30, *, closed: bool = True
) -> DataFrame:
    """Telemetry of the ``days`` up to each disconnect, with the disconnect's columns.

    ``closed`` keeps both end days; otherwise only days strictly between them. Equal disconnects
    count once. Dates are cut into blocks one window long, so a window touches at most two blocks
    and a disconnect is copied at most twice; the join is on (line, block), which spreads a busy
    line over its blocks and compares each day only with disconnects near it.
    """
    width = days + 1
    events = disconnects.distinct().withColumn(
        "_block",
        F.explode(
            F.sequence(
                dates.day_block(F.date_sub("deact_dt", days), width),
                dates.day_block(F.col("deact_dt"), width),
            )
        ),
    )
    rows = panel.withColumn("_block", dates.day_block(F.col("cpe_date"), width))
    near = F.col("cpe_date").between(F.date_sub("deact_dt", days), F.col("deact_dt"))
    if not closed:
        near = (F.col("cpe_date") > F.date_sub("deact_dt", days)) & (
            F.col("cpe_date") < F.col("deact_dt")
        )
    return rows.join(events, [*KEY, "_block"]).where(near).drop("_block")


def stable_lines(activity: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Lines with exactly one activation and no disconnect, with that activation's ``columns``.

    Lines are counted first, in fixed-size cells that are added up in a hash table on the map side; only the activations of the
    lines that qualify, one each, are then looked up. ``activity`` is read twice: pass a stored table.
    """
    is_start = F.col("activity_cd") == "AC"
    is_end = F.col("activity_cd").isin(*codes.DISCONNECT_CODES)
    lines = (
        activity.where(is_start | is_end)
        .groupBy(*KEY)
        .agg(F.count_if(is_start).alias("_starts"), F.count_if(is_end).alias("_ends"))
        .where((F.col("_starts") == 1) & (F.col("_ends") == 0))
        .select(*KEY)
    )
    if not columns:
        return lines
    return activity.where(is_start).select(*KEY, *columns).join(lines, list(KEY))


def active_panel(activity: DataFrame, panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All telemetry of stable lines, with their activation's columns."""
    return panel.join(stable_lines(activity, columns), list(KEY))


def row_counts(panel: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Every panel row with its line's number of rows (at most one per calendar day)."""
    return panel.withColumn("total_rows", F.count("*").over(Window.partitionBy(*keys)))


def random_place(
    salt: str, group: Sequence[str], keys: Sequence[str] = KEY, *, shared: bool = False
) -> Column:
    """Place of a day in its group's random order: a hash of line and day, the same in every run.

    With ``shared`` all rows of a day have its place; otherwise each row has one of its own.
    """
    order = Window.partitionBy(*group).orderBy(
        hashing.digest(salt, [*keys, "cpe_date"]), "cpe_date"
    )
    return (F.dense_rank() if shared else F.row_number()).over(order)


def anchor_days(panel: DataFrame, salt: str) -> DataFrame:
    """One random day of each line's telemetry as ``deact_dt``: the day after it ends its window."""
    first = F.min(F.struct(hashing.digest(salt, [*KEY, "cpe_date"]).alias("h"), F.col("cpe_date").alias("d")))
    return panel.groupBy(*KEY).agg(F.date_add(first["d"], 1).alias("deact_dt"))


def sample_days(
    panel: DataFrame, k: int = 30, salt: str = "days", keys: Sequence[str] = KEY
) -> DataFrame:
    """``k`` random days per line. Each task keeps its own first ``k`` days of a line before the
    shuffle, so no line brings more than ``k`` rows per task."""
    picked = panel.withColumn("row_number", random_place(salt, keys, keys))
    return picked.where(F.col("row_number") <= k).drop("row_number")
