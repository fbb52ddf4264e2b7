"""Joins on validity intervals of any length, and histories put together from overlapping records.

Days are cut into nodes: single days, and runs of 4, 16, 64 days and so on, each starting at a multiple of its length. An
interval of any length is the union of few nodes (at most six per size), and a day lies in one node of each size. So "the day lies in
the interval" becomes equality of a node, a plain join key: a history row is copied as often as it has nodes, which grows with the
logarithm of its length, a fact once per size that the history has. No key, year or other long stretch of time
gathers what only overlaps it: rows meet where one node holds them both. A join's smallest nodes are of 64 days, where dates are compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.operators.history import OPEN_END, date_span
from stayline.session import durable

BITS = 2  # sizes of 4^level days
LEVELS = 9  # up to 65,536 days, about 180 years
JOIN_LEVEL = 3  # the lowest of a join, 64 days
CELLS = "array<struct<level: int, node: int>>"


def day_number(day: Column) -> Column:
    return F.unix_date(day)


def block_of(day: Column, level: int) -> Column:
    """Number of the node of that level which holds a day number."""
    return F.shiftright(day, BITS * level)


def nodes(first: Column, last: Column, least: int = 0) -> Column:
    """The nodes (level, node) whose union is the days ``first`` to ``last``, both included; none if there are no days.

    With ``least`` no node is of a lower level: those of that level at the ends may hold days beside the interval.
    """
    end, parts = last + 1, []

    def full(level: int) -> tuple[Column, Column]:
        """First and end of the level's nodes that lie in the interval whole."""
        size = 1 << (BITS * level)
        if level == least > 0:
            return F.shiftright(first, BITS * level), F.when(first <= last, F.shiftright(last, BITS * level) + 1)
        return F.shiftright(first + (size - 1), BITS * level), F.shiftright(end, BITS * level)

    def run(level: int, low: Column, high: Column) -> Column:
        cell = lambda n: F.struct(F.lit(level).alias("level"), n.cast("int").alias("node"))
        return F.when(low < high, F.transform(F.sequence(low, F.greatest(low, high - 1)), cell)).otherwise(F.array().cast(CELLS)).cast(CELLS)

    for level in range(least, LEVELS):
        low, high = full(level)
        if level == LEVELS - 1:
            parts.append(run(level, low, high))
            continue
        above_low, above_high = full(level + 1)
        above_low, above_high = F.shiftleft(above_low, BITS), F.shiftleft(above_high, BITS)
        some = above_low < above_high  # a node of the next level lies inside, with this level's at its sides
        parts.append(run(level, low, F.when(some, above_low).otherwise(high)))
        parts.append(run(level, F.when(some, above_high).otherwise(high), high))
    return F.concat(*parts)


def spread(
    history: DataFrame, span: tuple[Column, Column] | None = None, first: str = "eff_dt", last: str = "exp_dt", least: int = 0
) -> DataFrame:
    """``history`` with _level and _node, a row per node of its interval (``least`` as in ``nodes``). Intervals that end before they begin, or have no
    beginning, are left out; no end is an open one. ``span`` cuts them to the days that matter, so an open end costs little."""
    start, stop = F.col(first), F.coalesce(F.col(last), F.lit(OPEN_END))
    if span is not None:
        start, stop = F.greatest(start, span[0]), F.least(stop, span[1])
    cut = history.withColumns({"_first": day_number(start), "_last": day_number(stop)})
    kept = cut.where(F.col(first).isNotNull() & (F.col("_first") <= F.col("_last"))).where(
        F.col(first) <= F.coalesce(F.col(last), F.lit(OPEN_END))
    )
    cells = kept.withColumn("_cell", F.explode(nodes(F.col("_first"), F.col("_last"), least)))
    return cells.withColumns({"_level": F.col("_cell.level"), "_node": F.col("_cell.node")}).drop("_first", "_last", "_cell")


def sizes_of(cells: DataFrame) -> list[int]:
    """The levels that occur, at most ``LEVELS`` numbers."""
    return sorted(r[0] for r in cells.select("_level").distinct().collect())


def levels_within(history: DataFrame, first: str, last: str) -> list[int]:
    """The levels whose nodes fit into the longest interval, so all that can occur."""
    longest = history.agg(F.max(F.date_diff(last, first) + 1)).first()[0] or 0
    return [k for k in range(LEVELS) if 1 << (BITS * k) <= longest]


def cells_of(day: Column, levels: Sequence[int]) -> Column:
    """The nodes (level, node) that hold a day, one per level."""
    number = day_number(day)
    cells = [F.struct(F.lit(k).alias("level"), block_of(number, k).cast("int").alias("node")) for k in levels]
    return F.array(*cells).cast(CELLS)


def at_nodes(rows: DataFrame, day: Column, levels: Sequence[int]) -> DataFrame:
    """``rows`` with _level and _node, a row per level; rows without a day are left out."""
    many = rows.where(day.isNotNull()).withColumn("_cell", F.explode(cells_of(day, levels)))
    return many.withColumns({"_level": F.col("_cell.level"), "_node": F.col("_cell.node")}).drop("_cell")


def interval_join(
    facts: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    *,
    at: str,
    how: str = "left",
    first: str = "eff_dt",
    last: str = "exp_dt",
) -> DataFrame:
    """Rows of ``facts`` with the history valid on their date ``at``, both ends included; like ``history.scd2_join``, but for intervals
    of any length without a copy per year.

    ``how`` is inner, left or left_semi. Overlapping histories give a row each. A null key or date matches nothing, and a
    null end is an open one. Rows meet in nodes of 64 days or more, of which the lowest may hold days beside an interval, so dates are
    compared there: a shuffled copy costs more than the pairs of 64 days that are compared in vain. Facts are stored first, as they are read for their span of dates, for the join, and to find what has no match.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"how = {how!r}")
    rows = durable(facts.withColumn("_fact", F.monotonically_increasing_id()))
    cells = durable(spread(history, date_span(rows, at), first, last, JOIN_LEVEL))
    added = [c for c in history.columns if c not in keys]
    right = cells.select(
        *keys, "_level", "_node", F.struct(*[F.col(c) for c in added]).alias("_valid"),
        F.col(first).alias("_from"), F.coalesce(F.col(last), F.lit(OPEN_END)).alias("_to"),
    )
    left = at_nodes(rows.select("_fact", *keys, F.col(at).alias("_at")), F.col("_at"), sizes_of(cells))
    met = left.join(right, [*keys, "_level", "_node"]).where(F.col("_at").between(F.col("_from"), F.col("_to")))
    found = met.select("_fact", "_valid")
    if how == "left_semi":
        return rows.join(found.select("_fact"), "_fact", "left_semi").select(*facts.columns)
    both = rows.join(found, "_fact", how)
    return both.select(*[F.col(c) for c in facts.columns], *[F.col(f"_valid.{c}").alias(c) for c in added])


# ---- histories from records -------------------------------------------------------------------------------------


def resolved(
    records: DataFrame, keys: Sequence[str], values: Sequence[str], priority: Sequence[str], first: str = "eff_dt", last: str = "exp_dt"
) -> DataFrame:
    """(keys, eff_dt, exp_dt, values): a history without overlaps, each day with the values of the record of highest priority then valid.

    ``records`` may overlap, come late and contradict one another. ``priority`` are columns compared in turn, larger wins, such as the
    time of recording; of records equal in all of them the one with the larger values wins. Adjoining days with
    equal values are one interval. Days without any record are gaps. Records that end before they begin, or have no beginning or no
    key, are left out; no end is an open one.

    A sweep over the ends: the winner can only change where an interval begins or the day after one ends. Each
    record leaves its rank in its nodes, where only the highest stays, so a key with any number of records keeps few; each such day then
    asks the nodes that hold it. What is left per key is bounded by its days, not its records, and is shuffled by key once.
    """
    full = records.select(
        *keys, F.col(first).alias("eff_dt"), F.coalesce(F.col(last), F.lit(OPEN_END)).alias("exp_dt"),
        F.struct(*[F.col(c) for c in priority], *[F.col(c) for c in values if c not in priority]).alias("_rank"),
    ).where("eff_dt is not null and eff_dt <= exp_dt")
    rows = durable(full.dropna(subset=list(keys)))
    cells = spread(rows).groupBy(*keys, "_level", "_node").agg(F.max("_rank").alias("_rank"))
    after = F.when(F.col("exp_dt") < F.lit(OPEN_END), F.date_add("exp_dt", 1))
    ends = rows.select(*keys, F.explode(F.array("eff_dt", after)).alias("_day")).where("_day is not null").distinct()
    # What is left of a key is bounded by its days, so cells and days meet by key; a day's copies, one per size, are made behind the shuffle.
    own = cells.withColumn("_own", F.array(F.struct(F.col("_level").alias("level"), F.col("_node").alias("node")))).drop("_level", "_node")
    met = own.unionByName(ends, allowMissingColumns=True).repartition(*keys)
    asked = F.coalesce("_own", cells_of(F.col("_day"), levels_within(rows, "eff_dt", "exp_dt")))
    node = Window.partitionBy(*keys, "_cell.level", "_cell.node")
    told_days = met.withColumn("_cell", F.explode(asked)).withColumn("_rank", F.max("_rank").over(node)).where("_day is not null")
    line = Window.partitionBy(*keys).orderBy("_day")
    parts = told_days.groupBy(*keys, "_day").agg(F.max("_rank").alias("_rank")).withColumn("_next", F.lead("_day").over(line))
    told = F.when(F.col("_rank").isNotNull(), F.struct(*[F.col(f"_rank.{c}").alias(c) for c in values]))
    return coalesced(parts.select(*keys, "_day", "_next", told.alias("_told")), keys, values)


def coalesced(parts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Intervals from the days on which something changes: runs of equal values as one, without the gaps.

    ``parts`` has _day, the first day of the next part (_next, null for none) and _told, null in a gap.
    """
    line = Window.partitionBy(*keys).orderBy("_day")
    new = ~F.col("_told").eqNullSafe(F.lag("_told").over(line)) | (F.row_number().over(line) == 1)
    runs = parts.withColumn("_new", new.cast("int")).withColumn(
        "_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    end = F.coalesce(F.date_sub(F.max_by("_next", "_day"), 1), F.lit(OPEN_END))
    merged = runs.where("_told is not null").groupBy(*keys, "_run").agg(
        F.min("_day").alias("eff_dt"), end.alias("exp_dt"), F.first("_told").alias("_told")
    )
    return merged.select(*keys, "eff_dt", "exp_dt", *[F.col(f"_told.{c}").alias(c) for c in values])


def with_late_records(
    history: DataFrame, late: DataFrame, keys: Sequence[str], values: Sequence[str], priority: Sequence[str]
) -> DataFrame:
    """``history`` (keys, eff_dt, exp_dt, values, without overlaps) with ``late`` records (also with ``priority``) laid over it.

    A late record closes, splits or replaces what it overlaps; among themselves the late records count by priority. Keys without late
    records pass through as they are and are not worked out again, rows without a key too.
    """
    changed = durable(late.select(*keys).distinct())
    kept = history.join(changed, list(keys), "left_anti").select(*keys, "eff_dt", "exp_dt", *values)
    columns = [*keys, "eff_dt", "exp_dt", *values, *priority]
    # Below any late record: null ranks lowest.
    nothing = {c: F.lit(None).cast(late.schema[c].dataType) for c in priority if c not in values}
    old = history.join(changed, list(keys), "left_semi").withColumns(nothing).withColumn("_late", F.lit(0))
    new = late.select(*columns).withColumn("_late", F.lit(1))
    both = old.select(*columns, "_late").unionByName(new)
    return kept.unionByName(resolved(both, keys, values, ["_late", *priority]))


def validity_of_days(history: DataFrame, keys: Sequence[str], until: date) -> DataFrame:
    """One row per key and day of a history, up to ``until``: for checks of small tables."""
    days = F.sequence("eff_dt", F.least("exp_dt", F.lit(until)))
    return history.where(F.col("eff_dt") <= F.lit(until)).withColumn("day", F.explode(days)).drop("eff_dt", "exp_dt")
