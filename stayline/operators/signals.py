"""Time-aware features: leakage-safe windows, sequences, service-risk signal, inactivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions import numbers
from stayline.operators.panel import KEY


def leakage_safe_windows(
    panel: DataFrame,
    disconnects: DataFrame,
    measures: dict[str, Column],
    data_end: Column,
    *,
    observe: int = 3,
    gap: int = 1,
    predict: int = 2,
) -> DataFrame:
    """Features from a line's first months, label from later months, nothing from the gap between.

    Month 1 is the line's first telemetry month. Features are sums over months 1..observe; the
    label says whether the line disconnects in the ``predict`` months after the gap. Lines that
    disconnect earlier are left out: there is nothing to predict for them. So are lines whose last month to
    predict is not complete by ``data_end``, the last day of the data: their outcome is not known yet.

    Panel and disconnects shrink to one row per line and month before anything else, so the
    per-line window sees months only.
    """
    last_gap = observe + gap
    zero = {name: F.lit(0).cast("bigint") for name in measures}
    seen = panel.select(
        *KEY, F.trunc("cpe_date", "MM").alias("month"), F.lit(1).cast("bigint").alias("rows"),
        F.lit(0).cast("bigint").alias("ends"), *[m.alias(n) for n, m in measures.items()],
    )
    ended = disconnects.select(
        *KEY, F.trunc("deact_dt", "MM").alias("month"), F.lit(0).cast("bigint").alias("rows"),
        F.lit(1).cast("bigint").alias("ends"), *[z.alias(n) for n, z in zero.items()],
    )
    sums = ["rows", "ends", *measures]
    months = (
        seen.unionByName(ended)
        .groupBy(*KEY, "month")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    first = F.min(F.when(F.col("rows") > 0, F.col("month"))).over(Window.partitionBy(*KEY))
    index = F.round(F.months_between("month", "first_month")).cast("int") + 1
    placed = months.withColumn("first_month", first).withColumn("idx", index)
    observed = F.col("idx").between(1, observe)
    return (
        placed.groupBy(*KEY, "first_month")
        .agg(
            *[F.sum(F.when(observed, F.col(c))).alias(f"obs_{c}") for c in ["rows", *measures]],
            F.sum(F.when(F.col("idx") <= last_gap, F.col("ends"))).alias("_early"),
            F.max(
                F.when(
                    F.col("idx").between(last_gap + 1, last_gap + predict) & (F.col("ends") > 0), 1
                ).otherwise(0)
            ).alias("label"),
        )
        .where((F.col("obs_rows") > 0) & (F.coalesce(F.col("_early"), F.lit(0)) == 0))
        .where(F.add_months("first_month", last_gap + predict) <= F.date_add(data_end, 1))
        .drop("_early")
    )


def static_as_channel(
    panel: DataFrame, profile: DataFrame, channels: Sequence[str], static: Sequence[str]
) -> DataFrame:
    """Every time step of a line with its position, its channels and the line's static columns."""
    step = F.row_number().over(Window.partitionBy(*KEY).orderBy("cpe_date"))
    steps = panel.select(*KEY, "cpe_date", *channels).withColumn("step", step)
    return steps.join(profile.select(*KEY, *static), list(KEY), "left")


def sequences(steps: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per line: its steps in order as an array (at most one step per calendar day)."""
    cell = F.struct("step", *columns)
    return steps.groupBy(*KEY).agg(F.array_sort(F.collect_list(cell)).alias("steps"))


def cusum(panel: DataFrame, deviation: Column, name: str = "cusum") -> DataFrame:
    """One-sided CUSUM of a whole-number deviation: the running sum, never below zero.

    Written as the running sum minus its lowest value so far (or zero), which two windows over the
    same order give; they share one shuffle and one sort. A line has at most one row per day.
    """
    line = (
        Window.partitionBy(*KEY)
        .orderBy("cpe_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = panel.withColumn("_total", F.sum(deviation).over(line))
    lowest = F.least(F.lit(0).cast("bigint"), F.min("_total").over(line))
    return total.withColumn(name, F.col("_total") - lowest).drop("_total")


def cusum_alarms(panel: DataFrame, deviation: Column, limit: int, rest_days: int = 0) -> DataFrame:
    """One row per alarm of a one-sided CUSUM that starts anew after each: the line, its alarm's number and day, the sum that
    reached ``limit``, and how many days with a deviation it took since the last start.

    A whole-number deviation is added day by day, never below zero; a sum of ``limit`` or more is an alarm and goes back to
    zero. A day without a deviation (null) changes nothing, nor does one without a row. ``rest_days`` are calendar days after an
    alarm whose deviations do not count. What a restart leaves depends on all that came before, so no window can say it: each line's days
    are folded in order, and only its alarms are written. A line has at most one row per day; of a day with several all count, in the
    order of their deviations.
    """
    days = panel.select(*KEY, "cpe_date", deviation.cast("bigint").alias("_d")).where("_d is not null and cpe_date is not null")
    line = days.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("cpe_date", "_d"))).alias("_days"))
    alarm = "array<struct<day: date, peak: bigint, days: bigint>>"
    start = F.struct(
        F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("date").alias("until"),
        F.array().cast(alarm).alias("alarms"),
    )

    def step(state: Column, day: Column) -> Column:
        resting = state["until"].isNotNull() & (day["cpe_date"] <= state["until"])
        total = F.greatest(F.lit(0).cast("bigint"), state["sum"] + day["_d"])
        n, zero = state["n"] + 1, F.lit(0).cast("bigint")
        told = F.array(F.struct(day["cpe_date"].alias("day"), total.alias("peak"), n.alias("days"))).cast(alarm)
        on = F.struct(total.alias("sum"), n.alias("n"), state["until"].alias("until"), state["alarms"].alias("alarms"))
        anew = F.struct(
            zero.alias("sum"), zero.alias("n"), F.date_add(day["cpe_date"], rest_days).alias("until"),
            F.concat(state["alarms"], told).alias("alarms"),
        )
        return F.when(resting, state).when(total >= limit, anew).otherwise(on)

    folded = line.select(*KEY, F.aggregate("_days", start, step)["alarms"].alias("_alarms"))
    return folded.select(*KEY, F.posexplode("_alarms").alias("_i", "_a")).select(
        *KEY, (F.col("_i") + 1).alias("alarm"), F.col("_a.day").alias("alarm_dt"), F.col("_a.peak").alias("peak"), F.col("_a.days").alias("days")
    )


def inactivity_labels(
    days: DataFrame, keys: Sequence[str], day: str, data_end: Column, limit: int = 60
) -> DataFrame:
    """Per active day: days until the next one, and whether the line went quiet for over ``limit``.

    The last active day is judged against the end of the data. If that is too near to tell, the day
    is ``censored`` rather than active. Several rows of a day count once.
    """
    active = days.select(*keys, day).distinct()
    following = F.lead(day).over(Window.partitionBy(*keys).orderBy(day))
    gap = F.datediff(F.coalesce(F.col("next_day"), data_end), F.col(day))
    return (
        active.withColumn("next_day", following)
        .withColumn("gap_days", gap)
        .withColumn("churned", F.when(F.col("gap_days") > limit, 1).otherwise(0))
        .withColumn(
            "censored",
            F.when(F.col("next_day").isNull() & (F.col("gap_days") <= limit), 1).otherwise(0),
        )
    )


def segment_rates(lines: DataFrame, segment: str, label: str = "churned") -> DataFrame:
    """Churn rate per segment and its distance from the overall rate."""
    one = lines.select(segment, F.col(label).cast("bigint").alias("_y"))
    per = one.groupBy(segment).agg(F.count("*").alias("n"), F.sum("_y").alias("n_churned"))
    overall = per.agg(numbers.ratio(F.sum("n_churned"), F.sum("n")).alias("r")).scalar()
    return per.withColumn("rate", numbers.ratio(F.col("n_churned"), F.col("n"))).withColumn(
        "effect", F.col("rate") - overall
    )


def segment_effects(
    lines: DataFrame, segment: str, signal: Column, label: str = "churned"
) -> DataFrame:
    """What a signal tells within each segment: churn rate with it, without it, and the difference.

    A cause that matters in one segment only is diluted in the overall rate.
    """
    on, churned = F.coalesce(signal, F.lit(False)), F.col(label) == 1
    per = lines.groupBy(segment).agg(
        F.count_if(on).alias("n_signal"),
        F.count_if(on & churned).alias("churned_signal"),
        F.count_if(~on).alias("n_quiet"),
        F.count_if(~on & churned).alias("churned_quiet"),
    )
    return per.withColumns(
        {
            "rate_signal": numbers.ratio(F.col("churned_signal"), F.col("n_signal")),
            "rate_quiet": numbers.ratio(F.col("churned_quiet"), F.col("n_quiet")),
        }
    ).withColumn("effect", F.col("rate_signal") - F.col("rate_quiet"))


def lead_time_curve(
    lookback: DataFrame, flagged: Column, gaps: Sequence[int], window: int = 30
) -> DataFrame:
    """Per gap: the share of disconnects a signal would have flagged that many days ahead, and its price.

    ``lookback`` holds the telemetry before each disconnect as far back as the largest gap plus the
    window, and the same before an anchor day of lines that ``stayed``. Flags on those are false alarms; ``precision``
    is the disconnects' part of all flagged. All gaps are answered in one pass over it.
    """
    lead = F.datediff("deact_dt", "cpe_date")
    per_event = lookback.groupBy(*KEY, "deact_dt", "stayed").agg(
        *[
            F.max(F.when(lead.between(g, g + window - 1) & flagged, 1).otherwise(0)).alias(f"f{g}")
            for g in gaps
        ],
        *[
            F.max(F.when(lead.between(g, g + window - 1), 1).otherwise(0)).alias(f"s{g}")
            for g in gaps
        ],
    )
    totals = per_event.agg(
        *[
            F.count_if((F.col(f"{p}{g}") == 1) & (F.col("stayed") == stayed)).alias(f"{p}{g}{n}")
            for g in gaps
            for p in "fs"
            for n, stayed in (("", F.lit(False)), ("q", F.lit(True)))
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(g).alias("gap_days"),
                F.col(f"s{g}").alias("n_observed"),
                F.col(f"f{g}").alias("n_flagged"),
                numbers.ratio(F.col(f"f{g}"), F.col(f"s{g}")).alias("share_flagged"),
                F.col(f"s{g}q").alias("n_stayed"),
                F.col(f"f{g}q").alias("n_false_alarms"),
                numbers.ratio(F.col(f"f{g}"), F.col(f"f{g}") + F.col(f"f{g}q")).alias("precision"),
            )
            for g in gaps
        ]
    )
    return totals.select(F.inline(rows))


def data_end(rows: DataFrame, day: str) -> Column:
    """Last day of the data, as a value usable in other expressions."""
    return rows.agg(F.max(day).alias("last")).scalar()


