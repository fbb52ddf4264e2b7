"""Activity log: filters, line profile, and disconnects joined to the activations before them.

Inputs follow ``sources.contracts`` (codes already normalised). Lines are keyed by
``(cust_id, mtn)`` towards the profile and ``(cust_id, cust_line_seq_id)`` towards histories.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from stayline.functions import codes, dates
from stayline.operators.history import date_span, scd2_join

LINE = ("cust_id", "cust_line_seq_id")
NUMBER = ("cust_id", "mtn")
# What the first activation is taken per, beside the customer and the disconnect. The report of latest
# disconnects leaves out activation code and plan description.
ACTIVATION_KEYS = (
    "segment", "mtn", "price_plan_cd", "acct_num", "act_cd", "pplan_desc", "technology",
)
LATEST_KEYS = ("segment", "mtn", "price_plan_cd", "acct_num", "technology")


def eligible() -> Column:
    """Post-paid, revenue-generating, company-managed, and not a test line."""
    return (
        (F.col("prepaid_ind") == "N")
        & (F.col("rev_gen_ind") == "Y")
        & (F.col("managed_ind") == "C")
        & (F.col("line_type_cd") != "T")
    )


def disconnects(
    activity: DataFrame,
    cutoff: date,
    sub_types: Sequence[str] | None = codes.FIXED_WIRELESS_SUB_TYPES,
    date_column: str = "activity_dt",
) -> DataFrame:
    """Disconnect events since the cut-off, as ``deact_dt`` and ``deact_cd``."""
    rows = activity.where(
        F.col("activity_cd").isin(*codes.DISCONNECT_CODES) & (F.col(date_column) >= F.lit(cutoff))
    )
    if sub_types is not None:
        rows = rows.where(codes.code_in(F.col("coe_pplan_sub_type_desc"), sub_types))
    return rows.withColumnsRenamed({"activity_dt": "deact_dt", "activity_cd": "deact_cd"})


def activations(
    activity: DataFrame, cutoff: date, date_column: str = "activity_dt"
) -> DataFrame:
    """First activations and reactivations of eligible lines since the cut-off."""
    return activity.where(
        F.col("activity_cd").isin(*codes.ACTIVATION_CODES)
        & (F.col(date_column) >= F.lit(cutoff))
        & eligible()
    )


def in_scope(activity: DataFrame, cutoff: date) -> DataFrame:
    """Fixed-wireless rows reported or dated since the cut-off."""
    return activity.where(
        ((F.col("rpt_mth") >= F.lit(cutoff)) | (F.col("activity_dt") >= F.lit(cutoff)))
        & codes.code_in(F.col("coe_pplan_sub_type_desc"), codes.FIXED_WIRELESS_SUB_TYPES)
    )


def with_profile(
    rows: DataFrame, profile: DataFrame, columns: Sequence[str], *, bucket_channel: bool = True
) -> DataFrame:
    """Left join of the line profile. Every row stays; a hot customer's partition is split by AQE.

    No broadcast hint: the profile grows with the customers, so Spark decides from its real size.
    """
    right = profile.select(*NUMBER, *columns)
    if bucket_channel and "chnl_nm" in columns:
        right = right.withColumn("chnl_nm", codes.channel_bucket(F.col("chnl_nm")))
    return rows.join(right, list(NUMBER), "left")


def distinct_profile(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The profile reduced to distinct combinations of the wanted columns."""
    return profile.select(*NUMBER, *columns).distinct()


def activation_disconnect_pairs(activated: DataFrame, ended: DataFrame) -> DataFrame:
    """Activations matched with disconnects of the same number, in factored form.

    Within a number every activation pairs with every disconnect, whatever their dates. Writing the
    pairs out squares a busy line, so each disconnect day carries the number of its pairs and the
    first and last activation instead. Both sides are summed up before they meet.
    """
    left = activated.groupBy(*NUMBER, "activity_cd").agg(
        F.count("*").alias("n_activations"),
        F.min("activity_dt").alias("first_activity_dt"),
        F.max("activity_dt").alias("last_activity_dt"),
    )
    right = ended.groupBy(*NUMBER, "deact_dt", "deact_cd").agg(F.count("*").alias("n_disconnects"))
    return left.join(right, list(NUMBER)).withColumn(
        "n_pairs", F.col("n_activations") * F.col("n_disconnects")
    )


def churned_lines(
    activated: DataFrame, ended: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Disconnects of numbers that also have an activation, each row once, with the number of
    activations and the first and last of them. This is the table the lookback starts from."""
    left = ended.select(*NUMBER, "deact_dt", "deact_cd", *columns).distinct()
    right = activated.groupBy(*NUMBER).agg(
        F.count("*").alias("n_activations"),
        F.min("activity_dt").alias("first_activity_dt"),
        F.max("activity_dt").alias("last_activity_dt"),
    )
    return left.join(right, list(NUMBER))


def first_activation_before(
    activated: DataFrame,
    ended: DataFrame,
    activation_columns: Sequence[str],
    disconnect_columns: Sequence[str],
    *,
    by_line: bool = True,
) -> DataFrame:
    """Earliest activation before each disconnect of the line, per combination of the columns.

    ``by_line`` keeps a customer's lines apart; without it the result has one row per customer and columns,
    whichever line they come from.

    The earliest activation before a date is the earliest of all if that one lies before the date,
    and there is none otherwise. So activations shrink to one row per combination before the join,
    and a line's events are never paired one by one.
    """
    firsts = activated.groupBy(*LINE, *activation_columns).agg(F.min("activity_dt").alias("act_dt"))
    ends = ended.select(*LINE, *disconnect_columns).distinct()
    pairs = firsts.join(ends, list(LINE)).where(F.col("deact_dt") > F.col("act_dt"))
    if by_line:
        return pairs
    keys = [LINE[0], *activation_columns, *disconnect_columns]
    return pairs.groupBy(*keys).agg(F.min("act_dt").alias("act_dt"))


def eligible_by_history_or_plan(
    activity: DataFrame, network_history: DataFrame, span: tuple[Column, Column] | None = None
) -> DataFrame:
    """Rows on an eligible plan, or whose line was on the fixed network the day after.

    Rows the plan already admits need no join. The others are kept by a semi join, so overlapping
    histories cannot multiply them.
    """
    by_plan = F.coalesce(
        codes.code_in(F.col("coe_pplan_sub_type_desc"), codes.ELIGIBLE_SUB_TYPES), F.lit(False)
    )
    valid = network_history.where(
        codes.code_is(F.col("active_ind"), "Y")
        & codes.code_is(F.col("network_type"), codes.NETWORK_TYPE)
    )
    rest = activity.where(~by_plan).withColumn("at_dt", F.date_add("activity_dt", 1))
    by_history = scd2_join(rest, valid, LINE, at="at_dt", how="left_semi", span=span)
    return activity.where(by_plan).unionByName(by_history.drop("at_dt"))


def with_segment(
    activity: DataFrame,
    line_dimensions: DataFrame,
    segments: DataFrame,
    dim_name: str,
    span: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Segment valid at the end of the activity's month, or the default segment."""
    named = line_dimensions.where(codes.code_is(F.col("dim_name"), dim_name)).select(
        *LINE, "eff_dt", "exp_dt", "dim_value"
    )
    current = segments.where(codes.code_is(F.col("curr_prev_ind"), "C")).select(
        F.col("segmt_cd").alias("dim_value"), "segmt_ctgry_desc"
    )
    rows = activity.withColumn("month_end_dt", dates.month_end(F.col("activity_dt")))
    return (
        scd2_join(rows, named, LINE, at="month_end_dt", how="left", span=span)
        .join(current, "dim_value", "left")
        .withColumn(
            "segment", F.coalesce(F.col("segmt_ctgry_desc"), F.lit(codes.DEFAULT_SEGMENT))
        )
        .drop("month_end_dt", "eff_dt", "exp_dt", "dim_value", "segmt_ctgry_desc")
    )


def with_technology(
    activity: DataFrame, price_plans: DataFrame, *, short_names: bool = False
) -> DataFrame:
    plans = price_plans.select(
        "pplan_cd",
        "coe_pplan_type_desc",
        F.col("coe_pplan_sub_type_desc").alias("plan_sub_type"),
    )
    return (
        activity.join(plans, "pplan_cd", "left")
        .withColumn(
            "technology",
            codes.technology_bucket(
                F.col("pplan_cd"),
                F.col("coe_pplan_type_desc"),
                F.col("plan_sub_type"),
                short_names=short_names,
            ),
        )
        .drop("coe_pplan_type_desc", "plan_sub_type")
    )


def enriched_disconnects(
    activity: DataFrame,
    *,
    cutoff: date,
    as_of: date,
    price_plans: DataFrame,
    network_history: DataFrame,
    line_dimensions: DataFrame,
    account_history: DataFrame,
    segments: DataFrame,
    segment_dimension: str,
    change_reasons: DataFrame,
    activity_names: DataFrame,
    profile: DataFrame,
    only_segment: str | None = None,
    short_names: bool = False,
    keep_other: bool = False,
    activation_columns: Sequence[str] = ACTIVATION_KEYS,
) -> DataFrame:
    """Disconnects with first activation, segment, technology, reason, tenure and install data.

    Lines of an unknown or other technology are left out, unless ``keep_other``. The first activation is taken per
    customer, disconnect and ``activation_columns``.
    """
    span = date_span(activity, "activity_dt")
    started = activations(activity, cutoff, date_column="rpt_mth")
    started = eligible_by_history_or_plan(started, network_history, span)
    started = with_segment(started, line_dimensions, segments, segment_dimension, span)
    if only_segment is not None:
        started = started.where(F.col("segment") == only_segment)
    started = with_technology(started, price_plans, short_names=short_names)
    if not keep_other:
        # Technology is part of the grouping below, so the rows can go before the joins.
        started = started.where(codes.code_is_not(F.col("technology"), "Other"))
    started = started.select(
        *LINE, "segment", "mtn", F.col("pplan_cd").alias("price_plan_cd"), "acct_num",
        F.col("activity_cd").alias("act_cd"),
        F.col("coe_pplan_sub_type_desc").alias("pplan_desc"), "technology", "activity_dt",
    )
    ended = disconnects(activity, cutoff, sub_types=None, date_column="rpt_mth")
    lines = first_activation_before(
        started,
        ended,
        activation_columns,
        ["deact_dt", "deact_cd", "eqp_prod_nm", "change_reas_cd"],
        by_line=False,
    )
    known = scd2_join(
        lines, account_history, ("cust_id", "acct_num"), at="act_dt", how="inner", span=span
    ).drop("eff_dt", "exp_dt")
    names = activity_names.select(F.col("activity_cd").alias("deact_cd"), "activity_desc")
    installs = distinct_profile(profile, ["chnl_nm", "install_type", "sales_dt", "install_dt"])
    return (
        known.join(change_reasons, "change_reas_cd", "left")
        .join(names, "deact_cd", "left")
        .join(installs, list(NUMBER), "left")
        .withColumns(
            {
                "deact_mth": dates.month_start(F.col("deact_dt")),
                "act_mth": dates.month_start(F.col("act_dt")),
                "days_on": dates.days_on(F.col("act_dt"), F.col("deact_dt"), as_of),
                "disco_reason": codes.disconnect_reason(
                    F.col("change_reas_ctgry_cd"), F.col("change_reas_desc")
                ),
                "chnl_nm": codes.channel_bucket(F.col("chnl_nm")),
            }
        )
    )


def one_row_per_line(profile: DataFrame, keys: Sequence[str] = NUMBER) -> DataFrame:
    """The profile with one row per line: of several, the smallest by its columns in order, nulls first."""
    rest = [c for c in profile.columns if c not in keys]
    return profile.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_p")).select(*keys, "_p.*")


def latest_disconnects(lines: DataFrame) -> DataFrame:
    """Rows of each number's latest disconnect day, ties kept, then without other technologies.

    The order matters: a number whose latest disconnect is of another technology is left out.

    Every task first keeps only its own top rows of a number, so little reaches the shuffle.
    """
    newest = Window.partitionBy(*NUMBER).orderBy(F.col("deact_dt").desc_nulls_last())
    last = lines.withColumn("_rank", F.rank().over(newest)).where("_rank = 1").drop("_rank")
    return last.where(codes.code_is_not(F.col("technology"), "Other"))
