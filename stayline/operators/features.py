"""Feature table, design matrix, imputation, balancing and splitting."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions import codes, hashing, numbers
from stayline.operators import panel as panels
from stayline.operators.activity import one_row_per_line
from stayline.operators.ranking import hash_rank
from stayline.session import durable

# ---- Fixed values: keys, scores and category levels of the model's input ---------------------
CATEGORIES = (
    "mdn_5g", "cust_id", "cust_line_seq_id", "pplan_cd", "eqp_prod_nm",
    "coe_pplan_sub_type_desc", "market_type", "order_fulfilment", "churn_label",
)
MODEL_SCORES = (
    "scaled_5g_uptime",
    "scaled_sqrt_data_usage",
    "scaled_uploadresult",
    "scaled_downloadresult",
    "scaled_latency",
    "scaled_RSRP",
    "scaled_avg_CQI",
    "scaled_SNR",
    "scaled_switch_count_sum",
    "scaled_reset_count",
    "scaled_avg_MemoryPercentFree",
    "scaled_percentageReceived",
)
LEVELS = {
    "eqp_prod_nm": ("ARC-XCI55AX", "WNC-CR200A", "ASK-NCQ1338FA", "FSNO21VA", "others"),
    "coe_pplan_sub_type_desc": (
        "5G Business Internet", "5G Home mmWave", "5G Home C-Band", "4G LTE Home",
    ),
    "market_type": ("East", "South", "West", "Headquarters", "unknown"),
    "order_fulfilment": ("LOCALLY_FULFILLED", "SHIPPED", "unknown"),
}
# ---- End of fixed values --------------------------------------------------------------------
LABEL = "churn_label"
LINE_COLUMNS = (*CATEGORIES[:-1], "acct_num")


def level_column(column: str, level: str) -> str:
    return f"{column}_{level}"


def one_hot_columns(levels: dict[str, Sequence[str]] = LEVELS) -> list[str]:
    return [level_column(c, v) for c, values in levels.items() for v in values]


def tidy_categories(df: DataFrame, keep: Sequence[str] = codes.KEPT_DEVICES) -> DataFrame:
    """Merge the plan types and rare devices, and name what is missing."""
    return df.withColumns(
        {
            "eqp_prod_nm": codes.device_bucket(F.col("eqp_prod_nm"), keep),
            "coe_pplan_sub_type_desc": codes.known(
                codes.plan_bucket(F.col("coe_pplan_sub_type_desc"))
            ),
            "market_type": codes.known(F.col("market_type")),
            "order_fulfilment": codes.known(F.col("order_fulfilment")),
        }
    )


def label_panels(
    stayed: DataFrame, churned: DataFrame, columns: Sequence[str] = (*LINE_COLUMNS, *MODEL_SCORES)
) -> DataFrame:
    """Two stored panels as one, labelled N and Y."""
    return stayed.select(*columns, F.lit("N").alias(LABEL)).unionByName(
        churned.select(*columns, F.lit("Y").alias(LABEL))
    )


def score_means(
    labelled: DataFrame, scores: Sequence[str] = MODEL_SCORES, signals: Sequence[str] = ()
) -> DataFrame:
    """One row per line (and label, plan, device, place) with the mean of each score.

    ``signals`` are first-stage columns, kept as the line's peak. The account number is an
    identifier; its mean is kept under its name for those who want it, but the model leaves it out
    unless asked. ``row_key`` identifies a row even after categories are merged.
    """
    means = labelled.groupBy(*CATEGORIES).agg(
        *[numbers.mean_2dp(F.col(s)).alias(s) for s in scores],
        numbers.mean_of_whole(F.col("acct_num").try_cast("bigint")).alias("acct_num"),
        *[F.max(s).alias(s) for s in signals],
        F.count("*").alias("n_days"),
    )
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("?")) for c in CATEGORIES])
    return means.withColumn("row_key", F.md5(key))


def feature_table(
    activity: DataFrame,
    profile: DataFrame,
    disconnects: DataFrame,
    panel: DataFrame,
    *,
    churn_after: date,
    days: int = 30,
    salt: str = "days",
    scores: Sequence[str] = MODEL_SCORES,
    signals: Sequence[str] = (),
    equal_windows: bool = False,
    least_days: int = 1,
) -> DataFrame:
    """One labelled row per line: ``days`` random days of lines that stayed, and the open lookback
    of lines disconnected after ``churn_after``.

    Only telemetry of the days that the lookbacks before all ``disconnects`` span is read, for both
    kinds of lines. They are put into one stored table of targets first, so the telemetry is shuffled once, by
    line, and only that of targets. Sampling and the means are grouped by line as well and need no further shuffle. A target's open
    lookback has fewer than ``days`` days, so one limit of ``days`` days per target serves both kinds, and
    Spark applies it before it sorts. Rows of one day stay together, however many ``panel`` has, and count each in
    the means. Of several profile rows of a line the smallest counts.

    ``equal_windows`` gives lines that stayed a window like that of the others instead of random days: the
    ``days`` before an anchor day, drawn among the line's own days, and both kinds need ``least_days`` days.
    """
    line = [c for c in LINE_COLUMNS if c not in (*panels.KEY, "market_type", "order_fulfilment")]
    ended = (
        disconnects.where((F.col("deact_cd") == "DE") & (F.col("deact_dt") > F.lit(churn_after)))
        .select(*panels.KEY, *line, "deact_dt")
        .distinct()
        .withColumn(LABEL, F.lit("Y"))
    )
    stable = panels.stable_lines(activity, line).withColumns(
        {"deact_dt": F.lit(None).cast("date"), LABEL: F.lit("N")}
    )
    places = one_row_per_line(
        profile.select(*panels.KEY, "market_type", "order_fulfilment"), panels.KEY
    )
    seen = panels.scan_range(panel, panels.lookback_bounds(disconnects, days))
    if equal_windows:
        stable = stable.drop("deact_dt").join(panels.anchor_days(seen, salt), list(panels.KEY))
    targets = durable(stable.unionByName(ended).join(places, list(panels.KEY), "left"))

    # Rows of other lines go first: Spark filters the tables that a panel is made of, before they are shuffled for its sums.
    wanted = seen.join(targets.select(*panels.KEY), list(panels.KEY), "left_semi")
    rows = wanted.select("cpe_date", *panels.KEY, *scores, *signals).join(targets, list(panels.KEY))
    in_window = (F.col("cpe_date") > F.date_sub("deact_dt", days)) & (
        F.col("cpe_date") < F.col("deact_dt")
    )
    rows = rows.where(F.col("deact_dt").isNull() | in_window)
    target = [*panels.KEY, LABEL, "deact_dt", *line]
    rows = rows.withColumn("_place", panels.random_place(salt, target, panels.KEY, shared=True))
    rows = rows.where(F.col("_place") <= days)
    means = score_means(rows, scores, signals)
    if least_days > 1:
        means = means.where(F.col("n_days") >= least_days)
    return tidy_categories(means.drop("n_days"))


def one_hot(
    df: DataFrame,
    keep: Sequence[str],
    levels: dict[str, Sequence[str]] = LEVELS,
    label: str = LABEL,
) -> DataFrame:
    """Declared 0/1 columns beside ``keep`` and a 0/1 label; an undeclared level is all zeros."""
    flags = [
        F.when(F.col(c) == v, 1).otherwise(0).alias(level_column(c, v))
        for c, values in levels.items()
        for v in values
    ]
    target = F.when(F.col(label) == "Y", 1).when(F.col(label) == "N", 0).alias(label)
    return df.select(*keep, *flags, target)


def impute_hot_deck(
    df: DataFrame, column: str, keys: Sequence[str], salt: str, fit_on: DataFrame | None = None
) -> DataFrame:
    """Fill each missing value with that of a randomly drawn donor row (donors may repeat).

    Donors come from ``fit_on``, the training rows, or without it from the whole table. NaN and infinity are missing.

    Donors are numbered in hash order; a row in need draws a number from its own hash. With no
    donors at all values stay missing. The table is read several times: pass a stored one. When most rows need one of few donors, AQE either
    broadcasts the donors (by their real size) or splits the crowded partitions.
    """
    df = df.withColumn(column, numbers.finite(F.col(column)))
    source = df if fit_on is None else fit_on.withColumn(column, numbers.finite(F.col(column)))
    given = source.where(F.col(column).isNotNull()).select(*keys, column)
    donors = hash_rank(given, keys, salt, name="_donor").select(
        "_donor", F.col(column).alias("_value")
    )
    n = source.agg(F.count(column).alias("n")).scalar()
    draw = F.pmod(hashing.hash_int(salt, keys), F.nullif(n, F.lit(0).cast("bigint"))) + 1
    complete = df.where(F.col(column).isNotNull())
    filled = (
        df.where(F.col(column).isNull())
        .withColumn("_donor", draw)
        .join(donors, "_donor", "left")
        .withColumn(column, F.col("_value"))
        .select(*df.columns)
    )
    return complete.unionByName(filled)


def impute_mean(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill missing values with the column's mean, taken over ``fit_on`` (the training rows) or,
    without it, over the whole table. The means come from exact sums. NaN and infinity are missing."""
    source = df if fit_on is None else fit_on
    means = source.agg(
        F.struct(*[numbers.mean(F.col(c)).alias(c) for c in columns]).alias("means")
    ).scalar()
    return df.withColumns({c: F.coalesce(numbers.finite(F.col(c)), means[c]) for c in columns})


def balance_classes(
    df: DataFrame, keys: Sequence[str], label: str = LABEL, salt: str = "balance"
) -> DataFrame:
    """Every class cut to the size of the smallest by random choice without replacement.

    Exact sizes: rows are ranked per class in hash order, without sorting a class in one task.
    Rows without a label belong to no class.
    """
    df = df.where(F.col(label).isNotNull())
    smallest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).scalar()
    ranked = hash_rank(df, keys, salt, within=[label], name="_rank")
    return ranked.where(F.col("_rank") <= smallest).drop("_rank")


def split_train_test(
    df: DataFrame, keys: Sequence[str], test_share: float = 0.3, salt: str = "split"
) -> DataFrame:
    """``is_test`` by hash of the key: a line stays on its side in every run and every table."""
    return df.withColumn("is_test", hashing.below_share(salt, keys, test_share))
