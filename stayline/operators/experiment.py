"""What retention offers achieved: holdout, shadow sample, outcomes and business figures.

Lines carry ``predicted`` and ``churned`` (0/1), ``revenue_cents`` and ``cost_cents`` (the offer).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions import hashing
from stayline.functions.numbers import ratio

TREATED, CONTROL = "treated", "control"


def assign_holdout(
    lines: DataFrame, keys: Sequence[str], control_share: float, experiment: str
) -> DataFrame:
    """Predicted churners split at random into control and treated; the rest have no arm.

    The experiment's name salts the hash: arms are stable within it and independent across them.
    """
    control = hashing.below_share(experiment, keys, control_share)
    arm = F.when(F.col("predicted") == 1, F.when(control, CONTROL).otherwise(TREATED))
    return lines.withColumn("arm", arm)


def _per_arm(lines: DataFrame) -> DataFrame:
    """One row with counts, churners and money of both arms."""
    cells = []
    for arm in (TREATED, CONTROL):
        here = F.col("arm") == arm
        cells += [
            F.count_if(here).alias(f"n_{arm}"),
            F.count_if(here & (F.col("churned") == 1)).alias(f"churned_{arm}"),
            F.coalesce(F.sum(F.when(here, F.col("revenue_cents"))), F.lit(0)).alias(f"rev_{arm}"),
            F.coalesce(
                F.sum(F.when(here & (F.col("churned") == 1), F.col("revenue_cents"))), F.lit(0)
            ).alias(f"lost_{arm}"),
        ]
    promo = F.coalesce(F.sum(F.when(F.col("arm") == TREATED, F.col("cost_cents"))), F.lit(0))
    return lines.agg(*cells, promo.alias("promo_cents"))


def holdout_lift(lines: DataFrame) -> DataFrame:
    """Churn rate of both arms, their difference, and the relative reduction."""
    rates = _per_arm(lines).select(
        "n_treated", "n_control", "churned_treated", "churned_control",
        ratio(F.col("churned_treated"), F.col("n_treated")).alias("rate_treated"),
        ratio(F.col("churned_control"), F.col("n_control")).alias("rate_control"),
    )
    difference = F.col("rate_control") - F.col("rate_treated")
    return rates.withColumn("rate_difference", difference).withColumn(
        "relative_lift",
        F.when(F.col("rate_control") > 0, F.col("rate_difference") / F.col("rate_control")),
    )


def outcome_taxonomy(lines: DataFrame) -> DataFrame:
    """Lines and revenue by what happened after the prediction.

    A treated line that stayed may be saved or a false alarm; only the control arm can tell them
    apart, so it has a class of its own.
    """
    predicted, churned = F.col("predicted") == 1, F.col("churned") == 1
    treated = F.col("arm") == TREATED
    outcome = (
        F.when(predicted & treated & ~churned, "stayed after offer")
        .when(predicted & treated & churned, "lost despite offer")
        .when(predicted & ~treated & churned, "confirmed churner")
        .when(predicted & ~treated & ~churned, "false alarm")
        .when(~predicted & churned, "missed churner")
        .otherwise("quiet")
    )
    return lines.groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("n"), F.sum("revenue_cents").alias("revenue_cents")
    )


def retention_kpis(lines: DataFrame) -> DataFrame:
    """Churn reduction, customers saved, revenue retained, cost per save, lift, ROI, net savings.

    What the treated arm would have lost untreated is its revenue times the control arm's loss
    share.
    """
    base = _per_arm(lines).select(
        "*",
        ratio(F.col("churned_treated"), F.col("n_treated")).alias("tr"),
        ratio(F.col("churned_control"), F.col("n_control")).alias("cr"),
        (
            ratio(F.col("lost_control"), F.col("rev_control")) * F.col("rev_treated").cast("double")
        ).alias("expected_loss"),
    )
    retained = F.col("expected_loss") - F.col("lost_treated").cast("double")
    out = base.select(
        (F.col("cr") - F.col("tr")).alias("net_churn_reduction"),
        ((F.col("cr") - F.col("tr")) * F.col("n_treated").cast("double")).alias("saved_customers"),
        (retained / F.lit(100.0)).alias("revenue_retained"),
        (F.col("promo_cents").cast("double") / F.lit(100.0)).alias("promo_cost"),
        F.when(F.col("cr") > 0, (F.col("cr") - F.col("tr")) / F.col("cr")).alias("lift"),
    )
    return out.select(
        "*",
        F.when(F.col("saved_customers") > 0, F.col("promo_cost") / F.col("saved_customers")).alias(
            "cost_per_saved"
        ),
        (F.col("revenue_retained") - F.col("promo_cost")).alias("net_savings"),
        F.when(
            F.col("promo_cost") > 0,
            (F.col("revenue_retained") - F.col("promo_cost")) / F.col("promo_cost"),
        ).alias("roi"),
    )


def shadow_tracking(
    lines: DataFrame, keys: Sequence[str], cycle: str, share: float, salt: str
) -> DataFrame:
    """Outcomes of a small untreated sample of predicted churners per billing cycle.

    ``drift`` compares each cycle's churn rate, the model's precision without intervention, with
    the first cycle's. One row per cycle reaches the window.
    """
    shadow = lines.where(F.col("predicted") == 1).where(hashing.below_share(salt, keys, share))
    per = shadow.groupBy(cycle).agg(
        F.count("*").alias("n"), F.count_if(F.col("churned") == 1).alias("n_churned")
    )
    rated = per.withColumn("rate", ratio(F.col("n_churned"), F.col("n")))
    base = F.first("rate").over(Window.orderBy(cycle))
    return rated.withColumn("drift", F.col("rate") - base)


REPLICATES = 200
#: Poisson(1): how many of these a uniform number in [0, 2^32) reaches is its weight. Cut at 12, beyond which 6e-11 lies.
POISSON = tuple(
    int(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)
)


def replicate_weights(lines: DataFrame, keys: Sequence[str], replicates: int, salt: str) -> DataFrame:
    """``lines`` once per replicate it is drawn in, with ``replicate`` (from 0) and ``weight``, how often it is drawn.

    Weights have a Poisson distribution of mean 1, which is what drawing as many lines with replacement comes to. Each comes from a hash
    of the line and the replicate, so a line weighs the same wherever and whenever it is read. One hash serves four replicates.
    """
    blocks = lines.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))))
    hashed = blocks.withColumn("_h", hashing.digest(salt, [*keys, "_b"]))
    each = hashed.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    draw = F.conv(F.substring("_h", F.col("_i") * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
    reached = [F.when(F.col("_u") >= t, 1).otherwise(0) for t in POISSON]
    weight = reached[0]
    for r in reached[1:]:
        weight = weight + r
    drawn = each.withColumns({"replicate": F.col("_b") * 4 + F.col("_i"), "_u": draw}).withColumn("weight", weight)
    return drawn.where((F.col("replicate") < replicates) & (F.col("weight") > 0)).drop("_b", "_h", "_i", "_u")


def lift_replicates(lines: DataFrame, keys: Sequence[str], replicates: int = REPLICATES, salt: str = "bootstrap") -> DataFrame:
    """(replicate, rate_treated, rate_control, rate_difference) of redrawn lines; null where an arm has no line.

    One pass: a task adds up its lines by replicate and arm, twice as many sums as replicates, before anything is shuffled.
    """
    drawn = replicate_weights(lines.where(F.col("arm").isNotNull()), keys, replicates, salt)
    cells = []
    for arm in (TREATED, CONTROL):
        own = F.when(F.col("arm") == arm, F.col("weight"))
        cells += [F.sum(own).alias(f"_n_{arm}"), F.sum(F.when(F.col("churned") == 1, own)).alias(f"_y_{arm}")]
    per = drawn.groupBy("replicate").agg(*cells)

    def rate(arm: str) -> Column:
        return F.try_divide(F.coalesce(f"_y_{arm}", F.lit(0)).cast("double"), F.col(f"_n_{arm}").cast("double"))

    rated = per.select("replicate", rate(TREATED).alias("rate_treated"), rate(CONTROL).alias("rate_control"))
    return rated.withColumn("rate_difference", F.col("rate_control") - F.col("rate_treated"))


def lift_interval(
    lines: DataFrame, keys: Sequence[str], replicates: int = REPLICATES, level: float = 0.95, salt: str = "bootstrap"
) -> DataFrame:
    """One row: (n_replicates, low, median, high, share_positive) of the replicates' rate differences.

    The points are order statistics, the smallest value with at least its share of replicates at or below it. Replicates without a line
    in an arm do not count. All null without lines.
    """
    found = lift_replicates(lines, keys, replicates, salt).where("rate_difference is not null")
    # As many values as replicates.
    rows = found.agg(F.array_sort(F.collect_list("rate_difference")).alias("_x")).withColumn("n_replicates", F.size("_x").cast("bigint"))

    def point(share: float) -> Column:
        place = F.greatest(F.lit(1), F.ceil(F.col("n_replicates") * share - 1e-9)).cast("int")
        return F.when(F.col("n_replicates") > 0, F.get("_x", place - 1))

    tail = (1 - level) / 2
    positive = F.size(F.filter("_x", lambda x: x > 0))
    return rows.select(
        "n_replicates", point(tail).alias("low"), point(0.5).alias("median"), point(1 - tail).alias("high"),
        F.try_divide(positive.cast("double"), F.col("n_replicates").cast("double")).alias("share_positive"),
    )
