"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions import codes, dates, hashing, numbers
from stayline.operators import (
    activity as acts,
    drift,
    evaluate,
    experiment,
    features,
    history,
    incremental,
    intervals,
    panel as panels,
    permutation,
    segment_models as local,
    signals,
    subgroups,
    survival,
)
from stayline.operators.preparation import Preparation, PreparationModel
from stayline.plans import jobs
from stayline.plans import standins as st
from stayline.session import durable, scratch_path, tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TRAINING = ("rf_train_score", "rf_evaluation", "feature_importance")  # slow: a forest is trained
PROFILE_SHORT = list(jobs.SHORT_PROFILE)


def register(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(tune(spark), folder)

    QUERIES[query.__name__] = run
    return query


# ---- codes and filters ------------------------------------------------------------------------


@register
def normalise_keys(spark, d):
    rows = st.activity(spark, d)
    return rows.select(
        "cust_id", "cust_line_seq_id", "mdn_5g", codes.phone_number(F.col("mtn"), 3).alias("mtn3"),
        "activity_dt", "activity_cd", "pplan_cd", F.col("acct_num").try_cast("bigint").alias("acct"),
    )


@register
def activity_filter(spark, d):
    rows = st.activity(spark, d)
    started = acts.activations(rows, st.CUTOFF).select(
        "cust_id", "mdn_5g", "activity_dt", "activity_cd"
    )
    ended = acts.disconnects(rows, st.CUTOFF).select(
        "cust_id", "mdn_5g", F.col("deact_dt").alias("activity_dt"),
        F.col("deact_cd").alias("activity_cd"),
    )
    return started.unionByName(ended)


@register
def coded_dates(spark, d):
    """Events since a cut-off given as (year - 1900)MMDD, their days read back from codes of that kind."""
    day = F.col("activity_dt")
    code = (F.year(day) - 1900) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
    rows = st.activity(spark, d).select("cust_id", "mdn_5g", code.alias("day_code"))
    decoded = rows.withColumn("activity_dt", dates.date_of_code(F.col("day_code")))
    return decoded.where(F.col("activity_dt") >= F.lit(dates.decode_cutoff(960101)))


@register
def channel_bucket(spark, d):
    rows = st.profile(spark, d)
    return rows.select("cust_id", "mtn", codes.channel_bucket(F.col("chnl_nm")).alias("channel"))


@register
def technology_bucket(spark, d):
    rows = st.activity(spark, d).select("cust_id", "activity_dt", "pplan_cd")
    long = acts.with_technology(rows, st.price_plans(spark))
    both = acts.with_technology(
        long.withColumnRenamed("technology", "tech_long"), st.price_plans(spark), short_names=True
    ).withColumnRenamed("technology", "tech_short")
    return both.groupBy("pplan_cd", "tech_long", "tech_short").agg(
        F.count("*").alias("n"), F.max("activity_dt").alias("last_dt")
    )


@register
def disco_reason(spark, d):
    ended = acts.disconnects(st.activity(spark, d), st.CUTOFF)
    return ended.join(st.change_reasons(spark), "change_reas_cd", "left").select(
        "cust_id", "mdn_5g", "deact_dt", "deact_cd", "change_reas_cd",
        codes.disconnect_reason(F.col("change_reas_ctgry_cd"), F.col("change_reas_desc")).alias(
            "disco_reason"
        ),
    )


@register
def plan_bucket(spark, d):
    rows = st.activity(spark, d)
    plan = codes.known(codes.plan_bucket(F.col("coe_pplan_sub_type_desc")))
    return rows.groupBy(plan.alias("plan")).agg(F.count("*").alias("n"))


@register
def device_model_bucket(spark, d):
    keep = ["ring", "bolt", "widget", "gear"]
    return st.table(spark, d, "part").select(
        "p_partkey", codes.device_bucket(F.col("p_name"), keep).alias("device")
    )


@register
def tenure_days(spark, d):
    rows = st.activity(spark, d)
    lines = rows.groupBy("cust_id", "mdn_5g").agg(
        F.min(F.when(F.col("activity_cd").isin("AC", "RE"), F.col("activity_dt"))).alias("act_dt"),
        F.max(F.when(F.col("activity_cd").isin("DE", "D3"), F.col("activity_dt"))).alias(
            "deact_dt"
        ),
    )
    return lines.select(
        "cust_id", "mdn_5g", "act_dt", "deact_dt",
        dates.month_start(F.col("act_dt")).alias("act_mth"),
        dates.month_end(F.col("act_dt")).alias("act_mth_end"),
        dates.days_on(F.col("act_dt"), F.col("deact_dt"), st.AS_OF).cast("bigint").alias("days_on"),
    )


# ---- joins -----------------------------------------------------------------------------------


@register
def activation_deactivation_pairs(spark, d):
    rows = st.activity(spark, d)
    return acts.activation_disconnect_pairs(
        acts.activations(rows, st.CUTOFF), acts.disconnects(rows, st.CUTOFF)
    )


@register
def churn_table(spark, d):
    rows = st.activity(spark, d)
    ended = acts.churned_lines(
        acts.activations(rows, st.CUTOFF),
        acts.disconnects(rows, st.CUTOFF),
        jobs.DISCONNECT_COLUMNS,
    )
    return acts.with_profile(ended, st.profile(spark, d), PROFILE_SHORT)


@register
def first_activation_before_disconnect(spark, d):
    rows = st.activity(spark, d)
    return acts.first_activation_before(
        acts.activations(rows, st.CUTOFF, "rpt_mth"),
        acts.disconnects(rows, st.CUTOFF, sub_types=None, date_column="rpt_mth"),
        ["mtn", "pplan_cd", "acct_num", "activity_cd", "coe_pplan_sub_type_desc"],
        ["deact_dt", "deact_cd", "eqp_prod_nm", "change_reas_cd"],
    )


@register
def line_profile_left_join(spark, d):
    rows = acts.in_scope(st.activity(spark, d), st.CUTOFF).select(
        "cust_id", "cust_line_seq_id", "mtn", "activity_dt", "activity_cd", "pplan_cd",
        "eqp_prod_nm", "change_reas_cd", "acct_num", "coe_pplan_sub_type_desc",
    )
    return acts.with_profile(rows, st.profile(spark, d), PROFILE_SHORT)


@register
def install_profile_left_join(spark, d):
    rows = acts.in_scope(st.activity(spark, d), st.CUTOFF).drop("mdn_5g")
    return acts.with_profile(
        rows,
        st.profile(spark, d),
        [*PROFILE_SHORT, "sales_dt", "install_dt"],
        bucket_channel=False,
    )


@register
def dedup_profile_join(spark, d):
    ended = acts.disconnects(st.activity(spark, d), st.CUTOFF).select(
        "cust_id", "mtn", "deact_dt", "deact_cd"
    )
    installs = acts.distinct_profile(
        st.profile(spark, d), ["chnl_nm", "install_type", "sales_dt", "install_dt"]
    )
    return ended.join(installs, ["cust_id", "mtn"], "left")


@register
def scd2_lookup(spark, d):
    rows = st.activity(spark, d).select(
        "cust_id", "cust_line_seq_id", "activity_dt", "activity_cd",
        F.date_add("activity_dt", 1).alias("at_dt"),
    )
    valid = st.network_history(st.changes(spark, d)).where(codes.code_is(F.col("active_ind"), "Y"))
    joined = history.scd2_join(rows, valid, acts.LINE, at="at_dt", how="left")
    return joined.select(
        "cust_id", "cust_line_seq_id", "activity_dt", "activity_cd", "eff_dt", "exp_dt",
        codes.code(F.col("network_type")).alias("network_type"),
    )


@register
def scd2_month_end(spark, d):
    rows = st.activity(spark, d).select("cust_id", "cust_line_seq_id", "activity_dt", "activity_cd")
    return acts.with_segment(rows, st.line_dimensions(st.changes(spark, d)), st.segments(spark), "segment")


@register
def scd2_inner(spark, d):
    rows = st.activity(spark, d).select("cust_id", "acct_num", "activity_dt", "activity_cd")
    return history.scd2_join(
        rows, st.account_history(st.changes(spark, d)), ("cust_id", "acct_num"), at="activity_dt", how="inner"
    )


@register
def eligible_by_history_or_plan(spark, d):
    rows = acts.activations(st.activity(spark, d), st.CUTOFF, "rpt_mth")
    return acts.eligible_by_history_or_plan(rows, st.network_history(st.changes(spark, d))).select(
        "cust_id", "cust_line_seq_id", "activity_dt", "activity_cd", "coe_pplan_sub_type_desc"
    )


def _enriched(spark, d, **options):
    days = durable(st.changes(spark, d))  # three histories are read from it
    rows = durable(st.activity(spark, d))  # and from this both kinds of events and the span of dates
    return acts.enriched_disconnects(
        rows,
        cutoff=st.CUTOFF,
        as_of=st.AS_OF,
        price_plans=st.price_plans(spark),
        network_history=st.network_history(days),
        line_dimensions=st.line_dimensions(days),
        account_history=st.account_history(days),
        segments=st.segments(spark),
        segment_dimension="segment",
        change_reasons=st.change_reasons(spark),
        activity_names=st.activity_names(spark),
        profile=st.profile(spark, d),
        **options,
    ).withColumn("days_on", F.col("days_on").cast("bigint"))


@register
def disconnect_enriched(spark, d):
    return _enriched(spark, d).drop("act_cd")


@register
def latest_disconnect(spark, d):
    lines = _enriched(
        spark, d, only_segment=codes.DEFAULT_SEGMENT, short_names=True, keep_other=True,
        activation_columns=acts.LATEST_KEYS,
    )
    return (
        acts.latest_disconnects(lines)
        .withColumn("mtn", codes.phone_number(F.col("mtn"), 10))
        .select(
            "segment", "price_plan_cd", "deact_cd", "eqp_prod_nm", "technology", "act_mth",
            "act_dt", "deact_dt", "deact_mth", "days_on", "disco_reason", "activity_desc",
            "change_reas_desc", "chnl_nm", "install_type", "sales_dt", "install_dt", "mtn",
            "cust_id",
        )
    )


# ---- telemetry panels -------------------------------------------------------------------------


def _churned(spark, d, rows=None):
    """Disconnects of numbers that also have an eligible activation."""
    rows = st.activity(spark, d) if rows is None else rows
    lines = acts.churned_lines(
        acts.activations(rows, st.CUTOFF),
        acts.disconnects(rows, st.CUTOFF),
        jobs.DISCONNECT_COLUMNS,
    )
    return lines.withColumn("mdn_5g", F.col("mtn"))


def _ended(spark, d, rows=None):
    return _churned(spark, d, rows).select("mdn_5g", "cust_id", "deact_dt", "deact_cd")


@register
def telemetry_range_scan(spark, d):
    bounds = panels.lookback_bounds(_ended(spark, d), 30)
    return panels.scan_range(st.telemetry(spark, d), bounds)


@register
def latest_score_date(spark, d):
    return panels.latest_score_date(st.telemetry(spark, d))


@register
def churned_with_telemetry(spark, d):
    return panels.with_telemetry(_ended(spark, d), st.telemetry(spark, d))


@register
def churn_lookback_panel(spark, d):
    ended = durable(_ended(spark, d))  # for the bounds and for the lookbacks
    days = panels.scan_range(st.telemetry(spark, d), panels.lookback_bounds(ended, 30))
    return panels.lookback(ended, days, 30, closed=True)


@register
def stable_active_lines(spark, d):
    rows = acts.in_scope(st.activity(spark, d), st.CUTOFF)
    return panels.stable_lines(rows, ["activity_dt", "pplan_cd", "acct_num"])


@register
def active_panel(spark, d):
    log = durable(st.activity(spark, d))
    days = panels.scan_range(
        st.telemetry(spark, d), panels.lookback_bounds(_ended(spark, d, log), 30)
    )
    return panels.active_panel(acts.in_scope(log, st.CUTOFF), days, ["activity_dt", "pplan_cd", "acct_num"])


@register
def panel_row_counts(spark, d):
    rows = st.telemetry(spark, d).select("cpe_date", "mdn_5g", "cust_id", "scaled_latency")
    return panels.row_counts(rows)


@register
def sample_days_per_line(spark, d):
    rows = st.telemetry(spark, d).select("cpe_date", "mdn_5g", "cust_id", "scaled_latency")
    return panels.sample_days(rows, 10)


# ---- features --------------------------------------------------------------------------------


def _features(spark, d, **options):
    # Stored: the log is read for both kinds of lines, the disconnects for the bounds and as targets.
    rows = durable(st.activity(spark, d))
    return features.feature_table(
        acts.in_scope(rows, st.CUTOFF),
        st.profile(spark, d),
        durable(_churned(spark, d, rows)),
        options.pop("panel", None) or st.telemetry(spark, d),
        churn_after=st.CHURN_AFTER,
        **options,
    )


@register
def churn_feature_table(spark, d):
    return _features(spark, d).drop("row_key")


@register
def one_hot_fixed(spark, d):
    keep = ["mdn_5g", "cust_id", *features.MODEL_SCORES, "acct_num"]
    return features.one_hot(_features(spark, d), keep)


def _uptime(spark, d):
    return st.telemetry(spark, d).select(
        "cpe_date", "mdn_5g", "cust_id", "scaled_5g_uptime", "scaled_downloadresult"
    )


@register
def impute_hot_deck(spark, d):
    keys = ["mdn_5g", "cust_id", "cpe_date"]
    rows = durable(_uptime(spark, d))  # donors, their number and both kinds of rows are read from it
    return features.impute_hot_deck(rows, "scaled_5g_uptime", keys, "donor")


@register
def impute_mean(spark, d):
    return features.impute_mean(_uptime(spark, d), ["scaled_5g_uptime", "scaled_downloadresult"])


@register
def impute_mean_train_only(spark, d):
    rows = features.split_train_test(_uptime(spark, d), ["mdn_5g", "cust_id"])
    return features.impute_mean(
        rows, ["scaled_5g_uptime", "scaled_downloadresult"], fit_on=rows.where(~F.col("is_test"))
    )


@register
def class_balance(spark, d):
    return features.balance_classes(st.scored_events(spark, d), ["event_id"], "label")


@register
def train_test_split(spark, d):
    return features.split_train_test(
        st.customers(spark, d).select("cust_id", "churned"), ["cust_id"]
    )


# ---- evaluation ------------------------------------------------------------------------------


@register
def confusion_matrix(spark, d):
    return evaluate.confusion_matrix(st.scored_events(spark, d))


@register
def classification_metrics(spark, d):
    return evaluate.classification_report(st.scored_events(spark, d))


@register
def roc_auc(spark, d):
    return evaluate.roc_auc(st.scored_events(spark, d))


@register
def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(st.scored_events(spark, d))


@register
def best_threshold(spark, d):
    return evaluate.best_threshold(st.scored_events(spark, d))


@register
def performance_drift(spark, d):
    return evaluate.performance_drift(st.scored_events(spark, d), "day")


@register
def weighted_examples(spark, d):
    return evaluate.with_class_weight(st.scored_events(spark, d), "label")


@register
def class_weights(spark, d):
    return evaluate.class_weights(st.scored_events(spark, d))


# ---- methodology -----------------------------------------------------------------------------


@register
def leakage_safe_windows(spark, d):
    sums = st.telemetry_sums(spark, d)
    return signals.leakage_safe_windows(
        sums,
        _ended(spark, d),
        {"quantity": F.col("quantity"), "returned": F.col("returned")},
        signals.data_end(st.activity(spark, d), "activity_dt"),
    )


@register
def static_as_channel(spark, d):
    return signals.static_as_channel(
        st.telemetry(spark, d),
        st.profile(spark, d),
        ["scaled_latency", "scaled_SNR"],
        ["market_type", "install_type"],
    )


@register
def static_channel_sequences(spark, d):
    steps = signals.static_as_channel(
        st.telemetry(spark, d), st.profile(spark, d), ["scaled_SNR"], ["install_type"]
    ).withColumn("quarters", (F.col("scaled_SNR") * 4).cast("int"))
    rows = signals.sequences(steps, ["quarters", "install_type"])
    cell = F.transform("steps", lambda s: F.concat_ws(":", s["quarters"], s["install_type"]))
    return rows.select(
        "mdn_5g", "cust_id", F.size("steps").alias("n_steps"), F.array_join(cell, ",").alias("steps")
    )


def _stage_one(spark, d):
    """Telemetry with the service-risk signal: quantity falling below its reference level of 25."""
    panel = st.telemetry(spark, d)
    drop = (F.lit(0) - F.col("scaled_SNR") * 4).cast("bigint")
    return signals.cusum(panel, drop)


@register
def cusum_signal(spark, d):
    return _stage_one(spark, d).select("cpe_date", "mdn_5g", "cust_id", "scaled_SNR", "cusum")


@register
def two_stage_features(spark, d):
    return _features(
        spark, d, panel=_stage_one(spark, d), scores=["scaled_latency"], signals=["cusum"]
    ).drop("row_key")


@register
def segment_churn_rates(spark, d):
    return signals.segment_rates(st.customers(spark, d), "segment")


@register
def segment_signal_effect(spark, d):
    return signals.segment_effects(st.customers(spark, d), "segment", F.col("predicted") == 1)


@register
def inactivity_label(spark, d):
    rows = st.activity(spark, d).select("cust_id", "mdn_5g", "activity_dt")
    return signals.inactivity_labels(
        rows, ["cust_id", "mdn_5g"], "activity_dt", signals.data_end(rows, "activity_dt")
    ).withColumn("gap_days", F.col("gap_days").cast("bigint"))


def _arms(spark, d):
    return experiment.assign_holdout(st.customers(spark, d), ["cust_id"], 0.3, "offer-1")


@register
def holdout_assignment(spark, d):
    return _arms(spark, d).select("cust_id", "predicted", "arm")


@register
def holdout_lift(spark, d):
    return experiment.holdout_lift(_arms(spark, d))


@register
def shadow_tracking(spark, d):
    return experiment.shadow_tracking(
        st.customers(spark, d), ["cust_id"], "cycle", 0.2, "shadow-1"
    )


@register
def outcome_taxonomy(spark, d):
    return experiment.outcome_taxonomy(_arms(spark, d))


@register
def retention_kpis(spark, d):
    return experiment.retention_kpis(_arms(spark, d))


@register
def lead_time_curve(spark, d):
    risk = durable(_stage_one(spark, d).select("cpe_date", *panels.KEY, "cusum"))  # read for the anchors and the lookbacks
    log = durable(st.activity(spark, d))
    left = _ended(spark, d, log).select("mdn_5g", "cust_id", "deact_dt", F.lit(False).alias("stayed"))
    stable = panels.stable_lines(acts.in_scope(log, st.CUTOFF))
    stayed = stable.join(panels.anchor_days(risk, "lead"), list(panels.KEY)).select(
        "mdn_5g", "cust_id", "deact_dt", F.lit(True).alias("stayed")
    )
    before = panels.lookback(left.unionByName(stayed), risk, 120)
    return signals.lead_time_curve(before, F.col("cusum") >= 40, [0, 15, 30, 60, 90])


# ---- model -----------------------------------------------------------------------------------


def _matrix(spark, d):
    keep = [*panels.KEY, "row_key", *features.MODEL_SCORES, "acct_num"]
    return features.one_hot(_features(spark, d), keep)


@register
def candidate_chain(spark, d):
    """The jobs one after the other, with stored tables between them, up to the design matrix."""
    lines = jobs.line_tables(st.raw_activity(spark, d), st.full_profile(spark, d), st.CUTOFF)
    churned, customers = (durable(lines[n]) for n in (jobs.CHURNED_LINES, jobs.CUSTOMER_LINES))
    found = jobs.candidate_panels(churned, customers, st.telemetry(spark, d))
    stayed, left = (durable(found[n]) for n in (jobs.ACTIVE_PANEL, jobs.CHURN_PANEL))
    return jobs.model_rows(stayed, left, churn_after=st.CHURN_AFTER).drop("row_key")


@register
def training_rows(spark, d):
    """Exactly the rows the forest is fitted on: split, imputed, balanced."""
    ready = jobs.prepare(_matrix(spark, d))
    return ready.fit_on.select(*panels.KEY, "row_key", *ready.inputs, features.LABEL)


@register
def equal_window_features(spark, d):
    """The feature table with windows of the same length for lines that stayed."""
    return _features(
        spark, d, equal_windows=True, least_days=2, scores=["scaled_latency", "scaled_SNR"]
    ).drop("row_key")


def trained(spark, d):
    """A forest trained on the folder's feature rows."""
    return jobs.train(_matrix(spark, d))


# The forest's own figures are random in the last digits; what is registered is what must hold of them.


@register
def rf_train_score(spark, d):
    """Every row's side and label, and whether its score is a probability that the prediction agrees with."""
    chance = F.col("probability")
    return trained(spark, d).scored().select(
        "mdn_5g", "cust_id", "is_test", "label",
        chance.between(0.0, 1.0).alias("is_probability"),
        F.when(chance > 0.5, F.col("prediction") == 1)
        .when(chance < 0.5, F.col("prediction") == 0)
        .otherwise(True)
        .alias("prediction_agrees"),
    )


@register
def rf_evaluation(spark, d):
    """Support per side and class, and whether all ratios lie between 0 and 1."""
    ratios = [F.col(c).between(0.0, 1.0) for c in ("precision", "recall", "f1", "roc_auc")]
    return trained(spark, d).report().select(
        "side", "class", "support", (ratios[0] & ratios[1] & ratios[2] & ratios[3]).alias("are_ratios")
    )


@register
def feature_importance(spark, d):
    """The inputs, each with a share of importance, and whether the shares add up."""
    shares = trained(spark, d).importances()
    total = shares.agg(F.sum("importance").alias("t")).scalar()
    return shares.select(
        "feature", F.col("importance").between(0.0, 1.0).alias("is_share"),
        (F.abs(total - 1) < 1e-9).alias("adds_up"),
    )


# ---- prepared once, applied later ------------------------------------------------------------------


@register
def prepared_matrix(spark, d):
    """The preparation learned from one half of the lines, stored, read again and applied to the other half.

    The learning half lacks lines without a known order fulfilment, so that level is one it has never seen.
    """
    rows = durable(_features(spark, d))
    half = hashing.below_share("half", panels.KEY, 0.5)
    learned = Preparation().fit(rows.where(half & (F.col("order_fulfilment") != "unknown")))
    path = scratch_path(spark, "preparation")
    learned.write().save(path)
    ready = PreparationModel.load(path)
    flags = ready.flags()
    on = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in flags])), ",")
    out = ready.transform(rows.where(~half))
    return out.select(
        *panels.KEY, "row_key", features.LABEL, *features.MODEL_SCORES, on.alias("flags"), F.lit(len(flags)).cast("bigint").alias("n_flags")
    )


@register
def incremental_panel(spark, d):
    """Means per line from a state advanced year by year, one year twice."""
    rows = durable(st.telemetry(spark, d).select("cpe_date", *panels.KEY, "scaled_latency", "scaled_downloadresult"))
    store = incremental.StateStore(spark, scratch_path(spark, "panel-state"), ("scaled_latency", "scaled_downloadresult"))
    years = [r[0] for r in rows.select(F.year("cpe_date").alias("y")).distinct().orderBy("y").collect()]
    for year in [*years, *years[:1]]:
        store.advance(str(year), rows.where(F.year("cpe_date") == year))
    return store.features()


# ---- histories of any length -------------------------------------------------------------------------


@register
def interval_lookup(spark, d):
    """Activity with all records valid that day, which last from one day to fifty years."""
    rows = st.activity(spark, d).select("cust_id", "activity_dt", "activity_cd")
    valid = st.records(spark, d, (1, 40, 800, 18_250)).select("cust_id", "eff_dt", "exp_dt", "plan")
    return intervals.interval_join(rows, valid, ["cust_id"], at="activity_dt")


@register
def history_resolved(spark, d):
    """One plan per customer and day from records that overlap and contradict one another; the latest recorded wins."""
    return intervals.resolved(st.records(spark, d, (1, 20, 90, 400)), ["cust_id"], ["plan"], ["recorded"])


@register
def history_late_merge(spark, d):
    """The same from a history that was finished before the late records came."""
    rows = durable(st.records(spark, d, (1, 20, 90, 400)))
    before = durable(intervals.resolved(rows.where("not is_late"), ["cust_id"], ["plan"], ["recorded"]))
    return intervals.with_late_records(before, rows.where("is_late"), ["cust_id"], ["plan"], ["recorded"])


# ---- segments, survival, uncertainty -------------------------------------------------------------------


DESCRIPTORS = ("segment", "chnl_nm", "install_type", "market_type", "order_fulfilment", "usage_flag", "month")


@register
def subgroup_search(spark, d):
    """The twenty subgroups of up to two values with the most unusual churn."""
    return subgroups.search(st.descriptors(spark, d), DESCRIPTORS, "churned", top=20, depth=2).top.drop("quality")


def _modelled(spark, d):
    return st.customers(spark, d).select(
        "segment", "churned", "predicted", F.expr("revenue_cents div 10000000").alias("revenue"),
        F.expr("1 + cust_id % 3").alias("weight"),
    )


@register
def segment_least_squares(spark, d):
    """Churn by revenue and prediction, a weighted linear model per segment."""
    found = local.least_squares(_modelled(spark, d), "segment", ["revenue", "predicted"], "churned", "weight")
    return found.select("segment", "n", *[F.round(f"b_{i}", 6).alias(f"b_{i}") for i in range(3)])


@register
def segment_logistic(spark, d):
    """The log odds of churn by prediction, a logistic model per segment."""
    found = local.logistic(_modelled(spark, d), "segment", ["predicted"], "churned")
    return found.select("segment", "n", "n_labelled", *[F.round(f"b_{i}", 6).alias(f"b_{i}") for i in range(2)])


@register
def cusum_alarms(spark, d):
    """Alarms of the service-risk signal, which starts anew after each and rests a week."""
    drop = F.lit(25) - F.col("quantity")
    return signals.cusum_alarms(st.telemetry_sums(spark, d), F.when(F.col("quantity") != 30, drop), 40, 7)


@register
def survival_curve(spark, d):
    """Share of customers still on, by day of life and segment; those still on at the data's end are censored."""
    rows = durable(st.lifetimes(spark, d))
    last = rows.agg(F.max(F.greatest("start_dt", "end_dt"))).scalar()
    days, ended = survival.lifetimes(F.col("start_dt"), F.col("end_dt"), last)
    table = survival.product_limit(rows.withColumns({"days": days, "ended": ended}), "segment", "days", "ended")
    return table.withColumns({c: F.round(c, 9) for c in ("survival", "hazard_sum")})


@register
def lift_interval(spark, d):
    """The holdout's rate difference with the interval of its 200 replicates."""
    return experiment.lift_interval(_arms(spark, d), ["cust_id"])


@register
def input_drift(spark, d):
    """Distance of each week's values from the first week's, and the week's quantiles from its days' summaries."""
    rows = durable(st.scored_events(spark, d).withColumn("week", F.trunc("day", "WEEK")))
    exact = drift.distances(rows, "week", "score")
    daily = drift.summaries(rows, ["week", "day"], "score")
    points = drift.quantiles(drift.added(daily, ["week"]), ["week"], {"q10": 0.1, "q50": 0.5, "q90": 0.9}).drop("n")
    return exact.join(points.withColumnRenamed("week", "period"), "period")


@register
def permutation_importance(spark, d):
    """What shuffling each input costs a fixed rule that judges churn."""
    rows = st.customers(spark, d).select("cust_id", "churned", "predicted", "cost_cents", F.expr("revenue_cents div 10000000").alias("revenue"))

    def rule(copies):
        return copies.withColumn("prediction", F.when((F.col("revenue") >= 12) | ((F.col("predicted") == 1) & (F.col("revenue") >= 9)), 1).otherwise(0))

    return permutation.importances(rows, ["cust_id"], ["revenue", "predicted", "cost_cents"], rule, "churned")
