"""Hand-made rows for what the given tables do not hold: NULLs, padding, ties, boundary days."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stayline.functions import codes, dates, numbers
from stayline.operators import activity as acts
from stayline.operators import evaluate, experiment, features, history, panel, signals
from stayline.sources import contracts

D = date


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_channel(spark):
    got = column(spark, [None, "D2D", "d2d ", "Retail", ""], "string", codes.channel_bucket)
    assert got == [None, "D2D", "D2D", "Non-D2D", "Non-D2D"]


@pytest.mark.parametrize(
    "category, description, wanted",
    [
        ("I", "moving away", "Movers"),
        ("I", None, "Involuntary"),
        ("a ", "NON PAY", "Involuntary"),
        ("V", None, None),
        (None, None, None),
        (None, "COMPETITOR", "Voluntary"),
    ],
)
def test_disconnect_reason_order(spark, category, description, wanted):
    df = spark.createDataFrame([(category, description)], "c string, d string")
    assert df.select(codes.disconnect_reason(F.col("c"), F.col("d"))).first()[0] == wanted


@pytest.mark.parametrize(
    "plan, kind, sub, long, short",
    [
        (" 67571", None, None, "5G Home C-Band", "C-Band"),
        ("67567", "Fixed Wireless Home", "4G LTE Home", "5G Home mmWave", "MM Wave"),
        ("75561", None, None, "5G Home C-Band", "Other"),
        ("75560", None, None, "5G Home mmWave", "Other"),
        ("x", "fixed wireless home ", "4G LTE Home", "4G LTE Home", "4G LTE Home"),
        ("x", "Fixed Wireless Home", None, None, None),
        (None, None, None, "Other", "Other"),
    ],
)
def test_technology(spark, plan, kind, sub, long, short):
    df = spark.createDataFrame([(plan, kind, sub)], "p string, k string, s string")
    args = [F.col(c) for c in "pks"]
    row = df.select(
        codes.technology_bucket(*args), codes.technology_bucket(*args, short_names=True)
    ).first()
    assert row[:] == (long, short)


def test_null_technology_is_dropped_by_not_equal(spark):
    df = spark.createDataFrame([(None,), ("OTHER ",), ("C-Band",)], "t string")
    assert [r.t for r in df.where(codes.code_is_not(F.col("t"), "other")).collect()] == ["C-Band"]


def test_device(spark):
    names = [None, "Gateway ARC-XCI55AX", "WNC-CR200A ", "Old Box", "", "ARC-XCI55AX v2"]
    assert column(spark, names, "string", codes.device_bucket) == [
        "others", "ARC-XCI55AX", "WNC-CR200A", "others", "others", "others",
    ]


def test_plan_and_unknown(spark):
    got = column(
        spark,
        ["5G Business Internet C-Band", "5G Home mmWave", None],
        "string",
        lambda c: codes.known(codes.plan_bucket(c)),
    )
    assert got == ["5G Business Internet", "5G Home mmWave", "unknown"]


def test_dates(spark):
    assert dates.decode_cutoff(1230101) == D(2023, 1, 1)
    assert dates.decode_cutoff("2024-06-15") == D(2024, 6, 15)
    assert column(spark, [1230101, 991231], "int", dates.date_of_code) == [
        D(2023, 1, 1), D(1999, 12, 31),
    ]
    assert column(spark, [D(2024, 2, 10), None], "date", dates.month_end) == [D(2024, 2, 29), None]
    got = column(
        spark, [None, D(2024, 1, 11)], "date",
        lambda end: dates.days_on(F.lit(D(2024, 1, 1)), end, D(2024, 3, 1)),
    )
    assert got == [60, 10]
    blocks = column(spark, [D(1969, 12, 31), D(1970, 1, 1), D(1970, 2, 1)], "date",
                    lambda c: dates.day_block(c, 31))
    assert blocks == [-1, 0, 1]


@pytest.mark.parametrize(
    "values, wanted",
    [([1.005, 1.005], 1.01), ([-1.005], -1.01), ([0.1, 0.2, None], 0.15), ([None], None),
     ([1.0, 2.0, 2.0], 1.67), ([-12.5, -12.0], -12.25), ([float("nan"), 2.0, float("inf")], 2.0),
     ([float("nan")], None), ([9e14, 9e14, 9e14], 9e14)],
)
def test_mean(spark, values, wanted):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(numbers.mean_2dp(F.col("v"))).first()[0] == wanted


def test_small_scores_count_in_the_mean(spark):
    df = spark.createDataFrame([(4e-7,), (2e-7,), (float("nan"),)], "v double")
    assert df.agg(numbers.mean(F.col("v"))).first()[0] == pytest.approx(3e-7, rel=1e-12)
    near = spark.createDataFrame([(0.1234567891,), (0.1234567892,)], "p double")
    assert near.select(numbers.fixed_point(F.col("p"))).distinct().count() == 2


def test_mean_of_long_account_number(spark):
    df = spark.createDataFrame([(987654321012345678,), (987654321012345678,)], "v bigint")
    assert df.agg(numbers.mean_of_whole(F.col("v"))).first()[0] == float(987654321012345678)


def test_conform_normalises_and_names_missing_columns(spark):
    row = {f.name.upper(): None for f in contracts.ACTIVITY.fields}
    row.update(CUST_ID=" 7 ", MTN="5551234567  ", ACTIVITY_CD=" de", ACTIVITY_DT="2024-05-01",
               EQP_PROD_NM="Box ")
    kinds = ", ".join(f"{name} string" for name in row)
    raw = spark.createDataFrame([tuple(row.values())], kinds)
    got = contracts.conform_activity(raw).first()
    assert (got.cust_id, got.mtn, got.mdn_5g, got.activity_cd, got.activity_dt, got.eqp_prod_nm) == (
        "7", "5551234567", "5551234567", "DE", D(2024, 5, 1), "Box",
    )
    with pytest.raises(ValueError, match="activity_cd, rpt_mth"):
        contracts.conform_activity(raw.drop("activity_cd", "rpt_mth"))


def test_conform_spells_plan_types_and_refuses_unreadable_dates(spark):
    row = {f.name: None for f in contracts.ACTIVITY.fields}
    kinds = ", ".join(f"{name} string" for name in row)
    rows = [tuple({**row, "coe_pplan_sub_type_desc": v}.values()) for v in (" 5g home c-band ", "5G HOME", "Other ", None)]
    found = contracts.conform_activity(spark.createDataFrame(rows, kinds)).collect()
    assert [r.coe_pplan_sub_type_desc for r in found] == ["5G Home C-Band", "5G Home", "Other", None]
    bad = spark.createDataFrame([tuple({**row, "activity_dt": "someday"}.values())], kinds)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        contracts.conform_activity(bad).collect()


def test_scores_that_are_not_finite_are_missing(spark):
    row = {f.name: None for f in contracts.PANEL.fields}
    rows = [tuple({**row, "scaled_SNR": v}.values()) for v in (float("nan"), float("-inf"), 0.5)]
    df = spark.createDataFrame(rows, contracts.PANEL)
    assert [r.scaled_SNR for r in contracts.conform(df, contracts.PANEL).collect()] == [None, None, 0.5]


def test_donors_and_means_skip_nan_and_come_from_the_training_rows(spark):
    nan = float("nan")
    rows = [(i, nan if i % 2 else float(i), i < 20) for i in range(40)] + [(40, float("inf"), True), (41, None, False)]
    df = spark.createDataFrame(rows, "id bigint, v double, train boolean")
    filled = features.impute_hot_deck(df, "v", ["id"], "s", df.where("train")).collect()
    assert len(filled) == 42 and all(r.v == r.id if r.id < 40 and r.id % 2 == 0 else r.v < 20 for r in filled)
    means = features.impute_mean(df, ["v"], df.where("train")).where("id in (1, 40, 41)").collect()
    assert {r.v for r in means} == {9.0}


def test_a_missing_score_is_below_every_threshold(spark):
    df = scored(spark, [(1, 1, 5), (1, 0, None), (0, 0, 3), (0, 0, None)])
    assert evaluate.roc_auc(df).first().roc_auc == (2 + 0 + 0.5) / 4
    swept = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluate.threshold_sweep(df).collect()}
    assert swept == {5: (1, 0, 1), 3: (1, 1, 1)}


def test_of_several_profile_rows_the_smallest_counts(spark, data):
    from stayline.plans import standins as st

    rows, tel, prof = st.activity(spark, data), st.telemetry(spark, data), st.profile(spark, data)
    scope, gone = acts.in_scope(rows, st.CUTOFF), acts.disconnects(rows, st.CUTOFF)
    later = prof.withColumn("market_type", F.lit("zzz"))

    def table(p):
        return sorted(map(str, features.feature_table(scope, p, gone, tel, churn_after=st.CHURN_AFTER).drop("market_type").collect()))

    assert table(prof.unionByName(later).unionByName(prof)) == table(prof)


def test_first_activation_without_the_line(spark):
    kinds = "cust_id string, cust_line_seq_id string, mtn string, activity_dt date"
    started = spark.createDataFrame([("1", "1", "m", D(2020, 1, 5)), ("1", "2", "m", D(2020, 1, 1))], kinds)
    ended = started.select("cust_id", "cust_line_seq_id", F.lit(D(2020, 3, 1)).alias("deact_dt"))
    by_line = acts.first_activation_before(started, ended, ["mtn"], ["deact_dt"])
    assert by_line.count() == 2
    one = acts.first_activation_before(started, ended, ["mtn"], ["deact_dt"], by_line=False).collect()
    assert [(r.cust_id, r.act_dt) for r in one] == [("1", D(2020, 1, 1))]


def test_account_numbers_that_are_no_numbers(spark):
    df = spark.createDataFrame([("abc",), ("12345678901",)], "a string")
    assert [r[0] for r in df.select(F.col("a").try_cast("bigint")).collect()] == [None, 12345678901]


# ---- joins -----------------------------------------------------------------------------------


def facts(spark, *days):
    return spark.createDataFrame([("1", "1", d) for d in days],
                                 "cust_id string, cust_line_seq_id string, at date")


def test_validity_counts_both_ends(spark):
    hist = spark.createDataFrame(
        [("1", "1", D(2020, 1, 10), D(2020, 1, 20), "a"),
         ("1", "1", D(2020, 1, 21), D(9999, 12, 31), "b"),
         ("1", "1", D(2031, 1, 1), D(2030, 1, 1), "reversed")],
        "cust_id string, cust_line_seq_id string, eff_dt date, exp_dt date, v string",
    )
    rows = facts(spark, D(2020, 1, 9), D(2020, 1, 10), D(2020, 1, 20), D(2020, 1, 21),
                 D(2031, 6, 1), None)
    got = history.scd2_join(rows, hist, acts.LINE, at="at", how="left").collect()
    assert {r["at"]: r.v for r in got} == {
        D(2020, 1, 9): None, D(2020, 1, 10): "a", D(2020, 1, 20): "a", D(2020, 1, 21): "b",
        D(2031, 6, 1): "b", None: None,
    }
    inner = history.scd2_join(rows, hist, acts.LINE, at="at", how="inner")
    assert inner.count() == 4
    semi = history.scd2_join(rows, hist, acts.LINE, at="at", how="left_semi")
    assert semi.columns == rows.columns and semi.count() == 4


def test_overlapping_history_does_not_multiply_eligible_rows(spark):
    act = spark.createDataFrame(
        [("1", "1", D(2020, 1, 1), "Mobile"), ("1", "1", D(2020, 1, 1), None),
         ("2", "1", D(2020, 1, 1), "5g home "), ("3", "1", D(2020, 1, 1), "Mobile")],
        "cust_id string, cust_line_seq_id string, activity_dt date, "
        "coe_pplan_sub_type_desc string",
    )
    net = spark.createDataFrame(
        [("1", "1", D(2019, 1, 1), D(2021, 1, 1), "y", "5g fixed wireless"),
         ("1", "1", D(2020, 1, 2), D(2020, 1, 2), "Y ", "5G Fixed Wireless"),
         ("3", "1", D(2019, 1, 1), D(2020, 1, 1), "Y", "5G Fixed Wireless"),
         ("3", "1", D(2019, 1, 1), D(2021, 1, 1), "N", "5G Fixed Wireless")],
        "cust_id string, cust_line_seq_id string, eff_dt date, exp_dt date, active_ind string, "
        "network_type string",
    )
    got = acts.eligible_by_history_or_plan(act, net)
    assert sorted(r.cust_id for r in got.collect()) == ["1", "1", "2"]


def test_latest_disconnect_keeps_ties_and_ranks_before_dropping_other(spark):
    df = spark.createDataFrame(
        [("1", "1", D(2020, 1, 2), "C-Band", 1), ("1", "1", D(2020, 1, 2), "C-Band", 2),
         ("1", "1", D(2020, 1, 1), "C-Band", 3), ("2", "1", D(2020, 1, 5), "Other", 4),
         ("2", "1", D(2020, 1, 1), "C-Band", 5), ("3", "1", D(2020, 1, 1), None, 6)],
        "cust_id string, mtn string, deact_dt date, technology string, i int",
    )
    assert sorted(r.i for r in acts.latest_disconnects(df).collect()) == [1, 2]


def test_first_activation_is_the_earliest_strictly_before(spark):
    started = spark.createDataFrame(
        [("1", "1", "p", D(2020, 1, 5)), ("1", "1", "p", D(2020, 1, 1)),
         ("1", "1", "q", D(2020, 2, 1))],
        "cust_id string, cust_line_seq_id string, pplan_cd string, activity_dt date",
    )
    ended = spark.createDataFrame(
        [("1", "1", D(2020, 1, 1)), ("1", "1", D(2020, 1, 3)), ("1", "1", D(2020, 1, 3)),
         ("1", "1", D(2020, 3, 1)), ("2", "1", D(2020, 3, 1))],
        "cust_id string, cust_line_seq_id string, deact_dt date",
    )
    got = acts.first_activation_before(started, ended, ["pplan_cd"], ["deact_dt"]).collect()
    assert sorted((r.pplan_cd, r.deact_dt, r.act_dt) for r in got) == [
        ("p", D(2020, 1, 3), D(2020, 1, 1)), ("p", D(2020, 3, 1), D(2020, 1, 1)),
        ("q", D(2020, 3, 1), D(2020, 2, 1)),
    ]


# ---- panels ----------------------------------------------------------------------------------


def telemetry(spark, days, line="1"):
    return spark.createDataFrame([(d, line, line, 1.0) for d in days],
                                 "cpe_date date, mdn_5g string, cust_id string, x double")


def ended(spark, *days):
    return spark.createDataFrame([("1", "1", d) for d in days],
                                 "mdn_5g string, cust_id string, deact_dt date")


@pytest.mark.parametrize("closed, first, last, n", [(True, 30, 0, 31), (False, 29, 1, 29)])
def test_lookback_bounds(spark, closed, first, last, n):
    end = D(2024, 6, 20)
    days = [end + timedelta(k) for k in range(-100, 50)]
    got = panel.lookback(ended(spark, end, end), telemetry(spark, days), 30, closed=closed).collect()
    seen = sorted(r.cpe_date for r in got)
    assert (len(seen), seen[0], seen[-1]) == (n, end - timedelta(first), end - timedelta(last))


def test_lookback_against_brute_force(spark):
    days = [D(2019, 12, 1) + timedelta(3 * k) for k in range(150)]
    ends = [D(2020, 1, 1) + timedelta(11 * k) for k in range(25)]
    for width in (1, 7, 45):
        got = panel.lookback(ended(spark, *ends), telemetry(spark, days), width).collect()
        assert sorted((r.deact_dt, r.cpe_date) for r in got) == sorted(
            (e, d) for e in ends for d in days if 0 <= (e - d).days <= width
        )


def test_stable_lines(spark):
    rows = [("a", "AC"), ("b", "AC"), ("b", "AC"), ("c", "AC"), ("c", "DE"), ("d", "D3"),
            ("e", "AC"), ("e", "RE"), ("f", "RE")]
    df = spark.createDataFrame([(k, k, c, f"{k}{c}") for k, c in rows],
                               "mdn_5g string, cust_id string, activity_cd string, t string")
    got = panel.stable_lines(df, ["t"])
    assert sorted((r.mdn_5g, r.t) for r in got.collect()) == [("a", "aAC"), ("e", "eAC")]


def test_sample_is_the_same_under_any_partitioning(spark):
    days = [D(2020, 1, 1) + timedelta(k) for k in range(200)]
    df = telemetry(spark, days).unionByName(telemetry(spark, days[:5], "2"))
    one = {(r.mdn_5g, r.cpe_date) for r in panel.sample_days(df.coalesce(1)).collect()}
    many = {(r.mdn_5g, r.cpe_date) for r in panel.sample_days(df.repartition(9)).collect()}
    assert one == many and len(one) == 35


# ---- features --------------------------------------------------------------------------------


def test_unseen_category_is_all_zeros(spark):
    df = spark.createDataFrame([("Box", None, "East", "x", "Y"), ("others", None, None, None, "?")],
                               "eqp_prod_nm string, coe_pplan_sub_type_desc string, "
                               "market_type string, order_fulfilment string, churn_label string")
    first, second = features.one_hot(df, []).collect()
    assert len(first) == 18 and first.market_type_East == 1 and sum(first[:-1]) == 1
    assert (first.churn_label, second.churn_label, second.eqp_prod_nm_others) == (1, None, 1)


def test_hot_deck_takes_only_donor_values(spark):
    df = spark.createDataFrame(
        [(i, float(i % 7) if i % 3 else None) for i in range(300)], "id bigint, x double"
    )
    got = {r.id: r.x for r in features.impute_hot_deck(df, "x", ["id"], "s").collect()}
    assert len(got) == 300 and all(got[i] == float(i % 7) for i in got if i % 3)
    filled = [got[i] for i in got if i % 3 == 0]
    assert set(filled) <= {float(k) for k in range(7)} and len(set(filled)) > 3
    none = df.where("x IS NULL")
    kept = features.impute_hot_deck(none, "x", ["id"], "s").collect()
    assert len(kept) == 100 and all(r.x is None for r in kept)


def test_balance_cuts_either_class(spark):
    for n0, n1 in ((90, 10), (10, 90)):
        df = spark.range(n0 + n1).withColumn("y", F.when(F.col("id") < n0, 0).otherwise(1))
        got = features.balance_classes(df, ["id"], "y").groupBy("y").count().collect()
        assert sorted((r.y, r["count"]) for r in got) == [(0, 10), (1, 10)]


def test_rows_without_a_label_are_no_class(spark):
    df = spark.createDataFrame([(i, None if i < 2 else i % 3 // 2) for i in range(32)],
                               "id bigint, y int")
    got = features.balance_classes(df, ["id"], "y").groupBy("y").count().collect()
    assert sorted((r.y, r["count"]) for r in got) == [(0, 10), (1, 10)]


def test_split_is_disjoint_complete_and_stable(spark):
    def side(parts):
        df = features.split_train_test(spark.range(0, 4000, 1, parts), ["id"])
        return {r.id: r.is_test for r in df.collect()}

    one, many = side(1), side(11)
    assert one == many and len(one) == 4000
    assert 0.27 < sum(one.values()) / 4000 < 0.33


def test_feature_table_equals_the_one_from_stored_panels(spark, data):
    """The single-pass table and the two-panel route (sampled, open lookback) agree."""
    from stayline.plans import standins as st

    rows = st.activity(spark, data)
    gone = acts.disconnects(rows, st.CUTOFF)
    scope, prof = acts.in_scope(rows, st.CUTOFF), st.profile(spark, data)
    tel = panel.scan_range(st.telemetry(spark, data), panel.lookback_bounds(gone))
    places = prof.select("mdn_5g", "cust_id", "market_type", "order_fulfilment")
    line = ["cust_line_seq_id", "pplan_cd", "eqp_prod_nm", "coe_pplan_sub_type_desc", "acct_num"]
    stayed = panel.sample_days(panel.active_panel(scope, tel, line)).join(
        places, ["mdn_5g", "cust_id"], "left"
    )
    churned = panel.lookback(
        gone.where((F.col("deact_cd") == "DE") & (F.col("deact_dt") > F.lit(st.CHURN_AFTER)))
        .select("mdn_5g", "cust_id", *line, "deact_dt"),
        tel, 30, closed=False,
    ).join(places, ["mdn_5g", "cust_id"], "left")
    means = features.score_means(features.label_panels(stayed, churned)).drop("n_days")
    two = features.tidy_categories(means)
    one = features.feature_table(scope, prof, gone, tel, churn_after=st.CHURN_AFTER)
    assert one.count() > 0
    assert sorted(map(str, one.select(sorted(one.columns)).collect())) == sorted(
        map(str, two.select(sorted(two.columns)).collect())
    )


def test_feature_table_keeps_all_rows_of_a_day(spark, data):
    from stayline.plans import standins as st

    rows, tel, prof = st.activity(spark, data), st.telemetry(spark, data), st.profile(spark, data)
    scope, gone = acts.in_scope(rows, st.CUTOFF), acts.disconnects(rows, st.CUTOFF)

    def table(t):
        return sorted(map(str, features.feature_table(scope, prof, gone, t, churn_after=st.CHURN_AFTER).collect()))

    often = tel.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("_copy")
    once = table(tel)
    assert any("churn_label='Y'" in r for r in once) and table(often) == once


# ---- evaluation and methodology ----------------------------------------------------------------


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score bigint")


def test_auc_with_ties_against_pairs(spark):
    rows = [(i % 3 == 0, 0, (i * 37) % 11 * 70_000) for i in range(200)]
    rows = [(int(y), p, s) for y, p, s in rows]
    pos, neg = [s for y, _, s in rows if y], [s for y, _, s in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    got = evaluate.roc_auc(scored(spark, rows)).first()
    assert got.roc_auc == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)


def test_metrics_without_one_class(spark):
    df = scored(spark, [(1, 1, 5), (1, 0, 3)])
    got = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert got["0"].precision == 0.0 and got["1"].recall == 0.5
    assert evaluate.roc_auc(df).first().roc_auc is None


def test_cusum_against_loop(spark):
    values = [3, -5, 2, 2, -1, -9, 4, 4, -2, 0, 7]
    df = spark.createDataFrame(
        [(D(2020, 1, 1) + timedelta(k), "1", "1", v) for k, v in enumerate(values)],
        "cpe_date date, mdn_5g string, cust_id string, v bigint",
    )
    wanted, s = [], 0
    for v in values:
        s = max(0, s + v)
        wanted.append(s)
    got = signals.cusum(df, F.col("v")).orderBy("cpe_date").collect()
    assert [r.cusum for r in got] == wanted


def test_windows_use_nothing_after_the_observation(spark):
    panel_rows = spark.createDataFrame(
        [(D(2020, m, 5), k, k, 10**m) for k in ("1", "2", "3") for m in range(1, 8)],
        "cpe_date date, mdn_5g string, cust_id string, v bigint",
    )
    gone = spark.createDataFrame(
        [("1", "1", D(2020, 5, 9)), ("2", "2", D(2020, 4, 30)), ("3", "3", D(2020, 7, 1))],
        "mdn_5g string, cust_id string, deact_dt date",
    )
    def windows(end):
        return signals.leakage_safe_windows(panel_rows, gone, {"v": F.col("v")}, F.lit(end)).collect()

    assert windows(D(2020, 6, 29)) == []  # the last month to predict is not over
    got = windows(D(2020, 6, 30))
    assert {r.mdn_5g: (r.obs_v, r.obs_rows, r.label) for r in got} == {
        "1": (1110, 3, 1), "3": (1110, 3, 0),
    }


def test_inactivity(spark):
    df = spark.createDataFrame(
        [("1", D(2020, 1, 1)), ("1", D(2020, 1, 1)), ("1", D(2020, 3, 1)), ("1", D(2020, 5, 1))],
        "k string, d date",
    )
    got = signals.inactivity_labels(df, ["k"], "d", F.lit(D(2020, 6, 1))).orderBy("d").collect()
    assert [(r.gap_days, r.churned, r.censored) for r in got] == [(60, 0, 0), (61, 1, 0), (31, 0, 1)]


def arms(spark, rows):
    return spark.createDataFrame(
        rows, "arm string, predicted int, churned int, revenue_cents bigint, cost_cents bigint"
    )


def test_lift_of_the_worked_example(spark):
    rows = [("treated", 1, int(i < 6), 100, 0) for i in range(100)]
    rows += [("control", 1, int(i < 13), 100, 0) for i in range(100)]
    got = experiment.holdout_lift(arms(spark, rows)).first()
    assert (got.rate_treated, got.rate_control) == (0.06, 0.13)
    assert got.rate_difference == pytest.approx(0.07)


def test_net_savings_of_the_worked_example(spark):
    """Loss 2.4M without and 0.9M with the offers, which cost 0.2M: 1.3M net."""
    million = 100_000_000
    rows = [("treated", 1, 1, int(0.9 * million), int(0.1 * million)),
            ("treated", 1, 0, int(9.1 * million), int(0.1 * million)),
            ("control", 1, 1, int(2.4 * million), 0), ("control", 1, 0, int(7.6 * million), 0)]
    got = experiment.retention_kpis(arms(spark, rows)).first()
    assert got.revenue_retained == pytest.approx(1_500_000)
    assert got.promo_cost == pytest.approx(200_000)
    assert got.net_savings == pytest.approx(1_300_000)
    assert got.roi == pytest.approx(6.5)


def test_holdout_share_and_independence(spark):
    df = spark.range(20_000).withColumn("predicted", F.lit(1))
    first = experiment.assign_holdout(df, ["id"], 0.2, "a").withColumnRenamed("arm", "a")
    both = experiment.assign_holdout(first, ["id"], 0.2, "b").withColumnRenamed("arm", "b")
    got = {(r.a, r.b): r["count"] for r in both.groupBy("a", "b").count().collect()}
    control = got["control", "control"] + got["control", "treated"]
    assert 0.18 < control / 20_000 < 0.22
    assert 0.03 < got["control", "control"] / 20_000 < 0.05


def test_sequences_are_in_order(spark):
    days = [D(2020, 1, 1) + timedelta(k) for k in (5, 1, 9)]
    prof = spark.createDataFrame([("1", "1", "East")], "mdn_5g string, cust_id string, m string")
    steps = signals.static_as_channel(telemetry(spark, days), prof, ["x"], ["m"])
    row = signals.sequences(steps, ["cpe_date", "m"]).first()
    assert [(s.step, s.cpe_date, s.m) for s in row.steps] == [
        (1, days[1], "East"), (2, days[0], "East"), (3, days[2], "East"),
    ]
