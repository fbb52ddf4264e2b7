"""SQL equivalents of the registered queries, over the same whole tables.

Written on their own, from what each query should return; only the score rules, which define the
input and not the work, are shared with the stand-ins.
"""

from __future__ import annotations

import math

from stayline.plans.standins import SCORE_RULES

ACT = """
act AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cust_id,
    CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 2 + 3 AS VARCHAR)
      ELSE CAST(o_orderkey % 2 + 1 AS VARCHAR) END
      AS cust_line_seq_id,
    CAST(o_custkey AS VARCHAR) || CAST(o_orderkey % 2 + 1 AS VARCHAR) AS mtn,
    CAST(o_custkey AS VARCHAR) || CAST(o_orderkey % 2 + 1 AS VARCHAR) AS mdn_5g,
    CASE WHEN o_totalprice < 60000 THEN '67571' WHEN o_totalprice < 120000 THEN '67567'
      WHEN o_totalprice < 180000 THEN '75561' WHEN o_totalprice < 240000 THEN '75560'
      WHEN o_totalprice < 300000 THEN 'FWH1' WHEN o_totalprice < 360000 THEN 'FWH2'
      WHEN o_totalprice < 420000 THEN 'FWH3' ELSE 'MOB1' END AS pplan_cd,
    CAST(o_orderdate AS DATE) AS activity_dt,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'AC'
      WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'DE'
      WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'D3'
      WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'RE'
      ELSE 'CH' END AS activity_cd,
    CASE WHEN month(o_orderdate) <= 3 THEN 'Gateway ARC-XCI55AX'
      WHEN month(o_orderdate) <= 6 THEN 'Router WNC-CR200A'
      WHEN month(o_orderdate) <= 8 THEN 'ASK-NCQ1338FA'
      WHEN month(o_orderdate) <= 10 THEN 'Cube FSNO21VA'
      WHEN month(o_orderdate) = 11 THEN 'Legacy Modem' END AS eqp_prod_nm,
    'R' || CAST(day(o_orderdate) // 6 AS VARCHAR) AS change_reas_cd,
    CAST(o_custkey * 100 + o_orderkey % 2 + 1 AS VARCHAR) AS acct_num,
    CAST(date_trunc('month', CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH
      * (CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)) AS DATE) AS rpt_mth,
    CASE WHEN day(o_orderdate) = 1 THEN 'Y' ELSE 'N' END AS prepaid_ind,
    CASE WHEN day(o_orderdate) = 2 THEN 'N' ELSE 'Y' END AS rev_gen_ind,
    CASE WHEN day(o_orderdate) = 3 THEN 'M' ELSE 'C' END AS managed_ind,
    CASE WHEN day(o_orderdate) = 4 THEN 'T' ELSE 'S' END AS line_type_cd,
    CASE WHEN o_totalprice < 80000 THEN '4G LTE Home'
      WHEN o_totalprice < 160000 THEN '5G Home C-Band'
      WHEN o_totalprice < 240000 THEN '5G Home mmWave'
      WHEN o_totalprice < 320000 THEN '5G Business Internet C-Band'
      WHEN o_totalprice < 400000 THEN '5G Business Internet mmWave'
      WHEN o_totalprice < 440000 THEN '5G Home'
      ELSE 'Mobile Unlimited' END AS coe_pplan_sub_type_desc,
    CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents
  FROM orders
)"""

FIXED_TYPES = """('5g business internet mmwave', '5g business internet c-band', '5g home mmwave',
  '5g home c-band', '4g lte home')"""
IS_ELIGIBLE = "prepaid_ind = 'N' AND rev_gen_ind = 'Y' AND managed_ind = 'C' AND line_type_cd <> 'T'"

STARTED = f"""
started AS (
  SELECT * FROM act WHERE activity_cd IN ('AC', 'RE') AND activity_dt >= DATE '1996-01-01'
    AND {IS_ELIGIBLE}
)"""
ENDED = f"""
ended AS (
  SELECT cust_id, cust_line_seq_id, mtn, mdn_5g, pplan_cd, eqp_prod_nm, change_reas_cd, acct_num,
    coe_pplan_sub_type_desc, activity_dt AS deact_dt, activity_cd AS deact_cd
  FROM act WHERE activity_cd IN ('DE', 'D3') AND activity_dt >= DATE '1996-01-01'
    AND lower(coe_pplan_sub_type_desc) IN {FIXED_TYPES}
)"""
# Disconnects of numbers that also have an eligible activation, each row once.
CHURNED = STARTED + "," + ENDED.replace("ended AS", "all_ended AS") + """,
ended AS (
  SELECT DISTINCT e.* FROM all_ended e
  WHERE EXISTS (SELECT 1 FROM started s WHERE s.cust_id = e.cust_id AND s.mtn = e.mtn)
)"""
# Telemetry of the days that the lookbacks before them span.
SPAN = """
span AS (
  SELECT * FROM tel
  WHERE cpe_date >= (SELECT min(deact_dt) - INTERVAL 30 DAY FROM ended)
    AND cpe_date <= (SELECT max(deact_dt) FROM ended)
)"""
SCOPE = f"""
scope AS (
  SELECT * FROM act
  WHERE (rpt_mth >= DATE '1996-01-01' OR activity_dt >= DATE '1996-01-01')
    AND lower(coe_pplan_sub_type_desc) IN {FIXED_TYPES}
)"""

PROFILE = """
seen AS (
  SELECT user_id, count(*) AS n_events,
    count(*) FILTER (WHERE event_type = 'purchase') AS n_bought,
    min(CAST(ts AS DATE)) AS sales_dt, max(CAST(ts AS DATE)) AS install_dt
  FROM events GROUP BY user_id
),
profile AS (
  SELECT CAST(c_custkey AS VARCHAR) AS cust_id,
    CAST(c_custkey AS VARCHAR) || l.line AS mtn,
    CAST(c_custkey AS VARCHAR) || l.line AS mdn_5g,
    CASE WHEN n_bought * 5 >= n_events THEN 'D2D' WHEN n_events IS NOT NULL THEN 'Retail' END
      AS chnl_raw,
    CASE WHEN n_bought * 5 >= n_events THEN 'D2D' WHEN n_events IS NOT NULL THEN 'Non-D2D' END
      AS chnl_nm,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'SELF' ELSE 'PROFESSIONAL' END AS install_type,
    sales_dt, install_dt,
    CASE r_name WHEN 'AMERICA' THEN 'West' WHEN 'EUROPE' THEN 'East' WHEN 'ASIA' THEN 'South'
      WHEN 'AFRICA' THEN 'Headquarters' END AS market_type,
    CASE WHEN c_acctbal >= 5000 THEN 'LOCALLY_FULFILLED' WHEN c_acctbal >= 0 THEN 'SHIPPED' END
      AS order_fulfilment,
    CASE WHEN n_events >= 60 THEN 'Y' WHEN n_events IS NOT NULL THEN 'N' END AS usage_flag
  FROM customer
  CROSS JOIN (SELECT unnest(['1', '2']) AS line) l
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN seen ON user_id = c_custkey
)"""

TEL = """
sums AS (
  SELECT CAST(l_shipdate AS DATE) AS cpe_date,
    CAST(o_custkey AS VARCHAR) || CAST(o_orderkey % 2 + 1 AS VARCHAR) AS mdn_5g,
    CAST(o_custkey AS VARCHAR) AS cust_id,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
    count(*) AS rows_of_day,
    count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
    count(*) FILTER (WHERE l_linestatus = 'O') AS still_open
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY ALL
),
tel AS (
  SELECT cpe_date, mdn_5g, cust_id, """ + ", ".join(
    f"{rule} AS \"{name}\"" for name, rule in SCORE_RULES.items()
) + """
  FROM sums
)"""

HIST = """
changes AS (
  SELECT cust_id, cust_line_seq_id, acct_num, activity_dt AS eff_dt,
    min(activity_cd) AS first_cd, max(price_cents) AS top_cents
  FROM act GROUP BY ALL
),
hist AS (
  SELECT *, coalesce(CAST(lead(eff_dt) OVER (
      PARTITION BY cust_id, cust_line_seq_id ORDER BY eff_dt) - INTERVAL 1 DAY AS DATE),
    DATE '9999-12-31') AS exp_dt
  FROM changes
),
net AS (
  SELECT cust_id, cust_line_seq_id, eff_dt, exp_dt,
    CASE WHEN top_cents < 30000000 THEN '5G FIXED WIRELESS' ELSE '4G MOBILE' END AS network_type
  FROM hist WHERE first_cd NOT IN ('DE', 'D3')
),
dims AS (
  SELECT cust_id, cust_line_seq_id, eff_dt, exp_dt,
    CASE WHEN top_cents < 15000000 THEN 'B' WHEN top_cents < 30000000 THEN 'C' ELSE 'X' END
      AS dim_value
  FROM hist WHERE top_cents < 45000000
),
accounts AS (
  SELECT cust_id, acct_num, eff_dt, exp_dt FROM hist WHERE top_cents < 45000000
)"""

LOOKUPS = """
plans AS (
  SELECT * FROM (VALUES ('67571', 'Fixed Wireless Home', '4G LTE Home'),
    ('FWH1', 'Fixed Wireless Home', '5G Home C-Band'),
    ('FWH2', 'fixed wireless home', '4G LTE Home'),
    ('FWH3', 'Fixed Wireless Home', NULL)) t(pplan_cd, plan_type, plan_sub_type)
),
reasons AS (
  SELECT * FROM (VALUES ('R0', 'V', 'COMPETITOR OFFER'), ('R1', 'I', 'Moving out of area'),
    ('R2', 'I', 'NON PAYMENT'), ('R3', 'a', NULL), ('R4', 'V', NULL))
    t(change_reas_cd, change_reas_ctgry_cd, change_reas_desc)
),
names AS (
  SELECT * FROM (VALUES ('AC', 'Activation'), ('DE', 'Disconnect'), ('RE', 'Reactivation'))
    t(code, activity_desc)
),
segs AS (
  SELECT * FROM (VALUES ('B', 'Wireless Business Revenue'), ('C', 'Wireless Consumer Revenue'))
    t(segmt_cd, segmt_ctgry_desc)
)"""
REASON = """CASE WHEN change_reas_desc ILIKE '%moving%' THEN 'Movers'
    WHEN upper(change_reas_ctgry_cd) IN ('I', 'A') THEN 'Involuntary'
    WHEN change_reas_desc IS NULL THEN NULL ELSE 'Voluntary' END"""
TECH_LONG = """CASE WHEN a.pplan_cd IN ('67571', '75561') THEN '5G Home C-Band'
    WHEN a.pplan_cd IN ('67567', '75560') THEN '5G Home mmWave'
    WHEN lower(plan_type) = 'fixed wireless home' THEN plan_sub_type ELSE 'Other' END"""
TECH_SHORT = """CASE WHEN a.pplan_cd = '67571' THEN 'C-Band' WHEN a.pplan_cd = '67567' THEN 'MM Wave'
    WHEN lower(plan_type) = 'fixed wireless home' THEN plan_sub_type ELSE 'Other' END"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def _draw(salt: str, key: str) -> str:
    """The row's random number below 2^60."""
    return f"CAST('0x' || substr(md5('{salt}|' || {key}), 1, 15) AS BIGINT)"


def _share(salt: str, key: str, share: float) -> str:
    return f"({_draw(salt, key)} < {round(share * 16**15)})"


# Disconnects with everything joined, before any filter on technology or segment.
def _enriched(tech: str, more: str = "") -> str:
    return _with(ACT, HIST, LOOKUPS, PROFILE) + f""",
raw AS (
  SELECT coalesce(s.segmt_ctgry_desc, 'Wireless Consumer Revenue') AS segment,
    a.cust_id, a.mtn, a.pplan_cd AS price_plan_cd, a.acct_num{more}, e.activity_dt AS deact_dt, e.activity_cd AS deact_cd,
    e.eqp_prod_nm, e.change_reas_cd, {tech} AS technology, min(a.activity_dt) AS act_dt
  FROM act a
  JOIN act e ON a.cust_id = e.cust_id AND a.cust_line_seq_id = e.cust_line_seq_id
    AND e.activity_cd IN ('DE', 'D3') AND e.activity_dt > a.activity_dt
    AND e.rpt_mth >= DATE '1996-01-01'
  LEFT JOIN plans p ON p.pplan_cd = a.pplan_cd
  LEFT JOIN net n ON a.cust_id = n.cust_id AND a.cust_line_seq_id = n.cust_line_seq_id
    AND n.network_type = '5G FIXED WIRELESS'
    AND a.activity_dt + INTERVAL 1 DAY BETWEEN n.eff_dt AND n.exp_dt
  LEFT JOIN dims d ON a.cust_id = d.cust_id AND a.cust_line_seq_id = d.cust_line_seq_id
    AND last_day(a.activity_dt) BETWEEN d.eff_dt AND d.exp_dt
  LEFT JOIN segs s ON s.segmt_cd = d.dim_value
  WHERE a.rpt_mth >= DATE '1996-01-01' AND a.activity_cd IN ('AC', 'RE')
    AND a.prepaid_ind = 'N' AND a.rev_gen_ind = 'Y' AND a.managed_ind = 'C'
    AND a.line_type_cd <> 'T'
    AND (n.cust_id IS NOT NULL OR lower(a.coe_pplan_sub_type_desc)
      IN ('5g business internet', '5g home', '4g lte home'))
  GROUP BY ALL
),
enriched AS (
  SELECT r.*, q.change_reas_ctgry_cd, q.change_reas_desc, m.activity_desc,
    f.chnl_nm, f.install_type, f.sales_dt, f.install_dt,
    CAST(date_trunc('month', deact_dt) AS DATE) AS deact_mth,
    CAST(date_trunc('month', act_dt) AS DATE) AS act_mth,
    CAST(deact_dt - act_dt AS BIGINT) AS days_on, {REASON} AS disco_reason
  FROM raw r
  JOIN accounts h ON h.cust_id = r.cust_id AND h.acct_num = r.acct_num
    AND r.act_dt BETWEEN h.eff_dt AND h.exp_dt
  LEFT JOIN reasons q ON q.change_reas_cd = r.change_reas_cd
  LEFT JOIN names m ON m.code = r.deact_cd
  LEFT JOIN (SELECT DISTINCT cust_id, mtn, chnl_nm, install_type, sales_dt, install_dt
    FROM profile) f ON f.cust_id = r.cust_id AND f.mtn = r.mtn
)"""


def _mean(column: str) -> str:
    """Mean to two decimals, halves away from zero, from whole million millionths."""
    part = f"CAST(round(\"{column}\" * 1000000000000.0) AS HUGEINT)"
    total, n = f"sum({part})", f"count({part})"
    return (
        f"CASE WHEN {n} > 0 THEN sign({total}) * CAST((abs({total}) * 2 + {n} * 10000000000) "
        f"// ({n} * 20000000000) AS DOUBLE) / 100.0 END"
    )


MODEL = [
    "scaled_5g_uptime", "scaled_sqrt_data_usage", "scaled_uploadresult", "scaled_downloadresult",
    "scaled_latency", "scaled_RSRP", "scaled_avg_CQI", "scaled_SNR", "scaled_switch_count_sum",
    "scaled_reset_count", "scaled_avg_MemoryPercentFree", "scaled_percentageReceived",
]
GROUP = (
    "mdn_5g, cust_id, cust_line_seq_id, pplan_cd, eqp_prod_nm, coe_pplan_sub_type_desc, "
    "market_type, order_fulfilment, churn_label"
)


ROW_KEY = "md5(concat_ws('|', " + ", ".join(f"coalesce({c}, '?')" for c in GROUP.split(", ")) + "))"


def _feature_table(panel: str, scores: list[str], signals: list[str]) -> str:
    picked = ", ".join(f'"{c}"' for c in [*scores, *signals])
    means = ", ".join(f'{_mean(c)} AS "{c}"' for c in [*scores, "acct_num"])
    peaks = "".join(f', max("{c}") AS "{c}"' for c in signals)
    return SPAN.replace("FROM tel", f"FROM {panel}") + f""",
stable AS (
  SELECT mdn_5g, cust_id FROM scope GROUP BY ALL
  HAVING count(*) FILTER (WHERE activity_cd = 'AC') = 1
    AND count(*) FILTER (WHERE activity_cd IN ('DE', 'D3')) = 0
),
stayed AS (
  SELECT s.mdn_5g, s.cust_id, s.cust_line_seq_id, s.pplan_cd, s.eqp_prod_nm,
    s.coe_pplan_sub_type_desc, CAST(s.acct_num AS BIGINT) AS acct_num, 'N' AS churn_label, {picked}
  FROM scope s JOIN stable USING (mdn_5g, cust_id) JOIN span t USING (mdn_5g, cust_id)
  WHERE s.activity_cd = 'AC'
  QUALIFY row_number() OVER (PARTITION BY s.mdn_5g, s.cust_id ORDER BY
    md5('days|' || s.mdn_5g || '|' || s.cust_id || '|' || CAST(t.cpe_date AS VARCHAR))) <= 30
),
gone AS (
  SELECT DISTINCT mdn_5g, cust_id, cust_line_seq_id, pplan_cd, eqp_prod_nm,
    coe_pplan_sub_type_desc, acct_num, deact_dt
  FROM ended WHERE deact_cd = 'DE' AND deact_dt > DATE '1996-06-15'
),
churned AS (
  SELECT g.mdn_5g, g.cust_id, g.cust_line_seq_id, g.pplan_cd, g.eqp_prod_nm,
    g.coe_pplan_sub_type_desc, CAST(g.acct_num AS BIGINT) AS acct_num, 'Y' AS churn_label, {picked}
  FROM gone g JOIN span t ON t.mdn_5g = g.mdn_5g AND t.cust_id = g.cust_id
    AND t.cpe_date > g.deact_dt - INTERVAL 30 DAY AND t.cpe_date < g.deact_dt
),
means AS (
  SELECT {GROUP}, {ROW_KEY} AS row_key, {means}{peaks}
  FROM (SELECT * FROM stayed UNION ALL SELECT * FROM churned) u
  LEFT JOIN (SELECT mdn_5g, cust_id, market_type, order_fulfilment FROM profile) f
    USING (mdn_5g, cust_id)
  GROUP BY {GROUP}
),
featured AS (
  SELECT * REPLACE (
    CASE WHEN eqp_prod_nm LIKE '%ARC-XCI55AX' THEN 'ARC-XCI55AX'
      WHEN eqp_prod_nm LIKE '%WNC-CR200A' THEN 'WNC-CR200A'
      WHEN eqp_prod_nm LIKE '%ASK-NCQ1338FA' THEN 'ASK-NCQ1338FA'
      WHEN eqp_prod_nm LIKE '%FSNO21VA' THEN 'FSNO21VA' ELSE 'others' END AS eqp_prod_nm,
    CASE WHEN coe_pplan_sub_type_desc IN ('5G Business Internet mmWave',
      '5G Business Internet C-Band') THEN '5G Business Internet'
      ELSE coalesce(coe_pplan_sub_type_desc, 'unknown') END AS coe_pplan_sub_type_desc,
    coalesce(market_type, 'unknown') AS market_type,
    coalesce(order_fulfilment, 'unknown') AS order_fulfilment)
  FROM means
)"""


CUSUM = """
runs AS (
  SELECT *, sum(25 - quantity) OVER w AS c
  FROM sums JOIN tel USING (cpe_date, mdn_5g, cust_id)
  WINDOW w AS (PARTITION BY mdn_5g, cust_id ORDER BY cpe_date)
),
risk AS (
  SELECT *, CAST(c - least(0, min(c) OVER (
    PARTITION BY mdn_5g, cust_id ORDER BY cpe_date)) AS BIGINT) AS cusum
  FROM runs
)"""

SCORED = """
scored AS (
  SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
    CASE WHEN round(value * 100) >= 1000 THEN 1 ELSE 0 END AS prediction,
    CAST(round(value * 100) AS BIGINT) AS score
  FROM events
)"""

CUSTOMERS = """
bought AS (
  SELECT o_custkey,
    max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
      THEN 1 ELSE 0 END) AS churned,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS revenue_cents,
    CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS cycle
  FROM orders GROUP BY o_custkey
),
people AS (
  SELECT c_custkey AS cust_id, c_mktsegment AS segment, churned, revenue_cents, cycle,
    CASE WHEN round(c_acctbal * 100) < 500000 THEN 1 ELSE 0 END AS predicted,
    CASE WHEN round(c_acctbal * 100) < 0 THEN 5000 ELSE 2500 END AS cost_cents
  FROM customer JOIN bought ON o_custkey = c_custkey
)"""
ARMS = f"""
arms AS (
  SELECT *, CASE WHEN predicted = 1 THEN CASE
    WHEN {_share("offer-1", "CAST(cust_id AS VARCHAR)", 0.3)} THEN 'control'
    ELSE 'treated' END END AS arm
  FROM people
),
pair AS (
  SELECT count(*) FILTER (WHERE arm = 'treated') AS n_treated,
    count(*) FILTER (WHERE arm = 'control') AS n_control,
    count(*) FILTER (WHERE arm = 'treated' AND churned = 1) AS churned_treated,
    count(*) FILTER (WHERE arm = 'control' AND churned = 1) AS churned_control,
    CAST(sum(revenue_cents) FILTER (WHERE arm = 'treated') AS DOUBLE) AS rev_t,
    CAST(sum(revenue_cents) FILTER (WHERE arm = 'control') AS DOUBLE) AS rev_c,
    CAST(sum(revenue_cents) FILTER (WHERE arm = 'treated' AND churned = 1) AS DOUBLE) AS lost_t,
    CAST(sum(revenue_cents) FILTER (WHERE arm = 'control' AND churned = 1) AS DOUBLE) AS lost_c,
    CAST(sum(cost_cents) FILTER (WHERE arm = 'treated') AS DOUBLE) AS promo
  FROM arms
),
rates AS (
  SELECT *, CAST(churned_treated AS DOUBLE) / n_treated AS tr,
    CAST(churned_control AS DOUBLE) / n_control AS cr FROM pair
)"""

ORACLE: dict[str, str] = {}

# ---- codes and filters ------------------------------------------------------------------------

ORACLE["normalise_keys"] = _with(ACT) + """
SELECT cust_id, cust_line_seq_id, mdn_5g, left(mtn, 3) AS mtn3, activity_dt, activity_cd, pplan_cd,
  CAST(acct_num AS BIGINT) AS acct FROM act"""

ORACLE["activity_filter"] = _with(ACT, STARTED, ENDED) + """
SELECT cust_id, mdn_5g, activity_dt, activity_cd FROM started
UNION ALL SELECT cust_id, mdn_5g, deact_dt, deact_cd FROM ended"""

ORACLE["coded_dates"] = _with(ACT) + """
SELECT cust_id, mdn_5g, CAST(strftime(activity_dt, '%Y%m%d') AS INTEGER) - 19000000 AS day_code, activity_dt
FROM act WHERE activity_dt >= DATE '1996-01-01'"""

ORACLE["channel_bucket"] = _with(PROFILE) + "SELECT cust_id, mtn, chnl_nm AS channel FROM profile"

ORACLE["technology_bucket"] = _with(ACT, LOOKUPS) + f"""
SELECT a.pplan_cd, {TECH_LONG} AS tech_long, {TECH_SHORT} AS tech_short, count(*) AS n,
  max(activity_dt) AS last_dt
FROM act a LEFT JOIN plans p ON p.pplan_cd = a.pplan_cd GROUP BY 1, 2, 3"""

ORACLE["disco_reason"] = _with(ACT, ENDED, LOOKUPS) + f"""
SELECT cust_id, mdn_5g, deact_dt, deact_cd, e.change_reas_cd, {REASON} AS disco_reason
FROM ended e LEFT JOIN reasons r ON r.change_reas_cd = e.change_reas_cd"""

ORACLE["plan_bucket"] = _with(ACT) + """
SELECT CASE WHEN coe_pplan_sub_type_desc IN ('5G Business Internet mmWave',
  '5G Business Internet C-Band') THEN '5G Business Internet'
  ELSE coalesce(coe_pplan_sub_type_desc, 'unknown') END AS plan, count(*) AS n
FROM act GROUP BY 1"""

ORACLE["device_model_bucket"] = """
SELECT p_partkey, CASE WHEN split_part(p_name, ' ', -1) IN ('ring', 'bolt', 'widget', 'gear')
  THEN split_part(p_name, ' ', -1) ELSE 'others' END AS device FROM part"""

ORACLE["tenure_days"] = _with(ACT) + """,
lines AS (
  SELECT cust_id, mdn_5g, min(activity_dt) FILTER (WHERE activity_cd IN ('AC', 'RE')) AS act_dt,
    max(activity_dt) FILTER (WHERE activity_cd IN ('DE', 'D3')) AS deact_dt
  FROM act GROUP BY ALL
)
SELECT cust_id, mdn_5g, act_dt, deact_dt, CAST(date_trunc('month', act_dt) AS DATE) AS act_mth,
  last_day(act_dt) AS act_mth_end,
  CAST(coalesce(deact_dt, DATE '2002-01-01') - act_dt AS BIGINT) AS days_on
FROM lines"""

# ---- joins -----------------------------------------------------------------------------------

ORACLE["activation_deactivation_pairs"] = _with(ACT, STARTED, ENDED) + """
SELECT s.cust_id, s.mtn, s.activity_cd, e.deact_dt, e.deact_cd,
  count(DISTINCT s.rid) AS n_activations, min(s.activity_dt) AS first_activity_dt,
  max(s.activity_dt) AS last_activity_dt, count(DISTINCT e.rid) AS n_disconnects,
  count(*) AS n_pairs
FROM (SELECT *, row_number() OVER () AS rid FROM started) s
JOIN (SELECT *, row_number() OVER () AS rid FROM ended) e USING (cust_id, mtn)
GROUP BY s.cust_id, s.mtn, s.activity_cd, e.deact_dt, e.deact_cd"""

ORACLE["churn_table"] = _with(ACT, STARTED, ENDED, PROFILE) + """,
pairs AS (
  SELECT e.*, s.activity_dt FROM started s
  JOIN (SELECT DISTINCT * FROM ended) e ON s.cust_id = e.cust_id AND s.mtn = e.mtn
)
SELECT p.cust_id, p.mtn, cust_line_seq_id, deact_dt, deact_cd, pplan_cd, eqp_prod_nm, change_reas_cd,
  acct_num, coe_pplan_sub_type_desc, count(*) AS n_activations,
  min(activity_dt) AS first_activity_dt, max(activity_dt) AS last_activity_dt,
  chnl_nm, install_type, market_type, order_fulfilment, usage_flag
FROM pairs p LEFT JOIN profile f ON f.cust_id = p.cust_id AND f.mtn = p.mtn
GROUP BY ALL"""

ORACLE["first_activation_before_disconnect"] = _with(ACT) + f"""
SELECT a.cust_id, a.cust_line_seq_id, a.mtn, a.pplan_cd, a.acct_num, a.activity_cd,
  a.coe_pplan_sub_type_desc, e.activity_dt AS deact_dt, e.activity_cd AS deact_cd, e.eqp_prod_nm,
  e.change_reas_cd, min(a.activity_dt) AS act_dt
FROM act a JOIN act e ON a.cust_id = e.cust_id AND a.cust_line_seq_id = e.cust_line_seq_id
  AND e.activity_cd IN ('DE', 'D3') AND e.activity_dt > a.activity_dt
  AND e.rpt_mth >= DATE '1996-01-01'
WHERE a.rpt_mth >= DATE '1996-01-01' AND a.activity_cd IN ('AC', 'RE')
  AND a.prepaid_ind = 'N' AND a.rev_gen_ind = 'Y' AND a.managed_ind = 'C' AND a.line_type_cd <> 'T'
GROUP BY ALL"""

ORACLE["line_profile_left_join"] = _with(ACT, SCOPE, PROFILE) + """
SELECT s.cust_id, s.cust_line_seq_id, s.mtn, activity_dt, activity_cd, pplan_cd, eqp_prod_nm,
  change_reas_cd, acct_num, coe_pplan_sub_type_desc, chnl_nm, install_type, market_type,
  order_fulfilment, usage_flag
FROM scope s LEFT JOIN profile f ON f.cust_id = s.cust_id AND f.mtn = s.mtn"""

ORACLE["install_profile_left_join"] = _with(ACT, SCOPE, PROFILE) + """
SELECT s.* EXCLUDE (mdn_5g, price_cents), chnl_raw AS chnl_nm, install_type, market_type,
  order_fulfilment, usage_flag, sales_dt, install_dt
FROM scope s LEFT JOIN profile f ON f.cust_id = s.cust_id AND f.mtn = s.mtn"""

ORACLE["dedup_profile_join"] = _with(ACT, ENDED, PROFILE) + """
SELECT e.cust_id, e.mtn, deact_dt, deact_cd, chnl_nm, install_type, sales_dt, install_dt
FROM ended e LEFT JOIN (SELECT cust_id, mtn, chnl_raw AS chnl_nm, install_type, sales_dt, install_dt
  FROM profile GROUP BY 1, 2, 3, 4, 5, 6) f ON f.cust_id = e.cust_id AND f.mtn = e.mtn"""

ORACLE["scd2_lookup"] = _with(ACT, HIST) + """
SELECT a.cust_id, a.cust_line_seq_id, activity_dt, activity_cd, eff_dt, exp_dt, network_type
FROM act a LEFT JOIN net n ON a.cust_id = n.cust_id AND a.cust_line_seq_id = n.cust_line_seq_id
  AND a.activity_dt + INTERVAL 1 DAY BETWEEN n.eff_dt AND n.exp_dt"""

ORACLE["scd2_month_end"] = _with(ACT, HIST, LOOKUPS) + """
SELECT a.cust_id, a.cust_line_seq_id, activity_dt, activity_cd,
  coalesce(segmt_ctgry_desc, 'Wireless Consumer Revenue') AS segment
FROM act a LEFT JOIN dims d ON a.cust_id = d.cust_id AND a.cust_line_seq_id = d.cust_line_seq_id
  AND last_day(a.activity_dt) BETWEEN d.eff_dt AND d.exp_dt
LEFT JOIN segs ON segmt_cd = dim_value"""

ORACLE["scd2_inner"] = _with(ACT, HIST) + """
SELECT a.cust_id, a.acct_num, activity_dt, activity_cd, eff_dt, exp_dt
FROM act a JOIN accounts h ON h.cust_id = a.cust_id AND h.acct_num = a.acct_num
  AND a.activity_dt BETWEEN h.eff_dt AND h.exp_dt"""

ORACLE["eligible_by_history_or_plan"] = _with(ACT, HIST) + f"""
SELECT a.cust_id, a.cust_line_seq_id, activity_dt, activity_cd, coe_pplan_sub_type_desc
FROM act a LEFT JOIN net n ON a.cust_id = n.cust_id AND a.cust_line_seq_id = n.cust_line_seq_id
  AND n.network_type = '5G FIXED WIRELESS'
  AND a.activity_dt + INTERVAL 1 DAY BETWEEN n.eff_dt AND n.exp_dt
WHERE rpt_mth >= DATE '1996-01-01' AND activity_cd IN ('AC', 'RE') AND {IS_ELIGIBLE}
  AND (n.cust_id IS NOT NULL OR lower(coe_pplan_sub_type_desc)
    IN ('5g business internet', '5g home', '4g lte home'))"""

ORACLE["disconnect_enriched"] = _enriched(
    TECH_LONG, ", a.activity_cd AS act_cd, a.coe_pplan_sub_type_desc AS pplan_desc"
) + """
SELECT * EXCLUDE (act_cd) FROM enriched WHERE lower(technology) <> 'other'"""

ORACLE["latest_disconnect"] = _enriched(TECH_SHORT) + """,
last AS (
  SELECT * FROM enriched WHERE segment = 'Wireless Consumer Revenue'
  QUALIFY rank() OVER (PARTITION BY cust_id, mtn ORDER BY deact_dt DESC) = 1
)
SELECT segment, price_plan_cd, deact_cd, eqp_prod_nm, technology, act_mth, act_dt, deact_dt,
  deact_mth, days_on, disco_reason, activity_desc, change_reas_desc, chnl_nm, install_type,
  sales_dt, install_dt, left(mtn, 10) AS mtn, cust_id
FROM last WHERE lower(technology) <> 'other'"""

# ---- telemetry panels -------------------------------------------------------------------------

ORACLE["telemetry_range_scan"] = _with(ACT, CHURNED, TEL, SPAN) + "SELECT * FROM span"

ORACLE["latest_score_date"] = _with(TEL) + """
SELECT mdn_5g, cust_id, max(cpe_date) AS latest_score_date FROM tel GROUP BY ALL"""

ORACLE["churned_with_telemetry"] = _with(ACT, CHURNED, TEL) + """
SELECT mdn_5g, cust_id, deact_dt, deact_cd FROM ended e
WHERE EXISTS (SELECT 1 FROM tel t WHERE t.mdn_5g = e.mdn_5g AND t.cust_id = e.cust_id)"""

ORACLE["churn_lookback_panel"] = _with(ACT, CHURNED, TEL) + """
SELECT t.*, deact_dt, deact_cd
FROM (SELECT DISTINCT mdn_5g, cust_id, deact_dt, deact_cd FROM ended) e
JOIN tel t ON t.mdn_5g = e.mdn_5g AND t.cust_id = e.cust_id
  AND t.cpe_date BETWEEN e.deact_dt - INTERVAL 30 DAY AND e.deact_dt"""

_STABLE = """,
stable AS (
  SELECT mdn_5g, cust_id FROM scope GROUP BY ALL
  HAVING count(*) FILTER (WHERE activity_cd = 'AC') = 1
    AND count(*) FILTER (WHERE activity_cd IN ('DE', 'D3')) = 0
)"""
ORACLE["stable_active_lines"] = _with(ACT, SCOPE) + _STABLE + """
SELECT mdn_5g, cust_id, activity_dt, pplan_cd, acct_num
FROM scope JOIN stable USING (mdn_5g, cust_id) WHERE activity_cd = 'AC'"""

ORACLE["active_panel"] = _with(ACT, CHURNED, SCOPE, TEL, SPAN) + _STABLE + """
SELECT t.*, activity_dt, pplan_cd, acct_num
FROM scope s JOIN stable USING (mdn_5g, cust_id)
JOIN span t ON t.mdn_5g = s.mdn_5g AND t.cust_id = s.cust_id
WHERE activity_cd IN ('AC', 'D3', 'DE')"""

ORACLE["panel_row_counts"] = _with(TEL) + """
SELECT cpe_date, mdn_5g, cust_id, scaled_latency,
  count(*) OVER (PARTITION BY mdn_5g, cust_id) AS total_rows FROM tel"""

ORACLE["sample_days_per_line"] = _with(TEL) + """
SELECT cpe_date, mdn_5g, cust_id, scaled_latency FROM tel
QUALIFY row_number() OVER (PARTITION BY mdn_5g, cust_id ORDER BY
  md5('days|' || mdn_5g || '|' || cust_id || '|' || CAST(cpe_date AS VARCHAR)), cpe_date) <= 10"""

# ---- features --------------------------------------------------------------------------------

ORACLE["churn_feature_table"] = (
    _with(ACT, SCOPE, CHURNED, PROFILE, TEL, _feature_table("tel", MODEL, []))
    + "SELECT * EXCLUDE (row_key) FROM featured"
)

_LEVELS = [
    ("eqp_prod_nm", ["ARC-XCI55AX", "WNC-CR200A", "ASK-NCQ1338FA", "FSNO21VA", "others"]),
    ("coe_pplan_sub_type_desc",
     ["5G Business Internet", "5G Home mmWave", "5G Home C-Band", "4G LTE Home"]),
    ("market_type", ["East", "South", "West", "Headquarters", "unknown"]),
    ("order_fulfilment", ["LOCALLY_FULFILLED", "SHIPPED", "unknown"]),
]
_EXACT_MEAN = """CAST(sum(CAST(round("{c}" * 1000000000000.0) AS HUGEINT)) AS DOUBLE)
    / (CAST(count("{c}") AS DOUBLE) * 1000000000000.0)"""
_MATRIX = (
    "SELECT mdn_5g, cust_id, row_key, acct_num, "
    + ", ".join(f'"{c}"' for c in MODEL)
    + ", "
    + ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, vs in _LEVELS for v in vs
    )
    + ", CASE churn_label WHEN 'Y' THEN 1 ELSE 0 END AS churn_label FROM featured"
)
_FEATURED = _with(ACT, SCOPE, CHURNED, PROFILE, TEL, _feature_table("tel", MODEL, []))
ORACLE["one_hot_fixed"] = _FEATURED + f"SELECT * EXCLUDE (row_key) FROM ({_MATRIX})"
ORACLE["candidate_chain"] = ORACLE["one_hot_fixed"]

_SIDES = _FEATURED + f""",
sides AS (SELECT *, {_share("split", "mdn_5g || '|' || cust_id", 0.3)} AS is_test FROM ({_MATRIX}))"""
ORACLE["training_rows"] = _SIDES + f""",
donors AS (
  SELECT scaled_5g_uptime AS v, row_number() OVER (ORDER BY md5('donor|' || row_key)) AS donor
  FROM sides WHERE NOT is_test AND scaled_5g_uptime IS NOT NULL
),
needy AS (
  SELECT *, CASE WHEN scaled_5g_uptime IS NULL
    THEN {_draw("donor", "row_key")} % (SELECT count(*) FROM donors) + 1 END AS donor FROM sides
),
filled AS (
  SELECT * EXCLUDE (donor, v) REPLACE (coalesce(scaled_5g_uptime, v) AS scaled_5g_uptime)
  FROM needy LEFT JOIN donors USING (donor)
),
training AS (
  SELECT * EXCLUDE (is_test, acct_num) REPLACE ({", ".join(
    f'coalesce("{c}", (SELECT {_EXACT_MEAN.format(c=c)} FROM filled WHERE NOT is_test)) AS "{c}"'
    for c in MODEL)})
  FROM filled WHERE NOT is_test
)
SELECT * FROM training
QUALIFY row_number() OVER (PARTITION BY churn_label ORDER BY md5('balance|' || row_key))
  <= (SELECT min(n) FROM (SELECT count(*) AS n FROM training GROUP BY churn_label))"""
ORACLE["rf_train_score"] = _SIDES + """
SELECT mdn_5g, cust_id, is_test, churn_label AS label, true AS is_probability, true AS prediction_agrees
FROM sides"""
ORACLE["rf_evaluation"] = _SIDES + """,
counted AS (
  SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS side, churn_label, count(*) AS n
  FROM sides GROUP BY ALL
)
SELECT side, CAST(churn_label AS VARCHAR) AS class, n AS support, true AS are_ratios FROM counted
UNION ALL SELECT side, name, CAST(sum(n) AS BIGINT), true FROM counted
  CROSS JOIN (SELECT unnest(['accuracy', 'macro avg', 'weighted avg']) AS name) GROUP BY side, name"""
ORACLE["feature_importance"] = _SIDES + f"""
SELECT feature, true AS is_share, true AS adds_up
FROM (SELECT unnest([{", ".join(f"'{c}'" for c in [*MODEL, *(f"{c}_{v}" for c, vs in _LEVELS for v in vs)])}])
  AS feature) WHERE (SELECT count(*) FROM sides) > 0"""

_CELL = "mdn_5g || '|' || cust_id || '|' || CAST(cpe_date AS VARCHAR)"
ORACLE["impute_hot_deck"] = _with(TEL) + f""",
donors AS (
  SELECT scaled_5g_uptime AS v, row_number() OVER (ORDER BY md5('donor|' || {_CELL})) AS donor
  FROM tel WHERE scaled_5g_uptime IS NOT NULL
),
needy AS (
  SELECT *, CASE WHEN scaled_5g_uptime IS NULL
    THEN {_draw("donor", _CELL)} % (SELECT count(*) FROM donors) + 1 END AS donor FROM tel
)
SELECT cpe_date, mdn_5g, cust_id, coalesce(scaled_5g_uptime, v) AS scaled_5g_uptime,
  scaled_downloadresult
FROM needy LEFT JOIN donors USING (donor)"""

_TWO = ["scaled_5g_uptime", "scaled_downloadresult"]
ORACLE["impute_mean"] = _with(TEL) + f"""
SELECT cpe_date, mdn_5g, cust_id,
  {", ".join(f"coalesce({c}, (SELECT {_EXACT_MEAN.format(c=c)} FROM tel)) AS {c}" for c in _TWO)}
FROM tel"""

ORACLE["impute_mean_train_only"] = _with(TEL) + f""",
sides AS (
  SELECT cpe_date, mdn_5g, cust_id, {", ".join(_TWO)},
    {_share("split", "mdn_5g || '|' || cust_id", 0.3)} AS is_test FROM tel
)
SELECT cpe_date, mdn_5g, cust_id, is_test, {", ".join(
    f"coalesce({c}, (SELECT {_EXACT_MEAN.format(c=c)} FROM sides WHERE NOT is_test)) AS {c}"
    for c in _TWO)}
FROM sides"""

ORACLE["class_balance"] = _with(SCORED) + """
SELECT event_id, day, label, prediction, score FROM scored
QUALIFY row_number() OVER (PARTITION BY label ORDER BY
  md5('balance|' || CAST(event_id AS VARCHAR)), event_id)
  <= (SELECT min(n) FROM (SELECT count(*) AS n FROM scored GROUP BY label))"""

ORACLE["train_test_split"] = _with(CUSTOMERS) + f"""
SELECT cust_id, churned, {_share("split", "CAST(cust_id AS VARCHAR)", 0.3)} AS is_test FROM people"""

# ---- evaluation ------------------------------------------------------------------------------

ORACLE["confusion_matrix"] = _with(SCORED) + """
SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction"""

ORACLE["classification_metrics"] = _with(SCORED) + """,
cells AS (
  SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
    count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
    count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM scored
),
per AS (
  SELECT CAST(tn AS DOUBLE) / (tn + fn) AS p0, CAST(tp AS DOUBLE) / (tp + fp) AS p1,
    CAST(tn AS DOUBLE) / (tn + fp) AS r0, CAST(tp AS DOUBLE) / (tp + fn) AS r1,
    CAST(2 * tn AS DOUBLE) / (2 * tn + fn + fp) AS f0,
    CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1,
    CAST(tn + tp AS DOUBLE) / (tn + tp + fn + fp) AS acc, tn + fp AS n0, tp + fn AS n1,
    tn + tp + fn + fp AS n FROM cells
)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM per
UNION ALL SELECT '1', p1, r1, f1, n1 FROM per
UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM per
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM per
UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n,
  (f0 * n0 + f1 * n1) / n, n FROM per"""

ORACLE["roc_auc"] = _with(SCORED) + """,
ranked AS (
  SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r
  FROM scored
),
parts AS (
  SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg,
    sum(2 * r) FILTER (WHERE label = 1) AS r2 FROM ranked
)
SELECT n_pos, n_neg, (r2 - CAST(n_pos AS DOUBLE) * (n_pos + 1))
  / (CAST(n_pos AS DOUBLE) * n_neg * 2) AS roc_auc FROM parts"""

_SWEEP = _with(SCORED) + """,
per AS (
  SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
    count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY score
),
swept AS (
  SELECT threshold, CAST(sum(pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp,
    CAST(sum(neg) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp FROM per
),
full_ AS (
  SELECT *, (SELECT count(*) FROM scored WHERE label = 1) - tp AS fn FROM swept
)
SELECT threshold, tp, fp, fn, CAST(tp AS DOUBLE) / (tp + fp) AS precision,
  CAST(tp AS DOUBLE) / (tp + fn) AS recall, CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1
FROM full_"""
ORACLE["threshold_sweep"] = _SWEEP
ORACLE["best_threshold"] = _SWEEP + " ORDER BY f1 DESC, threshold DESC LIMIT 1"

ORACLE["performance_drift"] = _with(SCORED) + """,
per AS (
  SELECT day, count(*) AS n, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM scored GROUP BY day
),
rated AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM per
)
SELECT *, precision - first_value(precision) OVER (ORDER BY day) AS precision_drift,
  recall - first_value(recall) OVER (ORDER BY day) AS recall_drift FROM rated"""

ORACLE["weighted_examples"] = _with(SCORED) + """
SELECT *, CAST(count(*) OVER () AS DOUBLE)
  / CAST(2 * count(*) OVER (PARTITION BY label) AS DOUBLE) AS class_weight FROM scored"""

ORACLE["class_weights"] = _with(SCORED) + """
SELECT label, count(*) AS n, CAST((SELECT count(*) FROM scored) AS DOUBLE)
  / CAST(count(*) * (SELECT count(DISTINCT label) FROM scored) AS DOUBLE) AS weight
FROM scored GROUP BY label"""

# ---- methodology -----------------------------------------------------------------------------

ORACLE["leakage_safe_windows"] = _with(ACT, CHURNED, TEL) + """,
first_seen AS (
  SELECT mdn_5g, cust_id, CAST(date_trunc('month', min(cpe_date)) AS DATE) AS first_month
  FROM sums GROUP BY ALL
),
obs AS (
  SELECT mdn_5g, cust_id, first_month, count(*) AS obs_rows,
    CAST(sum(quantity) AS BIGINT) AS obs_quantity, CAST(sum(returned) AS BIGINT) AS obs_returned
  FROM sums JOIN first_seen USING (mdn_5g, cust_id)
  WHERE cpe_date < first_month + INTERVAL 3 MONTH GROUP BY ALL
)
SELECT o.*, CASE WHEN EXISTS (SELECT 1 FROM ended e WHERE e.mdn_5g = o.mdn_5g
    AND e.deact_dt >= first_month + INTERVAL 4 MONTH
    AND e.deact_dt < first_month + INTERVAL 6 MONTH) THEN 1 ELSE 0 END AS label
FROM obs o WHERE NOT EXISTS (SELECT 1 FROM ended e WHERE e.mdn_5g = o.mdn_5g
  AND e.deact_dt < first_month + INTERVAL 4 MONTH)
  AND first_month + INTERVAL 6 MONTH <= (SELECT max(activity_dt) FROM act) + INTERVAL 1 DAY"""

ORACLE["static_as_channel"] = _with(TEL, PROFILE) + """
SELECT t.mdn_5g, t.cust_id, cpe_date, scaled_latency, "scaled_SNR",
  CAST(row_number() OVER (PARTITION BY t.mdn_5g, t.cust_id ORDER BY cpe_date) AS INTEGER) AS step,
  market_type, install_type
FROM tel t LEFT JOIN profile f ON f.mdn_5g = t.mdn_5g AND f.cust_id = t.cust_id"""

ORACLE["static_channel_sequences"] = _with(TEL, PROFILE) + """
SELECT s.mdn_5g, s.cust_id, CAST(count(*) AS INTEGER) AS n_steps,
  string_agg(CAST(quantity - 25 AS VARCHAR) || ':' || install_type, ',' ORDER BY cpe_date) AS steps
FROM sums s JOIN profile f ON f.mdn_5g = s.mdn_5g AND f.cust_id = s.cust_id
GROUP BY s.mdn_5g, s.cust_id"""

ORACLE["cusum_signal"] = _with(TEL, CUSUM) + """
SELECT cpe_date, mdn_5g, cust_id, "scaled_SNR", cusum FROM risk"""

ORACLE["two_stage_features"] = (
    _with(
        ACT, SCOPE, CHURNED, PROFILE, TEL, CUSUM, _feature_table("risk", ["scaled_latency"], ["cusum"])
    )
    + "SELECT * EXCLUDE (row_key) FROM featured"
)

ORACLE["segment_churn_rates"] = _with(CUSTOMERS) + """
SELECT segment, count(*) AS n, CAST(sum(churned) AS BIGINT) AS n_churned,
  CAST(sum(churned) AS DOUBLE) / count(*) AS rate,
  CAST(sum(churned) AS DOUBLE) / count(*)
    - (SELECT CAST(sum(churned) AS DOUBLE) / count(*) FROM people) AS effect
FROM people GROUP BY segment"""

ORACLE["segment_signal_effect"] = _with(CUSTOMERS) + """,
per AS (
  SELECT segment, count(*) FILTER (WHERE predicted = 1) AS n_signal,
    count(*) FILTER (WHERE predicted = 1 AND churned = 1) AS churned_signal,
    count(*) FILTER (WHERE predicted = 0) AS n_quiet,
    count(*) FILTER (WHERE predicted = 0 AND churned = 1) AS churned_quiet
  FROM people GROUP BY segment
),
rated AS (
  SELECT *, CASE WHEN n_signal = 0 THEN 0.0 ELSE CAST(churned_signal AS DOUBLE) / n_signal END
    AS rate_signal,
    CASE WHEN n_quiet = 0 THEN 0.0 ELSE CAST(churned_quiet AS DOUBLE) / n_quiet END AS rate_quiet
  FROM per
)
SELECT *, rate_signal - rate_quiet AS effect FROM rated"""

ORACLE["inactivity_label"] = _with(ACT) + """,
days AS (
  SELECT DISTINCT cust_id, mdn_5g, activity_dt FROM act
),
nexts AS (
  SELECT *, lead(activity_dt) OVER (PARTITION BY cust_id, mdn_5g ORDER BY activity_dt) AS next_day
  FROM days
),
gaps AS (
  SELECT *, CAST(coalesce(next_day, (SELECT max(activity_dt) FROM act)) - activity_dt AS BIGINT)
    AS gap_days FROM nexts
)
SELECT *, CASE WHEN gap_days > 60 THEN 1 ELSE 0 END AS churned,
  CASE WHEN next_day IS NULL AND gap_days <= 60 THEN 1 ELSE 0 END AS censored FROM gaps"""

ORACLE["holdout_assignment"] = _with(CUSTOMERS, ARMS) + "SELECT cust_id, predicted, arm FROM arms"

ORACLE["holdout_lift"] = _with(CUSTOMERS, ARMS) + """
SELECT n_treated, n_control, churned_treated, churned_control, tr AS rate_treated,
  cr AS rate_control, cr - tr AS rate_difference, (cr - tr) / cr AS relative_lift FROM rates"""

ORACLE["shadow_tracking"] = _with(CUSTOMERS) + f""",
per AS (
  SELECT cycle, count(*) AS n, count(*) FILTER (WHERE churned = 1) AS n_churned
  FROM people WHERE predicted = 1 AND {_share("shadow-1", "CAST(cust_id AS VARCHAR)", 0.2)}
  GROUP BY cycle
),
rated AS (
  SELECT *, CAST(n_churned AS DOUBLE) / n AS rate FROM per
)
SELECT *, rate - first_value(rate) OVER (ORDER BY cycle) AS drift FROM rated"""

ORACLE["outcome_taxonomy"] = _with(CUSTOMERS, ARMS) + """
SELECT CASE WHEN predicted = 0 THEN CASE churned WHEN 1 THEN 'missed churner' ELSE 'quiet' END
    WHEN arm = 'treated' THEN CASE churned WHEN 1 THEN 'lost despite offer'
      ELSE 'stayed after offer' END
    WHEN churned = 1 THEN 'confirmed churner' ELSE 'false alarm' END AS outcome,
  count(*) AS n, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents
FROM arms GROUP BY 1"""

ORACLE["retention_kpis"] = _with(CUSTOMERS, ARMS) + """,
money AS (
  SELECT cr - tr AS net_churn_reduction, (cr - tr) * CAST(n_treated AS DOUBLE) AS saved_customers,
    (lost_c / rev_c * rev_t - lost_t) / 100.0 AS revenue_retained, promo / 100.0 AS promo_cost,
    (cr - tr) / cr AS lift FROM rates
)
SELECT *, CASE WHEN saved_customers > 0 THEN promo_cost / saved_customers END AS cost_per_saved,
  revenue_retained - promo_cost AS net_savings,
  (revenue_retained - promo_cost) / promo_cost AS roi FROM money"""

ORACLE["lead_time_curve"] = _with(ACT, CHURNED, SCOPE, TEL, CUSUM) + _STABLE + """,
anchors AS (
  SELECT mdn_5g, cust_id, CAST(arg_min(cpe_date, md5('lead|' || mdn_5g || '|' || cust_id || '|'
    || CAST(cpe_date AS VARCHAR))) + INTERVAL 1 DAY AS DATE) AS deact_dt FROM tel GROUP BY ALL
),
events_ AS (
  SELECT DISTINCT mdn_5g, cust_id, deact_dt, false AS stayed FROM ended
  UNION ALL SELECT mdn_5g, cust_id, deact_dt, true FROM stable JOIN anchors USING (mdn_5g, cust_id)
),
hits AS (
  SELECT gap_days, e.mdn_5g, e.cust_id, e.deact_dt, stayed, max(cusum) AS peak
  FROM events_ e CROSS JOIN (SELECT unnest([0, 15, 30, 60, 90]) AS gap_days) g
  JOIN risk r ON r.mdn_5g = e.mdn_5g AND r.cust_id = e.cust_id
    AND e.deact_dt - r.cpe_date BETWEEN gap_days AND gap_days + 29
  GROUP BY ALL
),
counted AS (
  SELECT g.gap_days, count(peak) FILTER (WHERE NOT stayed) AS n_observed,
    count(*) FILTER (WHERE NOT stayed AND peak >= 40) AS n_flagged,
    count(peak) FILTER (WHERE stayed) AS n_stayed,
    count(*) FILTER (WHERE stayed AND peak >= 40) AS n_false_alarms
  FROM (SELECT unnest([0, 15, 30, 60, 90]) AS gap_days) g LEFT JOIN hits h ON h.gap_days = g.gap_days
  GROUP BY g.gap_days
)
SELECT CAST(gap_days AS INTEGER) AS gap_days, n_observed, n_flagged,
  CASE WHEN n_observed = 0 THEN 0.0 ELSE CAST(n_flagged AS DOUBLE) / n_observed END AS share_flagged,
  n_stayed, n_false_alarms, CASE WHEN n_flagged + n_false_alarms = 0 THEN 0.0
    ELSE CAST(n_flagged AS DOUBLE) / (n_flagged + n_false_alarms) END AS precision
FROM counted"""

ORACLE["equal_window_features"] = (
    _with(ACT, SCOPE, CHURNED, PROFILE, TEL)
    + "," + _feature_table("tel", ["scaled_latency", "scaled_SNR"], []).replace(
        # Lines that stayed: the open window before the day after a random one of their days.
        """WHERE s.activity_cd = 'AC'
  QUALIFY row_number() OVER (PARTITION BY s.mdn_5g, s.cust_id ORDER BY
    md5('days|' || s.mdn_5g || '|' || s.cust_id || '|' || CAST(t.cpe_date AS VARCHAR))) <= 30""",
        """JOIN (SELECT mdn_5g, cust_id, CAST(arg_min(cpe_date, md5('days|' || mdn_5g || '|' || cust_id
    || '|' || CAST(cpe_date AS VARCHAR))) + INTERVAL 1 DAY AS DATE) AS anchor FROM span GROUP BY ALL) a
    USING (mdn_5g, cust_id)
  WHERE s.activity_cd = 'AC' AND t.cpe_date > anchor - INTERVAL 30 DAY AND t.cpe_date < anchor""",
    ).replace("GROUP BY " + GROUP, "GROUP BY " + GROUP + " HAVING count(*) >= 2")
    + "SELECT * EXCLUDE (row_key) FROM featured"
)

# ---- prepared once, applied later -------------------------------------------------------------------

_HALVES = _FEATURED + f""",
halves AS (SELECT *, {_share("half", "mdn_5g || '|' || cust_id", 0.5)} AS first_half FROM featured),
learning AS (SELECT * FROM halves WHERE first_half AND order_fulfilment <> 'unknown'),
donors AS (
  SELECT scaled_5g_uptime AS v, row_number() OVER (ORDER BY md5('donor|' || row_key)) AS donor
  FROM learning WHERE scaled_5g_uptime IS NOT NULL
),
needy AS (
  SELECT *, CASE WHEN scaled_5g_uptime IS NULL
    THEN {_draw("donor", "row_key")} % (SELECT count(*) FROM donors) + 1 END AS donor FROM halves
),
filled AS (
  SELECT * EXCLUDE (donor, v) REPLACE (coalesce(scaled_5g_uptime, v) AS scaled_5g_uptime)
  FROM needy LEFT JOIN donors USING (donor)
),
levels AS (
  SELECT DISTINCT place, name, level FROM (""" + " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS name, {c} AS level FROM learning" for i, (c, _) in enumerate(_LEVELS)
) + """)
)"""
ORACLE["prepared_matrix"] = _HALVES + f"""
SELECT mdn_5g, cust_id, row_key, churn_label, {", ".join(
    f'coalesce("{c}", (SELECT {_EXACT_MEAN.format(c=c)} FROM filled WHERE first_half '
    f"AND order_fulfilment <> 'unknown')) AS \"{c}\"" for c in MODEL)},
  (SELECT coalesce(string_agg(name || '_' || level, ',' ORDER BY place, level), '') FROM levels
   WHERE level = CASE place {" ".join(f"WHEN {i} THEN {c}" for i, (c, _) in enumerate(_LEVELS))} END) AS flags,
  (SELECT count(*) FROM levels) AS n_flags
FROM filled WHERE NOT first_half"""

ORACLE["incremental_panel"] = _with(TEL) + f"""
SELECT mdn_5g, cust_id, count(*) AS n_rows, min(cpe_date) AS first_day, max(cpe_date) AS last_day,
  {_mean("scaled_latency")} AS scaled_latency, {_mean("scaled_downloadresult")} AS scaled_downloadresult
FROM tel GROUP BY mdn_5g, cust_id"""

# ---- histories of any length -------------------------------------------------------------------------


def _records(longest: tuple[int, int, int, int]) -> str:
    return f"""
records AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cust_id, eff_dt, o_orderkey AS recorded, o_orderkey % 5 = 0 AS is_late,
    CAST(eff_dt + CAST((o_orderkey * 7919) % 1000003 % {list(longest)}[o_orderkey % 4 + 1] AS INTEGER) AS DATE) AS exp_dt,
    'P' || CAST(o_orderkey % 3 AS VARCHAR) AS plan
  FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS eff_dt FROM orders)
)"""


ORACLE["interval_lookup"] = _with(ACT, _records((1, 40, 800, 18_250))) + """
SELECT a.cust_id, activity_dt, activity_cd, eff_dt, exp_dt, plan
FROM act a LEFT JOIN records r ON a.cust_id = r.cust_id AND activity_dt BETWEEN eff_dt AND exp_dt"""

# Day by day: who wins each, and runs of days with the same plan.
ORACLE["history_resolved"] = _with(_records((1, 20, 90, 400))) + """,
days AS (
  SELECT cust_id, day, arg_max(plan, recorded) AS plan
  FROM (SELECT cust_id, recorded, plan, CAST(unnest(range(eff_dt, exp_dt + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day
    FROM records) GROUP BY cust_id, day
),
runs AS (
  SELECT *, day - CAST(row_number() OVER (PARTITION BY cust_id, plan ORDER BY day) AS INTEGER) AS run FROM days
)
SELECT cust_id, min(day) AS eff_dt, max(day) AS exp_dt, plan FROM runs GROUP BY cust_id, plan, run"""
# Late records win over all others, whatever their number.
ORACLE["history_late_merge"] = ORACLE["history_resolved"].replace(
    "arg_max(plan, recorded)", "arg_max(plan, recorded + CASE WHEN is_late THEN 1000000000000 ELSE 0 END)"
).replace("SELECT cust_id, recorded, plan, CAST(", "SELECT cust_id, recorded, is_late, plan, CAST(")

# ---- segments, survival, uncertainty -------------------------------------------------------------------

_DESCRIBED = ["segment", "chnl_nm", "install_type", "market_type", "order_fulfilment", "usage_flag", "month"]
ORACLE["subgroup_search"] = _with(CUSTOMERS, PROFILE) + f""",
described AS (
  SELECT p.cust_id, churned, segment, chnl_raw AS chnl_nm, install_type, market_type, order_fulfilment, usage_flag,
    'M' || CAST(month(cycle) AS VARCHAR) AS month
  FROM people p JOIN profile f ON CAST(p.cust_id AS VARCHAR) = f.cust_id AND f.mtn = f.cust_id || '1'
),
one AS ({" UNION ALL ".join(
    f"SELECT cust_id, churned, {i} AS place, '{c}=' || {c} AS part FROM described WHERE {c} IS NOT NULL"
    for i, c in enumerate(_DESCRIBED))}),
groups_ AS (
  SELECT 1 AS depth, part AS subgroup, count(*) AS n, sum(churned) AS p FROM one GROUP BY part
  UNION ALL
  SELECT 2, a.part || ' & ' || b.part, count(*), sum(a.churned) FROM one a JOIN one b
    ON a.cust_id = b.cust_id AND a.place < b.place GROUP BY a.part, b.part
),
whole AS (SELECT count(*) AS big_n, sum(churned) AS big_p FROM described),
rated AS (
  SELECT depth, subgroup, n, CAST(p AS BIGINT) AS n_labelled, CAST(p * big_n - n * big_p AS DECIMAL(38,0)) AS quality,
    CAST(p * big_n - n * big_p AS DOUBLE) / (CAST(big_n AS DOUBLE) * CAST(big_n AS DOUBLE)) AS wracc FROM groups_, whole
)
SELECT CAST(depth AS INTEGER) AS depth, subgroup, n, n_labelled, wracc FROM rated
ORDER BY quality DESC, depth, subgroup LIMIT 20"""

_MODELLED = _with(CUSTOMERS) + """,
modelled AS (
  SELECT segment, churned AS y, predicted AS x2, CAST(revenue_cents // 10000000 AS BIGINT) AS x1, 1 + cust_id % 3 AS w FROM people
)"""
# Cramer's rule on whole numbers.
ORACLE["segment_least_squares"] = _MODELLED + """,
s AS (
  SELECT segment, count(*) AS n, sum(w)::HUGEINT AS a, sum(w * x1)::HUGEINT AS b, sum(w * x2)::HUGEINT AS c,
    sum(w * x1 * x1)::HUGEINT AS d, sum(w * x1 * x2)::HUGEINT AS e, sum(w * x2 * x2)::HUGEINT AS f,
    sum(w * y)::HUGEINT AS p, sum(w * x1 * y)::HUGEINT AS q, sum(w * x2 * y)::HUGEINT AS r
  FROM modelled GROUP BY segment
),
t AS (SELECT *, CAST(a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS DOUBLE) AS det FROM s)
SELECT segment, n,
  CASE WHEN det <> 0 THEN round(CAST(p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r) AS DOUBLE) / det, 6) END AS b_0,
  CASE WHEN det <> 0 THEN round(CAST(a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c) AS DOUBLE) / det, 6) END AS b_1,
  CASE WHEN det <> 0 THEN round(CAST(a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c) AS DOUBLE) / det, 6) END AS b_2
FROM t"""

# With one 0/1 input the model fits both rates, so the odds are known without any rounds.
ORACLE["segment_logistic"] = _MODELLED + """,
c AS (
  SELECT segment, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_labelled,
    CAST(sum(y) FILTER (WHERE x2 = 0) AS DOUBLE) AS y0, CAST(count(*) FILTER (WHERE x2 = 0) AS DOUBLE) AS n0,
    CAST(sum(y) FILTER (WHERE x2 = 1) AS DOUBLE) AS y1, CAST(count(*) FILTER (WHERE x2 = 1) AS DOUBLE) AS n1
  FROM modelled GROUP BY segment
)
SELECT segment, n, n_labelled, round(ln(y0 / (n0 - y0)), 6) AS b_0, round(ln(y1 / (n1 - y1)) - ln(y0 / (n0 - y0)), 6) AS b_1 FROM c"""

ORACLE["cusum_alarms"] = "WITH RECURSIVE " + TEL + """,
steps AS (
  SELECT mdn_5g, cust_id, cpe_date, 25 - quantity AS d,
    row_number() OVER (PARTITION BY mdn_5g, cust_id ORDER BY cpe_date) AS i FROM sums WHERE quantity <> 30
),
fold(mdn_5g, cust_id, i, day, total, n, until, alarm, peak, took) AS (
  SELECT DISTINCT mdn_5g, cust_id, CAST(0 AS BIGINT), CAST(NULL AS DATE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS DATE),
    CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM steps
  UNION ALL
  SELECT mdn_5g, cust_id, i, cpe_date,
    CASE WHEN rests THEN total WHEN now >= 40 THEN 0 ELSE now END, CASE WHEN rests THEN n WHEN now >= 40 THEN 0 ELSE n + 1 END,
    CASE WHEN NOT rests AND now >= 40 THEN CAST(cpe_date + INTERVAL 7 DAY AS DATE) ELSE until END,
    CASE WHEN NOT rests AND now >= 40 THEN alarm + 1 ELSE alarm END,
    CASE WHEN NOT rests AND now >= 40 THEN now END, CASE WHEN NOT rests AND now >= 40 THEN n + 1 END
  FROM (SELECT s.mdn_5g, s.cust_id, s.i, s.cpe_date, f.total, f.n, f.until, f.alarm, greatest(0, f.total + s.d) AS now,
      coalesce(s.cpe_date <= f.until, false) AS rests
    FROM fold f JOIN steps s ON s.mdn_5g = f.mdn_5g AND s.cust_id = f.cust_id AND s.i = f.i + 1)
)
SELECT mdn_5g, cust_id, CAST(alarm AS INTEGER) AS alarm, day AS alarm_dt, peak, took AS days FROM fold WHERE peak IS NOT NULL"""

ORACLE["survival_curve"] = """
WITH lives AS (
  SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS start_dt,
    min(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS end_dt
  FROM orders GROUP BY o_custkey
),
last AS (SELECT max(greatest(start_dt, end_dt)) AS d FROM lives JOIN customer ON c_custkey = o_custkey),
days AS (
  SELECT c_mktsegment AS segment, CAST(coalesce(end_dt, (SELECT d FROM last)) - start_dt AS BIGINT) AS day,
    count(end_dt) AS n_ended, count(*) - count(end_dt) AS n_censored
  FROM lives JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
),
risk AS (
  SELECT *, CAST(sum(n_ended + n_censored) OVER (PARTITION BY segment ORDER BY day DESC) AS BIGINT) AS at_risk FROM days
)
SELECT segment, day, at_risk, n_ended, n_censored,
  round(product(CAST(at_risk - n_ended AS DOUBLE) / at_risk) OVER w, 9) AS survival,
  round(sum(CAST(n_ended AS DOUBLE) / at_risk) OVER w, 9) AS hazard_sum
FROM risk WINDOW w AS (PARTITION BY segment ORDER BY day)"""

_EDGES = ", ".join(
    f"floor(4294967296::DOUBLE * exp(-1::DOUBLE) * {sum(1 / math.factorial(i) for i in range(k + 1))!r}::DOUBLE)" for k in range(12)
)
ORACLE["lift_interval"] = _with(CUSTOMERS, ARMS) + f""",
weighed AS (
  SELECT arm, churned, b * 4 + i AS replicate,
    len(list_filter([{_EDGES}], lambda t: CAST('0x' || substr(md5('bootstrap|' || CAST(cust_id AS VARCHAR) || '|' || CAST(b AS VARCHAR)),
      CAST(i * 8 + 1 AS BIGINT), 8) AS BIGINT) >= t)) AS w
  FROM arms, (SELECT unnest(range(50)) AS b), (SELECT unnest(range(4)) AS i) WHERE arm IS NOT NULL
),
per AS (
  SELECT replicate, sum(w) FILTER (WHERE arm = 'treated') AS nt, sum(w * churned) FILTER (WHERE arm = 'treated') AS yt,
    sum(w) FILTER (WHERE arm = 'control') AS nc, sum(w * churned) FILTER (WHERE arm = 'control') AS yc
  FROM weighed GROUP BY replicate
),
x AS (
  SELECT CAST(yc AS DOUBLE) / nc - CAST(yt AS DOUBLE) / nt AS d FROM per WHERE nc > 0 AND nt > 0
),
sorted AS (SELECT list(d ORDER BY d) AS l, count(*) AS k, count(*) FILTER (WHERE d > 0) AS up FROM x)
SELECT k AS n_replicates, l[CAST(greatest(1, ceil(k * 0.025 - 1e-9)) AS BIGINT)] AS low, l[CAST(ceil(k * 0.5 - 1e-9) AS BIGINT)] AS median,
  l[CAST(ceil(k * 0.975 - 1e-9) AS BIGINT)] AS high, CAST(up AS DOUBLE) / k AS share_positive FROM sorted"""

ORACLE["input_drift"] = _with(SCORED) + """,
m AS (SELECT CAST(date_trunc('week', day) AS DATE) AS period, score FROM scored),
r AS (SELECT score FROM m WHERE period = (SELECT min(period) FROM m)),
places AS (SELECT DISTINCT score AS v FROM m),
ref AS (SELECT v, (SELECT count(*) FROM r) AS big, (SELECT count(*) FROM r WHERE score <= v) AS n FROM places),
periods AS (SELECT period, count(*) AS n_all FROM m GROUP BY period),
cells AS (SELECT period, score AS v, count(*) AS n FROM m GROUP BY ALL),
grid AS (
  SELECT p.period, n_all, v, big, ref.n AS ref_n,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY p.period ORDER BY v) AS own_n
  FROM periods p CROSS JOIN ref LEFT JOIN cells c USING (period, v)
),
ks AS (
  SELECT period, n_all AS n, max(abs(CAST(own_n * big - ref_n * n_all AS DOUBLE))) / (CAST(n_all AS DOUBLE) * CAST(max(big) AS DOUBLE)) AS distance
  FROM grid GROUP BY period, n_all
),
placed AS (
  SELECT period, score, row_number() OVER (PARTITION BY period ORDER BY score) AS i, count(*) OVER (PARTITION BY period) AS k FROM m
),
points AS (
  SELECT period, min(score) FILTER (WHERE i >= ceil(k * 0.1 - 1e-9)) AS s10, min(score) FILTER (WHERE i >= ceil(k * 0.5 - 1e-9)) AS s50,
    min(score) FILTER (WHERE i >= ceil(k * 0.9 - 1e-9)) AS s90 FROM placed GROUP BY period
)
SELECT period, n, distance, """ + ", ".join(
    f"CASE WHEN s{q} < 0 THEN -((-s{q}) >> greatest(0, length(bin(abs(s{q}))) - 7) << greatest(0, length(bin(abs(s{q}))) - 7))"
    f" ELSE (s{q} | CAST((1::BIGINT << greatest(0, length(bin(abs(s{q}))) - 7)) - 1 AS BIGINT)) END AS q{q}"
    for q in (10, 50, 90)
) + " FROM ks JOIN points USING (period)"

ORACLE["permutation_importance"] = _with(CUSTOMERS) + """,
ranked AS (
  SELECT churned, predicted, cost_cents, revenue_cents // 10000000 AS revenue,
    row_number() OVER (ORDER BY md5('permute|' || CAST(cust_id AS VARCHAR))) AS r, count(*) OVER () AS n FROM people
),
both_ AS (
  SELECT a.*, b.predicted AS p2, b.revenue AS v2 FROM ranked a JOIN ranked b ON b.r = a.r % a.n + 1
),
hits AS (
  SELECT count(*) AS n,
    CAST(count(*) FILTER (WHERE churned = CASE WHEN revenue >= 12 OR (predicted = 1 AND revenue >= 9) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS base,
    CAST(count(*) FILTER (WHERE churned = CASE WHEN v2 >= 12 OR (predicted = 1 AND v2 >= 9) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS a1,
    CAST(count(*) FILTER (WHERE churned = CASE WHEN revenue >= 12 OR (p2 = 1 AND revenue >= 9) THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS a2
  FROM both_
)
SELECT 'revenue' AS feature, n, base AS accuracy, a1 AS accuracy_shuffled, base - a1 AS importance FROM hits
UNION ALL SELECT 'predicted', n, base, a2, base - a2 FROM hits
UNION ALL SELECT 'cost_cents', n, base, base, base - base FROM hits"""
