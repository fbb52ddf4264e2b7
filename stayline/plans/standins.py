"""The given tables seen as line tables: activity log, profile, telemetry, histories, lookups.

``orders`` is the activity log, ``lineitem`` the telemetry, ``customer`` with ``events`` the static
profile. Codes come out padded and in mixed case, as a warehouse delivers them, and pass through
the same contracts as real input.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.operators import panel as panels
from stayline.operators.history import validity
from stayline.sources import contracts
from stayline.sources import readers

CUTOFF = date(1996, 1, 1)
AS_OF = date(2002, 1, 1)
CHURN_AFTER = date(1996, 6, 15)


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return readers.table(spark, folder, name, SCHEMAS[name])


LINE_ID = "CAST(o_orderkey % 2 + 1 AS STRING)"
# Some numbers have moved to a new line: they go under two sequence numbers.
SEQUENCE = f"CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 2 + 3 AS STRING) ELSE {LINE_ID} END"
NUMBER = f"concat(CAST(o_custkey AS STRING), {LINE_ID})"


def raw_activity(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: who, which line, when, what."""
    orders = table(spark, folder, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return orders.selectExpr(
        "o_custkey AS cust_id",
        f"{SEQUENCE} AS cust_line_seq_id",
        f"rpad({NUMBER}, 30, ' ') AS mtn",
        """CASE WHEN o_totalprice < 60000 THEN '67571' WHEN o_totalprice < 120000 THEN '67567'
             WHEN o_totalprice < 180000 THEN '75561' WHEN o_totalprice < 240000 THEN '75560'
             WHEN o_totalprice < 300000 THEN 'fwh1 ' WHEN o_totalprice < 360000 THEN 'FWH2'
             WHEN o_totalprice < 420000 THEN 'FWH3' ELSE 'MOB1' END AS pplan_cd""",
        "day AS activity_dt",
        """CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'ac '
             WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN ' de'
             WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'd3'
             WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'Re'
             ELSE 'CH' END AS activity_cd""",
        """CASE WHEN month(day) <= 3 THEN 'Gateway ARC-XCI55AX'
             WHEN month(day) <= 6 THEN 'Router WNC-CR200A '
             WHEN month(day) <= 8 THEN 'ASK-NCQ1338FA' WHEN month(day) <= 10 THEN 'Cube FSNO21VA'
             WHEN month(day) = 11 THEN 'Legacy Modem' END AS eqp_prod_nm""",
        "concat('r', CAST(day(day) div 6 AS STRING)) AS change_reas_cd",
        "CAST(o_custkey * 100 + o_orderkey % 2 + 1 AS STRING) AS acct_num",
        # Some events are reported a month late, some a month early.
        """trunc(add_months(day, CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END), 'MM')
             AS rpt_mth""",
        "CASE WHEN day(day) = 1 THEN 'y' ELSE 'n' END AS prepaid_ind",
        "CASE WHEN day(day) = 2 THEN 'n' ELSE 'y' END AS rev_gen_ind",
        "CASE WHEN day(day) = 3 THEN 'm' ELSE 'c' END AS managed_ind",
        "CASE WHEN day(day) = 4 THEN 't' ELSE 's' END AS line_type_cd",
        """CASE WHEN o_totalprice < 80000 THEN '4G LTE Home'
             WHEN o_totalprice < 160000 THEN '5g home c-band'
             WHEN o_totalprice < 240000 THEN '5G Home mmWave '
             WHEN o_totalprice < 320000 THEN '5G Business Internet C-Band'
             WHEN o_totalprice < 400000 THEN '5G Business Internet mmWave'
             WHEN o_totalprice < 440000 THEN '5g home'
             ELSE 'Mobile Unlimited' END AS coe_pplan_sub_type_desc""",
    )


def activity(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.conform_activity(raw_activity(spark, folder))


def profile(spark: SparkSession, folder: str) -> DataFrame:
    """Two lines per customer; install data from the customer's events, NULL for those without."""
    seen = (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("c_custkey"))
        .agg(
            F.count("*").alias("n_events"),
            F.expr("count_if(event_type = 'purchase') AS n_bought"),
            F.expr("min(CAST(ts AS DATE)) AS sales_dt"),
            F.expr("max(CAST(ts AS DATE)) AS install_dt"),
        )
    )
    # ---- Fixed values: which region stands for which market ----------------------------------
    market = """CASE r_name WHEN 'AMERICA' THEN 'West' WHEN 'EUROPE' THEN 'East'
                WHEN 'ASIA' THEN 'South' WHEN 'AFRICA' THEN 'Headquarters' END AS market_type"""
    # ---- End of fixed values -----------------------------------------------------------------
    places = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr("n_nationkey AS c_nationkey", market)
    )
    return (
        table(spark, folder, "customer")
        .join(places, "c_nationkey", "left")
        .join(seen, "c_custkey", "left")
        .selectExpr("*", "explode(array('1', '2')) AS line")
        .selectExpr(
            "CAST(c_custkey AS STRING) AS cust_id",
            "concat(CAST(c_custkey AS STRING), line) AS mtn",
            "concat(CAST(c_custkey AS STRING), line) AS mdn_5g",
            """CASE WHEN n_bought * 5 >= n_events THEN 'D2D'
                 WHEN n_events IS NOT NULL THEN 'Retail' END AS chnl_nm""",
            """CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'SELF' ELSE 'PROFESSIONAL' END
                 AS install_type""",
            "sales_dt",
            "install_dt",
            "market_type",
            """CASE WHEN c_acctbal >= 5000 THEN 'LOCALLY_FULFILLED'
                 WHEN c_acctbal >= 0 THEN 'SHIPPED' END AS order_fulfilment""",
            """CASE WHEN n_events >= 60 THEN 'Y' WHEN n_events IS NOT NULL THEN 'N' END
                 AS usage_flag""",
        )
    )


def full_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile with every column of the contract; what the given tables lack is NULL."""
    rows = profile(spark, folder)
    missing = [f for f in contracts.PROFILE.fields if f.name not in rows.columns]
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


# The 18 scores as arithmetic on a line's daily sums.
SCORE_RULES = {
    "scaled_5g_uptime": "CASE WHEN returned = 0 THEN CAST(quantity AS DOUBLE) / 2 END",
    "scaled_fiveg_usage_percentage": "CAST(discount AS DOUBLE) / 100",
    "scaled_sqrt_data_usage": "CAST(price AS DOUBLE) / 100",
    "scaled_uploadresult": "CAST(quantity AS DOUBLE) / 4",
    "scaled_downloadresult": "CASE WHEN rows_of_day = 1 THEN CAST(quantity AS DOUBLE) / 8 END",
    "scaled_latency": "CAST(tax AS DOUBLE) / 100",
    "scaled_RSRP": "CAST(0 - quantity AS DOUBLE) / 8",
    "scaled_avg_CQI": "CAST(discount AS DOUBLE) / 4",
    "scaled_SNR": "CAST(quantity - 25 AS DOUBLE) / 4",
    "scaled_switch_count_sum": "CAST(rows_of_day AS DOUBLE)",
    "scaled_reset_count": "CAST(returned AS DOUBLE)",
    "scaled_avg_MemoryPercentFree": "CAST(tax AS DOUBLE) / 8",
    "scaled_percentageReceived": "CAST(still_open AS DOUBLE)",
    "dataScore": "CAST(discount AS DOUBLE) / 8",
    "networkSpeedScore": "CAST(quantity AS DOUBLE) / 16",
    "networkSignalScore": "CAST(tax AS DOUBLE) / 16",
    "networkFailureScore": "CAST(returned AS DOUBLE) / 2",
    "deviceScore": "CAST(still_open AS DOUBLE) / 2",
}


def telemetry_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-number sums per line and ship day."""
    items = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "CAST(l_shipdate AS DATE) AS cpe_date", "CAST(l_quantity AS BIGINT) AS q",
        "CAST(rint(l_extendedprice * 100) AS BIGINT) AS p",
        "CAST(rint(l_discount * 100) AS BIGINT) AS d", "CAST(rint(l_tax * 100) AS BIGINT) AS t",
        "l_returnflag = 'R' AS r", "l_linestatus = 'O' AS o",
    )
    lines = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS l_orderkey", "CAST(o_custkey AS STRING) AS cust_id", f"{NUMBER} AS mdn_5g"
    )
    return panels.daily(
        items.join(lines, "l_orderkey"),
        {
            "quantity": F.sum("q"),
            "price": F.sum("p"),
            "discount": F.sum("d"),
            "tax": F.sum("t"),
            "rows_of_day": F.count("*"),
            "returned": F.count_if("r"),
            "still_open": F.count_if("o"),
        },
    )


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    sums = telemetry_sums(spark, folder)
    scores = [f"{rule} AS {name}" for name, rule in SCORE_RULES.items()]
    return sums.selectExpr("cpe_date", *panels.KEY, *scores)


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line and day with any activity, valid until the next such day.

    ``first_cd`` is the place of the day's first code in AC, CH, D3, DE, RE.
    """
    orders = table(spark, folder, "orders")
    days = orders.groupBy(
        F.expr("CAST(o_custkey AS STRING) AS cust_id"),
        F.expr(f"{SEQUENCE} AS cust_line_seq_id"),
        F.expr("CAST(o_custkey * 100 + o_orderkey % 2 + 1 AS STRING) AS acct_num"),
        F.expr("CAST(o_orderdate AS DATE) AS day"),
    ).agg(
        F.expr(
            """min(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 1
                 WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 4
                 WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 3
                 WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN 5
                 ELSE 2 END) AS first_cd"""
        ),
        F.max("o_totalprice").alias("top"),
    )
    return validity(days, ["cust_id", "cust_line_seq_id", "acct_num"], "day")


def network_history(days: DataFrame) -> DataFrame:
    return days.selectExpr(
        "cust_id", "cust_line_seq_id", "eff_dt", "exp_dt",
        "CASE WHEN first_cd IN (3, 4) THEN 'n' ELSE 'y ' END AS active_ind",
        "CASE WHEN top < 300000 THEN '5G Fixed Wireless ' ELSE '4g mobile' END AS network_type",
    )


def line_dimensions(days: DataFrame) -> DataFrame:
    return days.selectExpr(
        "cust_id", "cust_line_seq_id", "eff_dt", "exp_dt",
        "CASE WHEN top < 450000 THEN 'Segment ' ELSE 'usage' END AS dim_name",
        "CASE WHEN top < 150000 THEN 'B' WHEN top < 300000 THEN 'C' ELSE 'X' END AS dim_value",
    )


def account_history(days: DataFrame) -> DataFrame:
    return days.where("top < 450000").select("cust_id", "acct_num", "eff_dt", "exp_dt")


def price_plans(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """
        SELECT * FROM VALUES
          ('67571', 'Fixed Wireless Home', '4G LTE Home'),
          ('FWH1', 'Fixed Wireless Home', '5G Home C-Band'),
          ('FWH2', 'fixed wireless home', '4G LTE Home'),
          ('FWH3', 'Fixed Wireless Home', CAST(NULL AS STRING))
        AS t(pplan_cd, coe_pplan_type_desc, coe_pplan_sub_type_desc)
        """
    )


def change_reasons(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """
        SELECT * FROM VALUES
          ('R0', 'V', 'COMPETITOR OFFER'),
          ('R1', 'I', 'Moving out of area'),
          ('R2', 'I', 'NON PAYMENT'),
          ('R3', 'a', CAST(NULL AS STRING)),
          ('R4', 'V', CAST(NULL AS STRING))
        AS t(change_reas_cd, change_reas_ctgry_cd, change_reas_desc)
        """
    )


def activity_names(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES ('AC', 'Activation'), ('DE', 'Disconnect'), ('RE', 'Reactivation')"
        " AS t(activity_cd, activity_desc)"
    )


def segments(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """
        SELECT * FROM VALUES
          ('B', 'c', 'Wireless Business Revenue'),
          ('B', 'p', 'Business'),
          ('C', 'C', 'Wireless Consumer Revenue')
        AS t(segmt_cd, curr_prev_ind, segmt_ctgry_desc)
        """
    )


def records(spark: SparkSession, folder: str, longest: tuple[int, int, int, int]) -> DataFrame:
    """One record per order with a validity of 1 day up to one of four lengths: they overlap and contradict one another.

    ``recorded`` is the order in which they came in, late ones after others that begin later.
    """
    days = F.array(*[F.lit(n) for n in longest])
    orders = table(spark, folder, "orders").withColumns(
        {
            "length": F.expr("(o_orderkey * 7919) % 1000003") % days[(F.col("o_orderkey") % 4).cast("int")],
            "eff_dt": F.expr("date_sub(CAST(o_orderdate AS DATE), CAST(o_orderkey % 30 AS INT))"),
        }
    )
    return orders.selectExpr(
        "CAST(o_custkey AS STRING) AS cust_id", "eff_dt", "date_add(eff_dt, CAST(length AS INT)) AS exp_dt",
        "o_orderkey AS recorded", "concat('P', CAST(o_orderkey % 3 AS STRING)) AS plan",
        "o_orderkey % 5 = 0 AS is_late",
    )


def lifetimes(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer: segment, first order day, and the day of the first urgent or high order that is done, if any."""
    orders = table(spark, folder, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    ended = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("day").alias("start_dt"), F.min(F.when(ended, F.col("day"))).alias("end_dt")
    )
    return table(spark, folder, "customer").join(per, "c_custkey").selectExpr(
        "c_custkey AS cust_id", "c_mktsegment AS segment", "start_dt", "end_dt"
    )


def descriptors(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with orders: what is known of its first line, as categories, and whether it churned."""
    lines = profile(spark, folder).where("mtn = concat(cust_id, '1')").select(
        F.col("cust_id").cast("bigint").alias("cust_id"), "chnl_nm", "install_type", "market_type", "order_fulfilment", "usage_flag"
    )
    people = customers(spark, folder).select(
        "cust_id", "segment", "churned", F.concat(F.lit("M"), F.month("cycle").cast("string")).alias("month")
    )
    return people.join(lines, "cust_id")


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scored examples: an error is the positive class, the value is the score."""
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "CAST(ts AS DATE) AS day",
        "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label",
        "CASE WHEN rint(value * 100) >= 1000 THEN 1 ELSE 0 END AS prediction",
        "CAST(rint(value * 100) AS BIGINT) AS score",
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer: churned or not, revenue, cost of an offer, prediction, cycle."""
    orders = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.expr(
                """max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
                     THEN 1 ELSE 0 END) AS churned"""
            ),
            F.expr("sum(CAST(rint(o_totalprice * 100) AS BIGINT)) AS revenue_cents"),
            F.expr("trunc(max(CAST(o_orderdate AS DATE)), 'MM') AS cycle"),
        )
    )
    return (
        table(spark, folder, "customer")
        .join(orders, "c_custkey")
        .selectExpr(
            "c_custkey AS cust_id",
            "c_mktsegment AS segment",
            "churned",
            "revenue_cents",
            "cycle",
            "CASE WHEN c_acctbal < 5000 THEN 1 ELSE 0 END AS predicted",
            "CAST(CASE WHEN c_acctbal < 0 THEN 5000 ELSE 2500 END AS BIGINT) AS cost_cents",
        )
    )
