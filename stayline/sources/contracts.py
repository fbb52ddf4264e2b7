"""Table contracts: declared schemas, a required-column check and load-time normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.functions import codes

STR, DAY, DBL = T.StringType(), T.DateType(), T.DoubleType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# ---- Fixed values: the columns of the tables that are delivered, by their names -----------------
ACTIVITY = _schema(
    cust_id=STR, cust_line_seq_id=STR, mtn=STR, pplan_cd=STR, activity_dt=DAY, activity_cd=STR,
    eqp_prod_nm=STR, change_reas_cd=STR, acct_num=STR, rpt_mth=DAY, prepaid_ind=STR,
    rev_gen_ind=STR, managed_ind=STR, line_type_cd=STR, coe_pplan_sub_type_desc=STR,
)
# The e-mail address of the source profile is personal data no job needs; it is not read.
PROFILE = _schema(
    cust_id=STR, mtn=STR, chnl_nm=STR, install_type=STR, sales_dt=DAY, install_dt=DAY,
    dwelling_type=STR, cust_type_cd=STR, market_type=STR, cma_nm=STR, svc_state_cd=STR,
    cust_type_desc=STR, vertical=STR, status=STR, order_fulfilment=STR, sku_id=STR,
    device_type_desc=STR, pplan_ctgry_desc=STR, usage_flag=STR, pre_check_status=STR,
    discount_svc_prod_desc=STR,
)
PRICE_PLAN = _schema(pplan_cd=STR, coe_pplan_type_desc=STR, coe_pplan_sub_type_desc=STR)
CHANGE_REASON = _schema(change_reas_cd=STR, change_reas_ctgry_cd=STR, change_reas_desc=STR)
ACTIVITY_LOOKUP = _schema(activity_cd=STR, activity_desc=STR)
NETWORK_HISTORY = _schema(
    cust_id=STR, cust_line_seq_id=STR, eff_dt=DAY, exp_dt=DAY, active_ind=STR, network_type=STR
)
LINE_DIMENSION_HISTORY = _schema(
    cust_id=STR, cust_line_seq_id=STR, eff_dt=DAY, exp_dt=DAY, dim_name=STR, dim_value=STR
)
ACCOUNT_HISTORY = _schema(cust_id=STR, acct_num=STR, eff_dt=DAY, exp_dt=DAY)
SEGMENT_LOOKUP = _schema(segmt_cd=STR, curr_prev_ind=STR, segmt_ctgry_desc=STR)
# ---- End of fixed values --------------------------------------------------------------------

# ---- Fixed values: the score columns of the daily telemetry, in their order ------------------
SCORES = (
    "scaled_5g_uptime",
    "scaled_fiveg_usage_percentage",
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
    "dataScore",
    "networkSpeedScore",
    "networkSignalScore",
    "networkFailureScore",
    "deviceScore",
)
# ---- End of fixed values --------------------------------------------------------------------
PANEL_KEY = ("mdn_5g", "cust_id")
PANEL = _schema(cpe_date=DAY, mdn_5g=STR, cust_id=STR, **{name: DBL for name in SCORES})


def require(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail early, naming every column the table lacks (letter case ignored)."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def conform(df: DataFrame, schema: T.StructType, codes_of: Sequence[str] = ()) -> DataFrame:
    """``df`` with exactly the contract's columns and types; ``codes_of`` are normalised. A score that is not finite is
    missing and becomes NULL.

    Texts lose their padding and codes their letter case once, here: the conformed table can then
    be joined on its keys and filtered with plain equalities, which reach the Parquet scan.
    """
    require(df, schema.fieldNames())
    out = []
    for field in schema.fields:
        # A date or number that cannot be read ends the job. Only texts keep odd values; the account
        # number is one and is read leniently where a number is wanted.
        value = f"CAST({field.name} AS {field.dataType.simpleString()})"
        if field.name in codes_of:
            value = f"upper(trim({value}))"
        elif field.dataType == STR:
            value = f"trim({value})"
        elif field.dataType == DBL:
            value = f"CASE WHEN abs({value}) < double('infinity') THEN {value} END"
        out.append(f"{value} AS {field.name}")
    return df.selectExpr(*out)


def conform_activity(df: DataFrame) -> DataFrame:
    """The activity fact, codes normalised, with the line number also named as in telemetry."""
    coded = (
        "activity_cd", "pplan_cd", "change_reas_cd", "prepaid_ind", "rev_gen_ind", "managed_ind",
        "line_type_cd",
    )
    out = conform(df, ACTIVITY, coded)
    sub_type = codes.declared(
        F.col("coe_pplan_sub_type_desc"), (*codes.FIXED_WIRELESS_SUB_TYPES, *codes.ELIGIBLE_SUB_TYPES[:2])
    )
    return out.withColumns(
        {"mdn_5g": codes.phone_number(F.col("mtn")), "coe_pplan_sub_type_desc": sub_type}
    )
