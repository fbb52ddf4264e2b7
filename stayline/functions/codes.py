"""Code normalisation and the CASE buckets of the line tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: must equal the source system's codes for right results -------------------
DISCONNECT_CODES = ("DE", "D3")
ACTIVATION_CODES = ("AC", "RE")

FIXED_WIRELESS_SUB_TYPES = (
    "5G Business Internet mmWave",
    "5G Business Internet C-Band",
    "5G Home mmWave",
    "5G Home C-Band",
    "4G LTE Home",
)
ELIGIBLE_SUB_TYPES = ("5G Business Internet", "5G Home", "4G LTE Home")

C_BAND_PLANS = (
    "67571", "67576", "50127", "50129", "50128", "50130", "53617", "51219", "75561",
)
MMWAVE_PLANS = (
    "67567", "67568", "50044", "50116", "50055", "50117", "17542", "25878", "32525", "32523",
    "39425", "39428", "32780", "32781", "75560",
)
# The second wording of the technology bucket knows neither of these two plans.
LATE_PLANS = ("75561", "75560")
FIXED_WIRELESS_PLAN_TYPE = "Fixed Wireless Home"

DEFAULT_SEGMENT = "Wireless Consumer Revenue"
NETWORK_TYPE = "5g fixed wireless"
KEPT_DEVICES = ("ARC-XCI55AX", "WNC-CR200A", "ASK-NCQ1338FA", "FSNO21VA")
# ---- End of fixed values --------------------------------------------------------------------


def code(value: Column) -> Column:
    """A code as it is compared: no blanks around it, letter case ignored."""
    return F.upper(F.trim(value))


def code_in(value: Column, values: Sequence[str]) -> Column:
    return code(value).isin([v.strip().upper() for v in values])


def code_is(value: Column, wanted: str) -> Column:
    return code(value) == F.lit(wanted.strip().upper())


def code_is_not(value: Column, unwanted: str) -> Column:
    """NULL, and so dropped by a filter, where the value is NULL."""
    return code(value) != F.lit(unwanted.strip().upper())


def declared(value: Column, spellings: Sequence[str]) -> Column:
    """The declared spelling of a value that equals one up to blanks and letter case; others trimmed."""
    out = F.trim(value)
    for spelling in spellings:
        out = F.when(code_is(value, spelling), spelling).otherwise(out)
    return out


def channel_bucket(channel: Column) -> Column:
    """Door-to-door or not; an unknown channel stays NULL."""
    return F.when(channel.isNotNull(), F.when(code_is(channel, "D2D"), "D2D").otherwise("Non-D2D"))


def technology_bucket(
    plan_code: Column, plan_type: Column, plan_sub_type: Column, *, short_names: bool = False
) -> Column:
    """Radio technology of a price plan: by code first, then by plan type.

    ``short_names`` selects the second wording: other labels, and without the two late plans.
    """
    c_band, mmwave = C_BAND_PLANS, MMWAVE_PLANS
    names = ("5G Home C-Band", "5G Home mmWave")
    if short_names:
        c_band = tuple(p for p in c_band if p not in LATE_PLANS)
        mmwave = tuple(p for p in mmwave if p not in LATE_PLANS)
        names = ("C-Band", "MM Wave")
    return (
        F.when(code_in(plan_code, c_band), names[0])
        .when(code_in(plan_code, mmwave), names[1])
        .when(code_is(plan_type, FIXED_WIRELESS_PLAN_TYPE), plan_sub_type)
        .otherwise("Other")
    )


def disconnect_reason(category: Column, description: Column) -> Column:
    """Movers first, then the involuntary categories, then unknown, the rest voluntary."""
    return (
        F.when(description.ilike("%MOVING%"), "Movers")
        .when(code_in(category, ("I", "A")), "Involuntary")
        .when(description.isNotNull(), "Voluntary")
    )


def last_word(text: Column) -> Column:
    return F.element_at(F.split(F.trim(text), " "), -1)


def device_bucket(device: Column, keep: Sequence[str] = KEPT_DEVICES) -> Column:
    """Model (last word of the device name) if it is kept; anything else, also NULL, is others."""
    model = last_word(device)
    return F.when(model.isin(list(keep)), model).otherwise("others")


def plan_bucket(sub_type: Column) -> Column:
    """The two business radio types are one plan."""
    business = [s for s in FIXED_WIRELESS_SUB_TYPES if s.startswith("5G Business Internet")]
    return F.when(sub_type.isin(business), "5G Business Internet").otherwise(sub_type)


def known(value: Column) -> Column:
    return F.coalesce(value, F.lit("unknown"))


def phone_number(padded: Column, width: int | None = None) -> Column:
    """The line's number without padding, cut to ``width`` characters if given."""
    number = F.trim(padded)
    return number if width is None else F.left(number, F.lit(width))
