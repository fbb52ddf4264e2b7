"""Reproducible randomness: md5 of a salt and the row's key, the same under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 15  # the most that fit a bigint
SCALE = 16**HEX_DIGITS


def digest(salt: str, keys: Sequence[str | Column]) -> Column:
    """Hex digest to order rows by at random. Keys must not be NULL."""
    parts = [k if isinstance(k, Column) else F.col(k) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts]))


def hash_int(salt: str, keys: Sequence[str | Column]) -> Column:
    """Uniform whole number in [0, 2^60), enough to draw among any number of rows."""
    return F.conv(F.substring(digest(salt, keys), 1, HEX_DIGITS), 16, 10).cast("bigint")


def below_share(salt: str, keys: Sequence[str | Column], share: float) -> Column:
    """True for a random ``share`` of the keys."""
    return hash_int(salt, keys) < F.lit(int(round(share * SCALE)))
