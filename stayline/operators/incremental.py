"""Features kept up to date day by day: a table of mergeable state per line, advanced by one day's folder at a time.

A line's state is what can be added up and still gives its features: exact sums, counts of values, and its first and last day. A
day's telemetry is summed up to the same form and merged into it, so the work of a day is that day's rows and one row per line; no earlier
telemetry is read again.

A store is a folder with one sub-folder per state and a log, a small table with a row per day that counts. A state is written whole
under a name of its own, then its day is added to the log; that is the only moment at which it starts to count. A job that dies before is
simply run again, and a day already in the log changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions import numbers
from stayline.operators.panel import KEY

LOG = "day string, version bigint, folder string"


def empty_sum() -> Column:
    return F.lit(0).cast(numbers.WIDE)


def partial_state(rows: DataFrame, scores: Sequence[str], keys: Sequence[str] = KEY, day: str = "cpe_date") -> DataFrame:
    """(keys, n_rows, first_day, last_day, sum_<score>, n_<score>) of telemetry; sums in whole units of 1e-12."""
    parts = {s: numbers.units(F.col(s)) for s in scores}
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        *[F.coalesce(F.sum(p), empty_sum()).cast(numbers.WIDE).alias(f"sum_{s}") for s, p in parts.items()],
        *[F.count(p).alias(f"n_{s}") for s, p in parts.items()],
    )


def merged(states: DataFrame, scores: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """One state per key of several; the order of merging makes no difference."""
    return states.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
        *[F.sum(f"sum_{s}").cast(numbers.WIDE).alias(f"sum_{s}") for s in scores],
        *[F.sum(f"n_{s}").alias(f"n_{s}") for s in scores],
    )


def features(state: DataFrame, scores: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, n_rows, first_day, last_day, scores): the mean of each score to two decimals, as ``numbers.mean_2dp`` gives it."""

    def mean(score: str) -> Column:
        total, n = F.col(f"sum_{score}"), F.col(f"n_{score}")
        step = F.lit(numbers.UNITS // 100).cast(numbers.WIDE)
        hundredths = F.call_function("div", F.abs(total) * 2 + n * step, n * step * 2)
        return F.when(n > 0, F.signum(total) * hundredths.cast("double") / F.lit(100.0))

    return state.select(*keys, "n_rows", "first_day", "last_day", *[mean(s).alias(s) for s in scores])


@dataclass(frozen=True)
class StateStore:
    """The state of all lines in ``folder``, for ``scores`` of telemetry rows with ``keys`` and ``cpe_date``. One job at a time may
    advance a store."""

    spark: SparkSession
    folder: str
    scores: tuple[str, ...]
    keys: tuple[str, ...] = KEY

    def log(self) -> DataFrame:
        """(day, version, folder) of the days that count."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def current(self) -> tuple[int, str | None]:
        """Version and folder of the newest state; 0 and none at first."""
        last = self.log().agg(F.max(F.struct("version", "folder")).alias("l")).first().l
        return (last.version, last.folder) if last else (0, None)

    def state(self) -> DataFrame:
        _, folder = self.current()
        if folder is not None:
            return self.spark.read.parquet(f"{self.folder}/{folder}")
        some = self.spark.createDataFrame([], ", ".join([*(f"{k} string" for k in self.keys), "cpe_date date", *(f"{s} double" for s in self.scores)]))
        return partial_state(some, self.scores, self.keys)

    def advance(self, day: str, rows: DataFrame) -> bool:
        """Adds the rows of ``day``, a name such as that of its folder; false if they are in already. A day without rows counts, too."""
        if not self.log().where(F.col("day") == day).isEmpty():
            return False
        version, folder = self.current()
        new = partial_state(rows, self.scores, self.keys)
        both = new if folder is None else merged(self.state().unionByName(new), self.scores, self.keys)
        name = f"state-{version + 1:08d}-{uuid.uuid4().hex}"
        both.write.parquet(f"{self.folder}/{name}")
        # From here on it counts.
        self.spark.createDataFrame([(day, version + 1, name)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return True

    def features(self) -> DataFrame:
        return features(self.state(), self.scores, self.keys)
