"""Fitted preparation of feature rows: levels, donors and means learned once, stored, and applied to other rows.

An estimator and its model in the sense of Spark ML, so they stand in a pipeline before the assembler and the forest, and
are written and read with it. What is learned: the levels of each category (sorted, each a 0/1 column), a table of donors
that fill gaps of one score at random, and the mean of each score. Levels and means are few and lie in the
model's metadata; donors are a table beside it, never in the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions import hashing, numbers
from stayline.operators.features import LEVELS, MODEL_SCORES, level_column
from stayline.operators.ranking import hash_rank
from stayline.session import durable

MAX_LEVELS = 1000  # of all categories; each becomes a column


class _Settings(Params):
    categories = Param(Params._dummy(), "categories", "columns made into 0/1 columns", TypeConverters.toListString)
    scores = Param(Params._dummy(), "scores", "columns whose gaps the mean fills", TypeConverters.toListString)
    drawn = Param(Params._dummy(), "drawn", "the score whose gaps random donors fill first; none if empty", TypeConverters.toString)
    keys = Param(Params._dummy(), "keys", "columns that identify a row, never null", TypeConverters.toListString)
    salt = Param(Params._dummy(), "salt", "of the random draw", TypeConverters.toString)
    maxLevels = Param(Params._dummy(), "maxLevels", "most levels of all categories", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            categories=list(LEVELS), scores=list(MODEL_SCORES), drawn="scaled_5g_uptime", keys=["row_key"], salt="donor", maxLevels=MAX_LEVELS
        )

    def of(self, name: str):
        return self.getOrDefault(getattr(self, name))


class Preparation(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Learns from the training rows. They are read several times; pass a stored table."""

    @keyword_only
    def __init__(
        self,
        *,
        categories: Sequence[str] | None = None,
        scores: Sequence[str] | None = None,
        drawn: str | None = None,
        keys: Sequence[str] | None = None,
        salt: str | None = None,
        maxLevels: int | None = None,
    ) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, rows: DataFrame) -> PreparationModel:
        levels: dict[str, list[str]] = {c: [] for c in self.of("categories")}
        for column, level in self._levels(rows):
            levels[column].append(level)
        donors, n_donors = None, 0
        if self.of("drawn"):
            score = numbers.finite(F.col(self.of("drawn")))
            given = rows.select(*self.of("keys"), score.cast("double").alias("value")).where("value is not null")
            donors = durable(hash_rank(given, self.of("keys"), self.of("salt"), name="donor").select("donor", "value"))
            n_donors = donors.count()
        model = self._copyValues(PreparationModel(levels, {}, donors, n_donors))
        filled = model.with_donors(rows)
        means = filled.agg(*[numbers.mean(F.col(c)).alias(c) for c in self.of("scores")]).first()
        model.means = means.asDict() if means else {}
        return model

    def _levels(self, rows: DataFrame) -> list[tuple[str, str]]:
        """Column and level of all levels in the rows, sorted; an error if they are too many for columns."""
        most = self.of("maxLevels")
        if not self.of("categories"):
            return []
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in self.of("categories")])
        found = rows.select(F.inline(pairs)).where("v is not null").distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} levels in {', '.join(self.of('categories'))}: not categories")
        return sorted((r.c, r.v) for r in found)


class PreparationModel(Model, _Settings, MLReadable, MLWritable):
    """Rows with a 0/1 column per learned level, and without gaps in the scores.

    A level that the training rows did not have, or none, is zero in all of its category's columns. A gap is filled with the value
    of the donor that a hash of the row's key draws, or, without donors and in the other scores, with the mean; if the training rows had no
    value at all it stays. NaN and infinity are gaps. Other columns are kept.
    """

    def __init__(
        self,
        levels: dict[str, list[str]] | None = None,
        means: dict[str, float | None] | None = None,
        donors: DataFrame | None = None,
        n_donors: int = 0,
    ) -> None:
        super().__init__()
        self.levels, self.means, self.donors, self.n_donors = levels or {}, means or {}, donors, n_donors

    def flags(self) -> list[str]:
        return [level_column(c, v) for c, values in self.levels.items() for v in values]

    def inputs(self) -> list[str]:
        return [*self.of("scores"), *self.flags()]

    def with_donors(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the gaps of the drawn score filled as far as there are donors."""
        score = self.of("drawn")
        if not score:
            return rows
        rows = rows.withColumn(score, numbers.finite(F.col(score)))
        if not self.n_donors:
            return rows
        draw = F.pmod(hashing.hash_int(self.of("salt"), self.of("keys")), F.lit(self.n_donors)) + 1
        # Only rows with a gap meet the donors.
        needy = rows.where(F.col(score).isNull()).select(F.struct(*rows.columns).alias("row"), draw.alias("drawn"))
        filled = needy.join(self.donors, F.col("drawn") == F.col("donor"), "left")
        filled = filled.select(*[F.col("value").alias(c) if c == score else F.col("row")[c].alias(c) for c in rows.columns])
        return rows.where(F.col(score).isNotNull()).unionByName(filled)

    def _transform(self, rows: DataFrame) -> DataFrame:
        filled = self.with_donors(rows)
        scores = {c: F.coalesce(numbers.finite(F.col(c)), F.lit(self.means.get(c)).cast("double")) for c in self.of("scores")}
        flags = {
            level_column(c, v): F.when(F.col(c).cast("string") == v, 1).otherwise(0) for c, values in self.levels.items() for v in values
        }
        return filled.withColumns({**scores, **flags})

    def copy(self, extra=None) -> PreparationModel:
        out = super().copy(extra)
        out.levels, out.means, out.donors, out.n_donors = self.levels, self.means, self.donors, self.n_donors
        return out

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: PreparationModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model = self.model
        if model.donors is not None:
            model.donors.write.parquet(f"{path}/donors")
        learned = {"levels": model.levels, "means": model.means, "n_donors": model.n_donors, "has_donors": model.donors is not None}
        # The metadata comes last: a folder without it is not a model.
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, extraMetadata={"learned": learned})


class _Reader(MLReader):
    def load(self, path: str) -> PreparationModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        learned = metadata["learned"]
        donors = spark.read.schema("donor bigint, value double").parquet(f"{path}/donors") if learned["has_donors"] else None
        model = PreparationModel(learned["levels"], learned["means"], donors, learned["n_donors"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
