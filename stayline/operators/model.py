"""Random forest on the design matrix, with Spark ML: training and scoring stay on the executors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.numbers import fixed_point
from stayline.operators.features import LABEL

MAX_BINS = 256
MIN_LEAF = 5


def assemble(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df)


def train_forest(
    train: DataFrame,
    inputs: Sequence[str],
    *,
    label: str = LABEL,
    trees: int = 100,
    max_depth: int = 30,
    max_bins: int = MAX_BINS,
    min_leaf: int = MIN_LEAF,
    seed: int = 42,
    weight: str | None = None,
) -> RandomForestClassificationModel:
    """100 gini trees on a square root of the features each, as deep as Spark allows (30).

    A score is cut into ``max_bins`` bins at most before the trees see it, at quantiles; with as many bins as a score
    has values, trees split on exact values. Of more than ``max_bins`` squared rows Spark would seek the quantiles in a
    sample of that many, so there are at least as many bins as the root of the rows, and all are read. A leaf has ``min_leaf``
    rows at least. The trees lie in the driver's memory: each has fewer than 2 * rows / min_leaf nodes.

    ``train`` is read several times; pass a table that is stored (``session.durable``). Where checkpoints have a folder
    (``spark.checkpoint.dir``) a row's node in each tree is kept from pass to pass, not found from the root again; the trees are the same.
    """
    context = train.sparkSession.sparkContext
    forest = RandomForestClassifier(
        labelCol=label,
        featuresCol="features",
        numTrees=trees,
        maxDepth=max_depth,
        featureSubsetStrategy="sqrt",
        impurity="gini",
        seed=seed,
        maxMemoryInMB=256,
        maxBins=max(max_bins, math.ceil(math.sqrt(train.count()))),
        minInstancesPerNode=min_leaf,
        cacheNodeIds=context.getCheckpointDir() is not None,
    )
    if weight is not None:
        forest = forest.setWeightCol(weight)
    return forest.fit(assemble(train, inputs))


def score(
    model: RandomForestClassificationModel, df: DataFrame, inputs: Sequence[str], label: str = LABEL
) -> DataFrame:
    """``df`` with ``label``, ``prediction`` (0/1), ``probability`` and whole-number ``score``."""
    scored = model.transform(assemble(df, inputs))
    chance = vector_to_array(F.col("probability"))[1]
    return scored.select(
        *[c for c in df.columns if c not in inputs],
        F.col(label).cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
        chance.alias("probability"),
        fixed_point(chance).alias("score"),
    )


def importances(
    model: RandomForestClassificationModel, like: DataFrame, inputs: Sequence[str]
) -> DataFrame:
    """Feature importances, largest first: one row per input column of the model."""
    values = [(name, float(v)) for name, v in zip(inputs, model.featureImportances.toArray())]
    table = like.sparkSession.createDataFrame(values, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")
