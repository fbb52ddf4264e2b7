"""Importance of a model's inputs by permutation: how much worse it judges rows in which one input is another row's.

Rows are numbered in the order of a hash of their keys, and each takes its values from the next one (the last from the first), so no
row keeps its own, and every value is used once. A row is then copied once per input, with that input alone replaced,
and all copies are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.numbers import ratio
from stayline.operators.ranking import hash_rank
from stayline.session import durable


def permuted(rows: DataFrame, keys: Sequence[str], inputs: Sequence[str], salt: str = "permute") -> DataFrame:
    """``rows`` once as they are, with a null ``shuffled``, and once per input, with its name there and another row's value in it.

    ``keys`` identify a row and are never null. A single row has no other and keeps its values. A column of the table called
    ``shuffled`` is replaced.
    """
    named = [f"key_{i}" for i in range(len(keys))]
    plain = rows.select(F.struct(*rows.columns).alias("row"), *[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)])
    ranked = durable(hash_rank(plain, named, salt, name="place"))
    n = ranked.agg(F.count("*").alias("n")).scalar()
    others = ranked.select(
        F.when(F.col("place") == 1, n).otherwise(F.col("place") - 1).alias("place"),
        F.struct(*[F.col("row")[c].alias(c) for c in inputs]).alias("other"),
    )
    copies = F.explode(F.array(F.lit(None).cast("string"), *[F.lit(c) for c in inputs]))
    many = ranked.select("place", "row").join(others, "place").withColumn("shuffled", copies)
    own = [F.col("row")[c].alias(c) for c in rows.columns if c not in (*inputs, "shuffled")]
    taken = [F.when(F.col("shuffled") == c, F.col("other")[c]).otherwise(F.col("row")[c]).alias(c) for c in inputs]
    return many.select(*own, *taken, "shuffled")


def importances(
    rows: DataFrame,
    keys: Sequence[str],
    inputs: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    label: str,
    salt: str = "permute",
) -> DataFrame:
    """(feature, n, accuracy, accuracy_shuffled, importance) per input: how much of the accuracy goes when it is shuffled.

    ``predict`` adds a 0/1 ``prediction`` to rows with ``inputs`` and keeps ``shuffled`` and the label. Rows without a label
    are left out. Without rows there are no features.
    """
    scored = predict(permuted(rows.where(F.col(label).isNotNull()), keys, inputs, salt))
    hits = scored.groupBy("shuffled").agg(
        F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col(label)).alias("hits")
    )
    hits = durable(hits)  # one row per input
    base = hits.where("shuffled is null").agg(ratio(F.sum("hits"), F.sum("n")).alias("a")).scalar()
    each = hits.where("shuffled is not null").select(
        F.col("shuffled").alias("feature"), "n", base.alias("accuracy"), ratio(F.col("hits"), F.col("n")).alias("accuracy_shuffled")
    )
    return each.withColumn("importance", F.col("accuracy") - F.col("accuracy_shuffled"))
