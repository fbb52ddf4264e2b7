"""One model per segment, all segments at once: least squares, and logistic regression by iterated least squares.

What a segment's model needs of its rows are sums of products, the Gram matrix. Sums merge, so a segment of any size is added up
where its rows are and never meets in one task; they are exact (whole units), so a model does not depend on the order of rows. The
equations of all segments are solved side by side, by elimination in column expressions: one row per segment, no job
of its own. The logistic model repeats that a fixed number of times over rows that were summed up once by equal values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions import numbers
from stayline.session import durable

LEAST_PIVOT = 1e-9  # of a diagonal element that must be left of it, else the inputs do not determine the model
ROUNDS = 8


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of a double from whole units; 0 for none."""
    return F.coalesce(F.sum(numbers.units(value)), F.lit(0).cast(numbers.WIDE)).cast("double") / F.lit(float(numbers.UNITS))


def gram(inputs: Sequence[Column], target: Column, weight: Column) -> dict[str, Column]:
    """Aggregates: ``g_i_j`` (i <= j) and ``h_i`` of the weighted products, input 0 being the constant."""
    full = [F.lit(1.0), *inputs]
    out = {f"g_{i}_{j}": exact_sum(weight * a * b) for i, a in enumerate(full) for j, b in enumerate(full) if i <= j}
    return out | {f"h_{i}": exact_sum(weight * a * target) for i, a in enumerate(full)}


def solved(sums: DataFrame, size: int) -> DataFrame:
    """``sums`` with ``b_0`` to ``b_{size - 1}`` for its columns ``g_i_j``, ``h_i``; all null where the matrix is singular.

    Elimination without exchange of rows, which a matrix of products does not need. One projection per
    step, so expressions stay short.
    """
    own = [c for c in sums.columns if not c.startswith(("g_", "h_"))]
    rows = sums.select(
        *own,
        *[F.col(f"g_{min(i, j)}_{max(i, j)}").alias(f"a_{i}_{j}") for i in range(size) for j in range(size)],
        *[F.col(f"h_{i}").alias(f"a_{i}_{size}") for i in range(size)],
        *[F.col(f"g_{i}_{i}").alias(f"d_{i}") for i in range(size)],
        F.lit(True).alias("ok"),
    )
    for k in range(size):
        left = range(k + 1, size + 1)
        rows = rows.withColumn("ok", F.col("ok") & (F.col(f"a_{k}_{k}") > F.col(f"d_{k}") * LEAST_PIVOT))
        factor = [F.try_divide(F.col(f"a_{i}_{k}"), F.col(f"a_{k}_{k}")) for i in range(k + 1, size)]
        changed = {
            f"a_{i}_{j}": F.col(f"a_{i}_{j}") - factor[i - k - 1] * F.col(f"a_{k}_{j}") for i in range(k + 1, size) for j in left
        }
        rows = rows.withColumns(changed) if changed else rows
    for k in reversed(range(size)):
        rest = F.col(f"a_{k}_{size}")
        for j in range(k + 1, size):
            rest = rest - F.col(f"a_{k}_{j}") * F.col(f"b_{j}")
        rows = rows.withColumn(f"b_{k}", F.try_divide(rest, F.col(f"a_{k}_{k}")))
    return rows.select(*own, *[F.when(F.col("ok"), F.col(f"b_{i}")).alias(f"b_{i}") for i in range(size)])


def least_squares(
    rows: DataFrame, segment: str, inputs: Sequence[str], target: str, weight: str | None = None
) -> DataFrame:
    """(segment, n, b_0, b_1, ...) per segment: the constant and one coefficient per input.

    Rows with a null, NaN or infinity in target, weight or any input are left out. Null is a segment like any other. A segment whose
    rows do not determine all coefficients (too few, or inputs that depend on one another) has none. Without rows there are no segments.
    """
    named = {c: numbers.finite(F.col(c).cast("double")) for c in [*inputs, target, *([weight] if weight else [])]}
    known = rows.select(segment, *[v.alias(c) for c, v in named.items()]).dropna(subset=list(named))
    one = F.col(weight) if weight else F.lit(1.0)
    sums = gram([F.col(c) for c in inputs], F.col(target), one)
    per = known.groupBy(segment).agg(F.count("*").alias("n"), *[v.alias(c) for c, v in sums.items()])
    return solved(per, len(inputs) + 1)


def logistic(
    rows: DataFrame, segment: str, inputs: Sequence[str], label: str, rounds: int = ROUNDS
) -> DataFrame:
    """(segment, n, n_labelled, b_0, b_1, ...) per segment: the log odds of a 0/1 ``label``, after ``rounds`` of Newton's method
    from zero.

    Rows are summed up by equal segment and inputs first, so a round reads one row per combination, and each round is
    one pass for all segments together. Rows with a null, NaN or infinity in label or any input are left out. A segment that does not
    determine all coefficients, now or in a later round (also where inputs part the labels without error and the odds grow
    beyond bounds), has none.
    """
    size = len(inputs) + 1
    named = {c: numbers.finite(F.col(c).cast("double")) for c in inputs}
    y = F.col(label).cast("bigint")
    known = rows.select(segment, *[v.alias(c) for c, v in named.items()], y.alias("_y")).dropna(subset=[*inputs, "_y"])
    groups = durable(known.groupBy(segment, *inputs).agg(F.count("*").alias("_n"), F.sum("_y").alias("_p")))
    whole = groups.groupBy(segment).agg(F.sum("_n").alias("n"), F.sum("_p").alias("n_labelled"))
    models = durable(whole.select("*", *[F.lit(0.0).alias(f"b_{i}") for i in range(size)]))
    for _ in range(rounds):
        named_models = models.select(F.col(segment).alias("_of"), *[f"b_{i}" for i in range(size)])
        both = groups.join(named_models, groups[segment].eqNullSafe(named_models["_of"])).drop("_of")
        odds = F.col("b_0")
        for i, c in enumerate(inputs):
            odds = odds + F.col(f"b_{i + 1}") * F.col(c)
        rated = both.withColumn("_q", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
        # A Newton step: the Gram matrix weighted by the variance, against what the rates miss.
        weight = F.col("_n") * F.col("_q") * (F.lit(1.0) - F.col("_q"))
        full = [F.lit(1.0), *[F.col(c) for c in inputs]]
        sums = {f"g_{i}_{j}": exact_sum(weight * a * b) for i, a in enumerate(full) for j, b in enumerate(full) if i <= j}
        sums |= {f"h_{i}": exact_sum((F.col("_p") - F.col("_n") * F.col("_q")) * a) for i, a in enumerate(full)}
        step = solved(rated.groupBy(segment).agg(*[v.alias(c) for c, v in sums.items()]), size)
        step = step.select(F.col(segment).alias("_of"), *[F.col(f"b_{i}").alias(f"s_{i}") for i in range(size)])
        models = durable(
            models.join(step, models[segment].eqNullSafe(step["_of"]), "left").select(
                segment, "n", "n_labelled", *[(F.col(f"b_{i}") + F.col(f"s_{i}")).alias(f"b_{i}") for i in range(size)]
            )
        )
    return models


def local_rates(rows: DataFrame, models: DataFrame, segment: str, inputs: Sequence[str]) -> DataFrame:
    """``rows`` with ``rate``, what its segment's logistic model says; null without a model or with a gap in the inputs."""
    named = models.select(F.col(segment).alias("_of"), *[f"b_{i}" for i in range(len(inputs) + 1)])
    odds = F.col("b_0")
    for i, c in enumerate(inputs):
        odds = odds + F.col(f"b_{i + 1}") * numbers.finite(F.col(c).cast("double"))
    both = rows.join(named, rows[segment].eqNullSafe(named["_of"]), "left")
    return both.withColumn("rate", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).select(*rows.columns, "rate")
