"""Classification metrics from 0/1 labels, 0/1 predictions and whole-number scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.numbers import ratio
from stayline.operators.ranking import running_totals


def confusion_matrix(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def _cells(df: DataFrame) -> DataFrame:
    """The four cells as one row."""
    hit = {
        "tn": (0, 0),
        "fp": (0, 1),
        "fn": (1, 0),
        "tp": (1, 1),
    }
    return df.agg(
        *[
            F.count_if((F.col("label") == y) & (F.col("prediction") == p)).alias(name)
            for name, (y, p) in hit.items()
        ]
    )


def classification_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages.

    A ratio with nothing below the line is 0. Accuracy stands in the row of its name, in every
    ratio column.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, fn + tp
    per_class = {
        "precision": (ratio(tn, tn + fn), ratio(tp, tp + fp)),
        "recall": (ratio(tn, n0), ratio(tp, n1)),
        "f1": (ratio(tn * 2, tn * 2 + fn + fp), ratio(tp * 2, tp * 2 + fp + fn)),
    }
    accuracy = ratio(tn + tp, n0 + n1)

    def row(name: str, of, support: Column) -> Column:
        cells = [of(*per_class[m]).alias(m) for m in ("precision", "recall", "f1")]
        return F.struct(F.lit(name).alias("class"), *cells, support.alias("support"))

    total = n0 + n1
    rows = F.array(
        row("0", lambda a, b: a, n0),
        row("1", lambda a, b: b, n1),
        row("accuracy", lambda a, b: accuracy, total),
        row("macro avg", lambda a, b: (a + b) / F.lit(2.0), total),
        row(
            "weighted avg",
            lambda a, b: ratio_of_doubles(a * n0 + b * n1, total),
            total,
        ),
    )
    return _cells(df).select(F.inline(rows))


def ratio_of_doubles(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def by_score(df: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score: ties collapse before any ordering.

    Rows without a score are below every threshold, here and in all that follows.
    """
    return df.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def roc_auc(df: DataFrame) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs ordered right,
    ties counting half. NULL if a class is missing."""
    least = df.agg(F.coalesce(F.min("score"), F.lit(0)).alias("least")).scalar()
    below = F.coalesce(F.col("score").cast("decimal(38,0)"), least.cast("decimal(38,0)") - 1)
    ranked = running_totals(by_score(df.withColumn("score", below)), "score", {"neg_upto": "neg"})
    wide = "decimal(38,0)"
    # Twice the pairs won: two for each lower negative, one for each equal.
    won = F.col("pos").cast(wide) * (F.col("neg_upto") * 2 - F.col("neg"))
    return ranked.agg(
        F.sum(won).cast("double").alias("won2"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    ).select(
        "n_pos",
        "n_neg",
        F.try_divide(
            F.col("won2"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double") * 2
        ).alias("roc_auc"),
    )


def threshold_sweep(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of "score at least the threshold", for every distinct score."""
    swept = running_totals(by_score(df), "score", {"tp": "pos", "fp": "neg"}, descending=True)
    positives = df.agg(F.count_if(F.col("label") == 1)).scalar()
    fn = positives - F.col("tp")
    return swept.select(
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        fn.alias("fn"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + fn).alias("recall"),
        ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + fn).alias("f1"),
    )


def best_threshold(df: DataFrame) -> DataFrame:
    """The threshold with the highest F1; of equal ones the highest threshold."""
    columns = ["f1", "threshold", "tp", "fp", "fn", "precision", "recall"]
    best = threshold_sweep(df).agg(F.max(F.struct(*columns)).alias("best"))
    return best.select("best.*")


def performance_drift(df: DataFrame, period: str) -> DataFrame:
    """Precision and recall per period, and how far they are from the first period's.

    One row per period reaches the window.
    """
    yes, hit = F.col("label") == 1, F.col("prediction") == 1
    per = df.groupBy(period).agg(
        F.count("*").alias("n"),
        F.count_if(yes & hit).alias("tp"),
        F.count_if(~yes & hit).alias("fp"),
        F.count_if(yes & ~hit).alias("fn"),
    )
    rated = per.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    first = Window.orderBy(period)
    return rated.withColumns(
        {
            "precision_drift": F.col("precision") - F.first("precision").over(first),
            "recall_drift": F.col("recall") - F.first("recall").over(first),
        }
    )


def with_class_weight(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    """Each row with its class's weight, for training on unbalanced classes."""
    ones = df.select(F.col(label).alias("label"))
    n, k = (
        ones.agg(F.count("*").alias("n")).scalar(),
        ones.agg(F.count_if(F.col("label") == 1).alias("k")).scalar(),
    )
    size = F.when(F.col(label) == 1, k).otherwise(n - k)
    return df.withColumn(name, n.cast("double") / (size * 2).cast("double"))


def class_weights(df: DataFrame) -> DataFrame:
    """Weight n / (classes * n of the class), which gives every class the same total."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("all"), F.count("*").alias("k")).alias("t")).scalar()
    return counts.select(
        "label",
        "n",
        (totals["all"].cast("double") / (F.col("n") * totals["k"]).cast("double")).alias("weight"),
    )
