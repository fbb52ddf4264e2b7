"""Whole jobs from stored tables to stored tables: line tables, candidate panels, churn model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions import hashing
from stayline.operators import activity as acts
from stayline.operators import evaluate, features, model, panel as panels, permutation
from stayline.operators.preparation import Preparation, PreparationModel
from stayline.session import durable
from stayline.sources import contracts
from stayline.sources.writers import overwrite

CUSTOMER_LINES, INSTALL_LINES, CHURNED_LINES = "customer_lines", "install_lines", "churned_lines"
CHURN_PANEL, ACTIVE_PANEL = "churn_cpe_features", "active_cpe_features"
SHORT_PROFILE = ("chnl_nm", "install_type", "market_type", "order_fulfilment", "usage_flag")
WIDE_PROFILE = tuple(contracts.PROFILE.fieldNames()[2:])
DISCONNECT_COLUMNS = (
    "cust_line_seq_id", "pplan_cd", "eqp_prod_nm", "change_reas_cd", "acct_num",
    "coe_pplan_sub_type_desc",
)
PANEL_LINE = (
    "cust_line_seq_id", "pplan_cd", "eqp_prod_nm", "coe_pplan_sub_type_desc", "acct_num",
    "market_type", "order_fulfilment",
)


def line_tables(activity: DataFrame, profile: DataFrame, cutoff: date) -> dict[str, DataFrame]:
    """Lines in scope with the short and the wide profile, and the disconnected lines."""
    rows = contracts.conform_activity(activity)
    # One row per line, here and in ``features.feature_table``: more would multiply the line's days.
    lines = durable(acts.one_row_per_line(contracts.conform(profile, contracts.PROFILE)))
    scope = acts.in_scope(rows, cutoff)
    ended = acts.churned_lines(
        acts.activations(rows, cutoff), acts.disconnects(rows, cutoff), DISCONNECT_COLUMNS
    )
    return {
        CUSTOMER_LINES: acts.with_profile(scope, lines, SHORT_PROFILE),
        INSTALL_LINES: acts.with_profile(scope, lines, WIDE_PROFILE, bucket_channel=False),
        CHURNED_LINES: acts.with_profile(ended, lines, SHORT_PROFILE).withColumn(
            "mdn_5g", F.col("mtn")
        ),
    }


def candidate_panels(
    churned: DataFrame, customers: DataFrame, panel: DataFrame, days: int = 30
) -> dict[str, DataFrame]:
    """Telemetry of the closed lookback before each disconnect, and of the lines that stayed.

    Both read only the days the lookbacks span, so a panel partitioned by day is pruned. Of these days the rows of the
    lines in question are stored once for both, so the panel is read once and other lines' rows are in no shuffle of a panel.
    """
    lines = churned.select(*panels.KEY).unionByName(panels.stable_lines(customers))
    span = panels.scan_range(panel, panels.lookback_bounds(churned, days))
    span = durable(span.join(lines, list(panels.KEY), "left_semi"))
    return {
        CHURN_PANEL: panels.lookback(
            churned.select(*panels.KEY, *PANEL_LINE, "deact_dt", "deact_cd"), span, days
        ),
        ACTIVE_PANEL: panels.active_panel(customers, span, (*PANEL_LINE, "activity_cd")),
    }


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        overwrite(df, f"{root}/{name}")


def model_rows(
    stayed: DataFrame, churned: DataFrame, *, churn_after: date, days: int = 30
) -> DataFrame:
    """Design matrix from the stored panels: sampled days of lines that stayed, open lookback of
    lines that left, mean scores, one-hot categories."""
    sampled = panels.sample_days(stayed.where(F.col("activity_cd") == "AC"), days)
    last = churned.where(
        (F.col("deact_cd") == "DE")
        & (F.col("deact_dt") > F.lit(churn_after))
        & (F.col("cpe_date") > F.date_sub("deact_dt", days))
        & (F.col("cpe_date") < F.col("deact_dt"))
    )
    means = features.score_means(features.label_panels(sampled, last)).drop("n_days")
    return features.one_hot(
        features.tidy_categories(means),
        [*panels.KEY, "row_key", *features.MODEL_SCORES, "acct_num"],
    )


@dataclass
class Trained:
    model: RandomForestClassificationModel
    inputs: list[str]
    rows: DataFrame

    def scored(self) -> DataFrame:
        """All rows with ``is_test``, label, prediction, probability and whole-number score."""
        return model.score(self.model, self.rows, self.inputs)

    def importances(self) -> DataFrame:
        return model.importances(self.model, self.rows, self.inputs)

    def confusion(self) -> DataFrame:
        """Confusion matrix of both sides."""
        side = F.when(F.col("is_test"), "test").otherwise("train").alias("side")
        return self.scored().groupBy(side, "label", "prediction").agg(F.count("*").alias("n"))

    def report(self) -> DataFrame:
        """Classification report and area under the ROC curve of both sides."""
        scored = durable(self.scored().select("is_test", "label", "prediction", "score"))
        sides = []
        for name, side in (("train", ~F.col("is_test")), ("test", F.col("is_test"))):
            part = scored.where(side)
            auc = evaluate.roc_auc(part).select("roc_auc").scalar()
            sides.append(
                evaluate.classification_report(part).select(
                    F.lit(name).alias("side"), "*", auc.alias("roc_auc")
                )
            )
        return sides[0].unionByName(sides[1])


@dataclass
class Prepared:
    """All rows with their side, imputed; those the forest is fitted on; its inputs."""

    rows: DataFrame
    fit_on: DataFrame
    inputs: list[str]
    weight: str | None


def prepare(
    rows: DataFrame,
    *,
    test_share: float = 0.3,
    balance_first: bool = False,
    with_account: bool = False,
    one_pass_means: bool = False,
    weighted: bool = False,
    fit_rows: int | None = None,
) -> Prepared:
    """The training input of a design matrix with a unique ``row_key``.

    By default the rows are split by line first; donors and means for missing scores come from the training
    rows, and only those are balanced. ``balance_first`` balances everything before the split and
    ``one_pass_means`` takes donors and means from all rows, which flatters the test figures. ``weighted``
    keeps all training rows and weights the classes instead. The forest gets all of these rows; a caller whose driver
    cannot hold so large a forest may name ``fit_rows`` and gets one of a random part of about that size. All rows are scored.
    """
    scores: Sequence[str] = features.MODEL_SCORES
    inputs = [*scores, *features.one_hot_columns()]
    if with_account:
        # An identifier has no mean to fill gaps with; an unreadable number counts as zero.
        inputs.append("acct_num")
        rows = rows.fillna(0.0, ["acct_num"])
    rows = features.split_train_test(durable(rows), list(panels.KEY), test_share)
    # Several passes read the filled rows, so they are stored once.
    training = ~F.col("is_test")
    donors = None if one_pass_means else rows.where(training)
    rows = durable(
        features.impute_hot_deck(rows, "scaled_5g_uptime", ["row_key"], "donor", donors)
    )
    rows = features.impute_mean(rows, scores, None if one_pass_means else rows.where(training))
    weight = None
    if weighted:
        weight = "class_weight"
        fit_on = durable(
            evaluate.with_class_weight(rows.where(training), features.LABEL, weight)
        )
    elif balance_first:
        rows = durable(features.balance_classes(rows, ["row_key"]))
        fit_on = rows.where(training)
    else:
        fit_on = durable(features.balance_classes(rows.where(training), ["row_key"]))
    return Prepared(rows, bounded(fit_on, fit_rows), inputs, weight)


def bounded(fit_on: DataFrame, fit_rows: int | None) -> DataFrame:
    """All rows, unless the caller names a number: then of more rows a random part of about that size."""
    if fit_rows is None or (n := fit_on.count()) <= fit_rows:
        return fit_on
    return fit_on.where(hashing.below_share("fit", ["row_key"], fit_rows / n))


def train(
    rows: DataFrame,
    *,
    trees: int = 100,
    max_depth: int = 30,
    max_bins: int = model.MAX_BINS,
    min_leaf: int = model.MIN_LEAF,
    **preparation,
) -> Trained:
    """Fit the forest on the input that ``prepare`` makes of a design matrix with its options."""
    ready = prepare(rows, **preparation)
    forest = model.train_forest(
        ready.fit_on, ready.inputs, trees=trees, max_depth=max_depth, max_bins=max_bins,
        min_leaf=min_leaf, weight=ready.weight,
    )
    return Trained(forest, ready.inputs, ready.rows)


# ---- models that outlive their session --------------------------------------------------------


def fit_model(
    rows: DataFrame,
    *,
    preparation: Preparation | None = None,
    weighted: bool = False,
    fit_rows: int | None = None,
    trees: int = 100,
    max_depth: int = 30,
    max_bins: int = model.MAX_BINS,
    min_leaf: int = model.MIN_LEAF,
) -> PipelineModel:
    """Preparation, assembler and forest learned from training rows, as one pipeline to write and read again.

    ``rows`` is a feature table (``features.feature_table``) with a unique ``row_key`` and its label Y or N: training rows only, so
    split before. Its levels, donors and means are learned from all of them; the forest from classes of equal size (or
    ``weighted``), of a part only where ``fit_rows`` is named. ``model.write().save(path)`` keeps it, ``PipelineModel.load`` brings it back.
    """
    known = durable(labelled(rows).where(F.col(features.LABEL).isNotNull()))
    learned: PreparationModel = (preparation or Preparation()).fit(known)
    # What the preparation learned from rows goes over to any others; here the same rows are prepared once for the trees.
    ready = durable(learned.transform(known))
    if weighted:
        fit_on = durable(evaluate.with_class_weight(ready, features.LABEL, "class_weight"))
    else:
        fit_on = durable(features.balance_classes(ready, ["row_key"]))
    forest = model.train_forest(
        bounded(fit_on, fit_rows), learned.inputs(), trees=trees, max_depth=max_depth, max_bins=max_bins, min_leaf=min_leaf,
        weight="class_weight" if weighted else None,
    )
    return PipelineModel([learned, VectorAssembler(inputCols=learned.inputs(), outputCol="features"), forest])


def labelled(rows: DataFrame) -> DataFrame:
    """The label as 0 or 1."""
    label = F.col(features.LABEL).cast("string")
    return rows.withColumn(features.LABEL, F.when(label.isin("Y", "1"), 1).when(label.isin("N", "0"), 0))


def score_rows(fitted: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction`` (0/1), ``probability`` and whole-number ``score``; a label is not needed and, if there, becomes 0/1."""
    if features.LABEL in rows.columns:
        rows = labelled(rows)
    scored = fitted.transform(rows)
    chance = model.vector_to_array(F.col("probability"))[1]
    return scored.select(
        *rows.columns, F.col("prediction").cast("int").alias("prediction"), chance.alias("probability"),
        model.fixed_point(chance).alias("score"),
    )


def permutation_importances(fitted: PipelineModel, rows: DataFrame) -> DataFrame:
    """(feature, n, accuracy, accuracy_shuffled, importance) of the model's inputs on labelled rows, such as the test side."""
    learned, assembler, forest = fitted.stages
    ready = learned.transform(labelled(rows)).select("row_key", features.LABEL, *learned.inputs())

    def predict(copies: DataFrame) -> DataFrame:
        judged = forest.transform(assembler.transform(copies))
        return judged.select("shuffled", features.LABEL, F.col("prediction").cast("int").alias("prediction"))

    return permutation.importances(ready, ["row_key"], learned.inputs(), predict, features.LABEL)
