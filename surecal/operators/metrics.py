"""Calibration and ranking metrics, one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import Bins, equal_width_edges
from ..functions.probability import clip, log_loss, logit, number, sigmoid
from .bins import grouped_bin_stats
from .keys import KEY, group_columns, group_key
from .running import running_totals


def expected_calibration_error(
    df: DataFrame,
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    n_bins: int = 10,
) -> DataFrame:
    """``by`` and ``ece`` over ``n_bins`` equal bins; 0 for a group with nothing in range."""
    stats = grouped_bin_stats(df, y, p, by, Bins.of(equal_width_edges(n_bins)))
    used = F.col("bin_idx").isNotNull() & F.col("mean_y").isNotNull()
    gap = F.col("n") * F.abs(F.col("mean_conf") - F.col("mean_y"))
    return (
        stats.groupBy(KEY)
        .agg(
            F.coalesce(
                F.try_divide(F.sum(F.when(used, gap)), F.sum(F.when(used, F.col("n")))),
                F.lit(0.0),
            ).alias("ece")
        )
        .select(*group_columns(by), "ece")
    )


def _mean_of(df: DataFrame, value: Column, by: Sequence[str], name: str) -> DataFrame:
    return (
        df.select(group_key(by), value.alias("_x"))
        .groupBy(KEY)
        .agg(F.avg("_x").alias(name))
        .select(*group_columns(by), name)
    )


def brier_score(
    df: DataFrame, y: str = "y_true", p: str = "y_prob", by: Sequence[str] = ()
) -> DataFrame:
    gap = number(p) - number(y)
    return _mean_of(df, gap * gap, by, "brier_score")


def accuracy(df: DataFrame, y: str = "y_true", by: Sequence[str] = ()) -> DataFrame:
    return _mean_of(df, number(y), by, "accuracy")


def negative_log_likelihood(
    df: DataFrame,
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    log_temperature: float | None = None,
) -> DataFrame:
    """Mean log loss, of ``p`` itself or of its logit divided by ``exp(log_temperature)``."""
    prob = clip(p)
    if log_temperature is not None:
        prob = sigmoid(logit(p), F.exp(F.lit(float(log_temperature))))
    return _mean_of(df, log_loss(number(y), prob), by, "nll")


def scored_counts(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """One row per group and distinct score, a missing one included, with its labels.

    ``pos`` and ``neg`` count labelled rows with that score, ``unlabelled`` rows with that
    score alone. In the row of the missing score these are 0, so that it ranks nowhere, and
    ``pos_unscored`` and ``rest`` count its positives and its rows. Every group has a row,
    and both ranking metrics and every binned one follow from this table.
    """
    label, scored = F.col("_y"), F.col("_p").isNotNull()
    checked = F.when(label.isNull() | label.isin(0.0, 1.0), label).otherwise(
        F.raise_error(F.lit("labels must be 0 or 1")).cast("double")
    )

    def rows(condition: Column, name: str) -> Column:
        return F.count(F.when(condition, 1)).alias(name)

    labelled = label.isNotNull()
    return (
        df.select(group_key(by), number(y).alias("_y"), number(p).alias("_p"))
        .withColumn("_y", checked)
        .groupBy(KEY, "_p")
        .agg(
            rows(scored & (label == 1.0), "pos"),
            rows(scored & (label == 0.0), "neg"),
            rows(scored & ~labelled, "unlabelled"),
            rows(~scored & (label == 1.0), "pos_unscored"),
            rows(~scored & labelled, "labelled_unscored"),
            rows(~scored, "rest"),
        )
    )


def _ranked(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    return running_totals(scored_counts(df, y, p, by), "_p", ["pos", "neg"])


def _auc_term() -> Column:
    """Pairs ranked right at this score, a tie counting half."""
    below = F.col("neg_before").cast("double") + F.col("neg").cast("double") / F.lit(2.0)
    return F.col("pos").cast("double") * below


def _ap_term() -> Column:
    """Precision at this score times the positives found there."""
    hits = (F.col("pos_total") - F.col("pos_before")).cast("double")
    alarms = (F.col("neg_total") - F.col("neg_before")).cast("double")
    return F.coalesce(F.try_divide(F.col("pos").cast("double") * hits, hits + alarms), F.lit(0.0))


def _auc(terms: Column) -> Column:
    # Always true, but it keeps both running totals in use: were one of them pruned, the
    # branches of the ranking would differ and the source would be read once for each.
    ranked = F.max("pos_before") >= 0
    pairs = F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
    return F.when((pairs > 0) & ranked, terms / pairs)


def _average_precision(terms: Column) -> Column:
    positives = F.max("pos_total").cast("double")
    return F.when(positives > 0, terms / positives).otherwise(F.lit(0.0))


def roc_auc(
    df: DataFrame, y: str = "y_true", p: str = "y_prob", by: Sequence[str] = ()
) -> DataFrame:
    """Exact, tie-aware area under the ROC curve; NULL for a group with one class."""
    return (
        _ranked(df, y, p, by)
        .groupBy(KEY)
        .agg(_auc(F.sum(_auc_term())).alias("roc_auc"))
        .select(*group_columns(by), "roc_auc")
    )


def average_precision(
    df: DataFrame, y: str = "y_true", p: str = "y_prob", by: Sequence[str] = ()
) -> DataFrame:
    """Step-wise average precision (no interpolation); 0 for a group without positives."""
    return (
        _ranked(df, y, p, by)
        .groupBy(KEY)
        .agg(_average_precision(F.sum(_ap_term())).alias("average_precision"))
        .select(*group_columns(by), "average_precision")
    )


def calculate_metrics(
    df: DataFrame,
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    n_bins: int = 10,
) -> DataFrame:
    """Brier score, ROC AUC, average precision, ECE and accuracy from one scan.

    Everything is a sum over the distinct scores of a group, so the score table is
    built and ranked once. Each metric takes the rows that the single function takes:
    accuracy all labels, ECE the confidences and labels of each bin, the others rows with
    both. Every group has a row; ``n_rows`` counts its rows and ``n`` those with both.
    """
    bins = Bins.of(equal_width_edges(n_bins))
    score, pos, neg = F.col("_p"), F.col("pos"), F.col("neg")
    n, confident = pos + neg, pos + neg + F.col("unlabelled")
    per_bin = (
        _ranked(df, y, p, by)
        .withColumn("bin_idx", bins.index_of(score))
        .groupBy(KEY, "bin_idx")
        .agg(
            F.sum(n).alias("n"),
            F.sum(confident + F.col("rest")).alias("n_rows"),
            F.sum(confident).alias("n_conf"),
            F.sum(pos).alias("n_pos"),
            F.sum("pos_unscored").alias("pos_unscored"),
            F.sum("labelled_unscored").alias("labelled_unscored"),
            F.sum(score * confident).alias("sum_p"),
            F.sum(
                pos * (score - F.lit(1.0)) * (score - F.lit(1.0)) + neg * score * score
            ).alias("brier"),
            F.sum(_auc_term()).alias("auc"),
            F.sum(_ap_term()).alias("ap"),
            F.max("pos_total").alias("pos_total"),
            F.max("neg_total").alias("neg_total"),
            F.max("pos_before").alias("pos_before"),
        )
    )
    used = F.col("bin_idx").isNotNull() & (F.col("n") > 0)
    gap = F.abs(F.try_divide("sum_p", "n_conf") - F.try_divide("n_pos", "n"))
    return (
        per_bin.groupBy(KEY)
        .agg(
            F.try_divide(F.sum("brier"), F.sum("n")).alias("brier_score"),
            _auc(F.sum("auc")).alias("roc_auc"),
            _average_precision(F.sum("ap")).alias("average_precision"),
            F.coalesce(
                F.try_divide(
                    F.sum(F.when(used, F.col("n") * gap)), F.sum(F.when(used, F.col("n")))
                ),
                F.lit(0.0),
            ).alias("ece"),
            F.try_divide(
                F.sum(F.col("n_pos") + F.col("pos_unscored")), F.sum(F.col("n") + F.col("labelled_unscored"))
            ).alias("accuracy"),
            F.sum("n").alias("n"),
            F.sum("n_rows").alias("n_rows"),
        )
        .select(
            *group_columns(by),
            "brier_score",
            "roc_auc",
            "average_precision",
            "ece",
            "accuracy",
            "n",
            "n_rows",
        )
    )
