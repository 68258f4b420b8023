"""Binned calibration statistics with fixed edges and with equal-frequency edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import Bins
from ..functions.probability import number
from ..session import materialize
from .keys import KEY, group_columns, group_key, join_parameters, table_bytes
from .running import quantiles_of_counts

_COMPARED_BINS = 64


def grouped_bin_stats(
    df: DataFrame, y: str, p: str, by: Sequence[str], bins: Bins
) -> DataFrame:
    """``_g, bin_idx`` and the statistics of the rows in it (``bin_idx`` NULL: no bin).

    One shuffle of at most one row per group, bin and map task.
    """
    rows = df.select(group_key(by), number(y).alias("_y"), number(p).alias("_p"))
    return (
        rows.withColumn("bin_idx", bins.index_of(F.col("_p")))
        .groupBy(KEY, "bin_idx")
        .agg(
            F.avg("_y").alias("mean_y"),
            F.stddev_samp("_y").alias("std_y"),
            F.avg("_p").alias("mean_conf"),
            F.count("_y").alias("n"),
        )
    )


def bin_arrays(stats: DataFrame, bins: Bins) -> DataFrame:
    """One row per group with ``bins``: an array holding every bin in order, empty or not."""
    packed = stats.groupBy(KEY).agg(
        F.collect_list(F.struct("bin_idx", "mean_y", "std_y", "mean_conf", "n")).alias("s")
    )

    def filled(bin_: Column) -> Column:
        # By index, as collected order is not fixed; at most one entry matches.
        hit = F.get(
            F.filter(F.col("s"), lambda s: s["bin_idx"] == bin_["bin_idx"]), F.lit(0)
        )
        return F.struct(
            bin_["bin_idx"].alias("bin_idx"),
            bin_["bin"].alias("bin"),
            hit["mean_y"].alias("mean_y"),
            hit["std_y"].alias("std_y"),
            hit["mean_conf"].alias("mean_conf"),
            F.coalesce(hit["n"], F.lit(0).cast("long")).alias("n"),
            bin_["mid"].alias("mid"),
            bin_["start"].alias("start"),
            bin_["end"].alias("end"),
            bin_["width"].alias("width"),
        )

    return packed.select(KEY, F.transform(bins.geometry(), filled).alias("bins"))


def bin_stats(
    df: DataFrame,
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Mean and deviation of the label, mean confidence and count per bin of each group.

    Every bin is present; an empty one has ``n = 0`` and NULL means. ``n`` counts
    labels, while ``mean_conf`` averages all confidences of the bin.
    """
    bins = Bins.of(edges)
    arrays = bin_arrays(grouped_bin_stats(df, y, p, by, bins), bins)
    return arrays.select(*group_columns(by), F.inline("bins"))


def _edges_below(p: Column, edges: Column, n_bins: int) -> Column:
    """How many of a group's own edges lie below ``p``."""
    if n_bins <= _COMPARED_BINS:
        # Plain comparisons stay inside generated code; there may be fewer edges.
        return reduce(
            add,
            [
                F.coalesce((p > F.get(edges, F.lit(i))).cast("int"), F.lit(0))
                for i in range(n_bins + 1)
            ],
        )
    return F.size(F.filter(edges, lambda e: e < p))


def _scores(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """One row per group and distinct probability, with the moments of its labels, written.

    ``ny`` labels of mean ``my`` and sum of squared deviations ``m2``: moments that can be put
    together without taking large numbers from each other.
    """
    label = F.col("_y")
    return materialize(
        df.select(group_key(by), number(y).alias("_y"), number(p).alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(KEY, "_v")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count(label).alias("ny"),
            F.avg(label).alias("my"), (F.var_pop(label) * F.count(label)).alias("m2"),
        )
    )


def _in_bins(scores: DataFrame, edges: DataFrame, n_bins: int, size: int) -> DataFrame:
    """``scores`` with their ``bin`` between the edges of their group; groups without edges go."""
    below = _edges_below(F.col("_v"), F.col("_edges"), n_bins)
    return (
        join_parameters(scores, edges, [KEY], size)
        .where(F.col("_edges").isNotNull())
        # Bins hold their upper edge; the lowest value joins the first bin.
        .withColumn("bin", F.greatest(below - 1, F.lit(0)))
        .drop("_edges")
    )


def _statistics(binned: DataFrame, size: int, deviations: bool) -> DataFrame:
    """Statistics per group and bin; ``std_y`` from a second look, around the mean of the bin.

    ``size`` bounds the table of bin means in bytes.
    """
    n = F.sum("ny")
    mean_y = F.try_divide(F.sum(F.col("my") * F.col("ny")), n)
    columns = [
        mean_y.alias("mean_y"),
        (F.sum(F.col("_v") * F.col("n")) / F.sum("n")).alias("mean_conf"),
        n.alias("n"),
        F.min("_v").alias("start"),
        F.max("_v").alias("end"),
    ]
    if deviations:
        means = binned.groupBy(KEY, "bin").agg(mean_y.alias("_mean"))
        binned = join_parameters(binned, means, [KEY, "bin"], size)
        off = F.col("my") - F.col("_mean")
        spread = F.sum(F.col("m2") + F.col("ny") * off * off)
        columns.append(F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std_y"))
    return binned.groupBy(KEY, "bin").agg(*columns).withColumn("width", F.col("end") - F.col("start"))


def grouped_equal_frequency_stats(
    df: DataFrame,
    y: str,
    p: str,
    by: Sequence[str],
    n_bins: int,
    accuracy: int | None = None,
    deviations: bool = True,
) -> DataFrame:
    """``_g, bin`` and the statistics of each non-empty equal-frequency bin.

    The source is read once, into one row per group and distinct probability. Ranking these
    leaves exact, linearly interpolated quantiles per group, equal ones merged, against
    which the same narrow table is then binned. With ``accuracy`` the edges come from
    :func:`approximate_edges` instead: a second scan, and no ranking.
    """
    if n_bins < 1:
        raise ValueError("n_bins must be positive")
    scores = _scores(df, y, p, by)
    fractions = np.linspace(0.0, 1.0, n_bins + 1)
    if accuracy is None:
        quantiles = quantiles_of_counts(scores.select(KEY, "_v", "n"), fractions, by, "_edges")
    else:
        quantiles = approximate_edges(df, p, by, n_bins, accuracy).withColumnRenamed("edges", "_edges")
    edges = materialize(
        quantiles.select(group_key(by), F.array_distinct("_edges").alias("_edges"))
        # One distinct edge bounds no bin at all.
        .where(F.size("_edges") >= 2)
    )
    # A bin mean takes no more than eight times what an edge does.
    size = table_bytes(edges, arrays=["_edges"])
    return _statistics(_in_bins(scores, edges, n_bins, size), size * 8, deviations)


def approximate_edges(
    df: DataFrame,
    p: str = "y_prob",
    by: Sequence[str] = (),
    n_bins: int = 10,
    accuracy: int = 10_000,
) -> DataFrame:
    """``by, edges``: values of a group whose ranks are near those of its equal-frequency edges.

    One scan with a mergeable quantile sketch per group, for groups whose distinct
    probabilities are too many to be ranked. The rank of an edge is off by at most one in
    ``accuracy`` of the rows; edges are observed values and may repeat. The least and the
    greatest value of a group are exact.
    """
    if n_bins < 1 or accuracy < 1:
        raise ValueError("n_bins and accuracy must be positive")
    value = number(p)
    fractions = [float(f) for f in np.linspace(0.0, 1.0, n_bins + 1)]
    return (
        df.select(group_key(by), value.alias("_v")).where(F.col("_v").isNotNull())
        .groupBy(KEY)
        .agg(
            F.percentile_approx("_v", fractions, accuracy).alias("_edges"),
            F.min("_v").alias("_low"), F.max("_v").alias("_high"),
        )
        .select(
            *group_columns(by),
            F.transform("_edges", lambda e, i: F.when(i == 0, F.col("_low")).when(
                i == n_bins, F.col("_high")).otherwise(e)).alias("edges"),
        )
    )


def equal_frequency_arrays(
    df: DataFrame, y: str, p: str, by: Sequence[str], n_bins: int
) -> DataFrame:
    """One row per group with ``bins``: its non-empty equal-frequency bins in order."""
    stats = grouped_equal_frequency_stats(df, y, p, by, n_bins, deviations=False)
    entry = F.struct("bin", "mean_y", "mean_conf", "n")
    return stats.groupBy(KEY).agg(F.array_sort(F.collect_list(entry)).alias("bins"))


def equal_frequency_bin_stats(
    df: DataFrame,
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    n_bins: int = 10,
    accuracy: int | None = None,
) -> DataFrame:
    """Statistics per equal-frequency bin: ``bin`` (0-based), means, count, observed range.

    Tied probabilities stay together, so fewer than ``n_bins`` bins may come out; a
    group with one distinct probability has none. Edges are exact; ``accuracy`` asks for
    sketched ones, see :func:`approximate_edges`.
    """
    stats = grouped_equal_frequency_stats(df, y, p, by, n_bins, accuracy)
    return stats.select(
        *group_columns(by), "bin", "mean_y", "std_y", "mean_conf", "n", "start", "end", "width"
    )
