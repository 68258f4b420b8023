"""Tables behind reliability diagrams: bars, curves, run-averaged curves with bands."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import number
from ..functions.sequences import interpolate
from ..session import materialize
from .bins import bin_stats, equal_frequency_arrays, equal_frequency_bin_stats
from .keys import KEY, group_columns, group_key, join_group_values

BANDS = (None, "std", "stderr", "minmax")


def reliability_bars(
    df: DataFrame,
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    edges: Sequence[float] | None = None,
    eps: float = 1e-8,
) -> DataFrame:
    """Bars of a reliability diagram: :func:`bin_stats` plus ``err`` and ``shade``.

    ``err`` is the deviation over the count and ``shade`` the count scaled to [0, 1]
    within the group. ``eps`` keeps both finite; with ``eps=0`` they are NULL where
    the divisor is zero.
    """
    # At most one row per bin of a group enters this window.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    low, high = F.min("n").over(group), F.max("n").over(group)
    return (
        bin_stats(df, y, p, by, edges)
        .withColumn("err", F.try_divide(F.col("std_y"), F.col("n") + F.lit(float(eps))))
        .withColumn("shade", F.try_divide(F.col("n") - low, high - low + F.lit(float(eps))))
    )


def equal_frequency_curve(
    df: DataFrame,
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    n_bins: int = 10,
) -> DataFrame:
    """Points ``(mean_conf, mean_y)`` per equal-frequency bin."""
    stats = equal_frequency_bin_stats(df, y, p, by, n_bins)
    return stats.select(*by, "bin", "mean_conf", "mean_y")


def _band(runs: Column, band: str | None) -> list[Column]:
    """Mean over runs at one grid point and the two ends of its band."""
    mean = F.avg(runs)
    if band is None:
        low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    elif band == "minmax":
        low, high = F.min(runs), F.max(runs)
    else:
        half = F.stddev_pop(runs)
        if band == "stderr":
            half = half / F.sqrt(F.count(runs))
        low, high = mean - half, mean + half
    return [mean.alias("mean"), low.alias("lo"), high.alias("hi"), F.count(runs).alias("n_runs")]


def _averaged(runs: DataFrame, grid: Column, by: Sequence[str], band: str | None) -> DataFrame:
    """Interpolate every run's knots on its grid and average over runs.

    A run becomes as many rows as the grid has points; these are summed up per
    grid point before they are shuffled.
    """
    return (
        runs.select(KEY, "xs", "ys", F.posexplode(grid).alias("i", "x"))
        .select(KEY, "i", "x", interpolate("x", "xs", "ys").alias("y"))
        .groupBy(KEY, "i")
        .agg(F.first("x").alias("x"), *_band(F.col("y"), band))
        .select(*group_columns(by), "i", "x", "mean", "lo", "hi", "n_runs")
    )


def mean_curve(
    df: DataFrame,
    run: str | Sequence[str],
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    n_bins: int = 10,
    error_band: str | None = None,
    n_points: int = 100,
) -> DataFrame:
    """Run-averaged reliability curve on a grid over the range of all bin confidences.

    Each run (``run`` within ``by``) is binned on its own, interpolated on the common
    grid and continued flat outside its range. Runs without a bin take no part;
    ``n_runs`` tells how many did.
    """
    if error_band not in BANDS:
        raise ValueError(f"error_band must be one of {BANDS}")
    run_columns = [run] if isinstance(run, str) else list(run)
    arrays = equal_frequency_arrays(df, y, p, [*by, *run_columns], n_bins)
    # One short row per run. It is written once, as both the range and the curves
    # are read off it.
    runs = materialize(
        arrays.select(
            F.struct(*([F.col(KEY).getField(c).alias(c) for c in by] or [F.lit(0).alias("all")])).alias(KEY),
            F.transform("bins", lambda b: b["mean_conf"]).alias("xs"),
            F.transform("bins", lambda b: b["mean_y"]).alias("ys"),
        )
    )
    ranges = runs.groupBy(KEY).agg(
        F.min(F.get("xs", F.lit(0))).alias("x_min"),
        F.max(F.try_element_at("xs", F.lit(-1))).alias("x_max"),
    )
    step = (F.col("x_max") - F.col("x_min")) / F.lit(float(n_points - 1))
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(n_points - 1)),
        lambda i: F.when(i == n_points - 1, F.col("x_max")).otherwise(i * step + F.col("x_min")),
    )
    return _averaged(join_group_values(runs, ranges, [KEY]), grid, by, error_band)


def curve_of_points(
    points: DataFrame,
    run: str | Sequence[str],
    x: str = "mean_conf",
    y: str = "mean_y",
    by: Sequence[str] = (),
    n_points: int = 200,
    error_band: str | None = "stderr",
) -> DataFrame:
    """Average ready-made curves on a fixed grid of [0, 1], with a standard-error band.

    A run may have any number of points: only the outermost points of each grid cell
    bear on the values at the grid, so these alone are gathered.
    """
    if error_band not in BANDS:
        raise ValueError(f"error_band must be one of {BANDS}")
    run_columns = [run] if isinstance(run, str) else list(run)
    grid_points = np.linspace(0.0, 1.0, n_points).tolist()
    grid = F.array(*[F.lit(g) for g in grid_points])
    # The cell [grid[c], grid[c + 1]) of a point: a guess, set right by the grid itself.
    scaled = F.floor(F.col("_x") * F.lit(float(n_points - 1)))
    guess = F.greatest(F.lit(0), F.least(F.lit(n_points - 1), scaled)).cast("int")
    cell = (
        F.when(F.col("_x") < F.get(grid, F.col("guess")), F.col("guess") - 1)
        .when(F.col("_x") >= F.get(grid, F.col("guess") + 1), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    point = F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"))
    thinned = (
        points.select(
            group_key(by), F.struct(*run_columns).alias("_run"),
            number(x).alias("_x"), number(y).alias("_y"),
        )
        .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
        .withColumn("guess", guess)
        .withColumn("cell", cell)
        # Points on the grid are kept apart, so that none of equal x hides another.
        .groupBy(KEY, "_run", "cell", (F.col("_x") == F.get(grid, F.col("cell"))).alias("on"))
        .agg(F.min(point).alias("a"), F.max(point).alias("b"))
    )
    runs = (
        thinned.groupBy(KEY, "_run")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("k"))
        .select(
            KEY,
            F.transform("k", lambda k: k["x"]).alias("xs"),
            F.transform("k", lambda k: k["y"]).alias("ys"),
        )
    )
    return _averaged(runs, grid, by, error_band)
