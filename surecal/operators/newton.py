"""Grouped maximum-likelihood fit of ``sigmoid(a * z + b)`` by Newton's method.

A first pass sums the rows into narrow cells of ``z`` and solves each group on its
cells, which is close to the answer. The passes after it run over the rows themselves
and need no shuffle beyond one row per group and map task; as Newton's method squares
the error, one or two of them suffice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probability import number, sigmoid
from ..session import materialize
from .keys import BROADCAST_BYTES, group_columns, group_key, join_parameters

# Penalty on the slope of the full line: the inverse of a regularization strength of 1e6.
SLOPE_PENALTY = 1e-6
# Range of the slope when it is the inverse of a temperature.
SLOPE_RANGE = (1e-4, 1e4)
# Cells per unit of z, as a power of two.
CELL_BITS = 8
# A step this small, relative to the slope, leaves an error of its square.
STEP_TOLERANCE = 1e-6
MAX_PASSES = 8

_ROW_BYTES = 128


def solve_cells(
    z: np.ndarray, n: np.ndarray, pos: np.ndarray, slope_only: bool
) -> tuple[float, float]:
    """Damped Newton on summed cells; NaN where a line has one class only."""
    if not slope_only and (pos.sum() <= 0 or pos.sum() >= n.sum()):
        return float("nan"), float("nan")
    penalty = 0.0 if slope_only else SLOPE_PENALTY
    low, high = SLOPE_RANGE if slope_only else (-np.inf, np.inf)

    def loss(w: np.ndarray) -> float:
        m = w[0] * z + w[1]
        softplus = np.log1p(np.exp(-np.abs(m))) + np.maximum(m, 0.0)
        return float((n * softplus - pos * m).sum() + 0.5 * penalty * w[0] ** 2)

    def probability(w: np.ndarray) -> np.ndarray:
        return 0.5 * (1.0 + np.tanh(0.5 * (w[0] * z + w[1])))

    if slope_only:
        if not np.any(z):
            return 1.0, 0.0
        # The loss is convex: a slope at an end tells that the best one lies beyond it.
        for end, beyond in ((high, np.less_equal), (low, np.greater_equal)):
            if beyond(((n * probability(np.array([end, 0.0])) - pos) * z).sum(), 0.0):
                return end, 0.0

    w = np.array([1.0, 0.0])
    current = loss(w)
    for _ in range(200):
        s = probability(w)
        residual, weight = n * s - pos, n * s * (1.0 - s)
        gradient = np.array([(residual * z).sum() + penalty * w[0], residual.sum()])
        if slope_only:
            curvature = (weight * z * z).sum()
            step = np.array([gradient[0] / curvature if curvature > 0 else 0.0, 0.0])
        else:
            cross = (weight * z).sum()
            hessian = np.array([[(weight * z * z).sum() + penalty, cross], [cross, weight.sum()]])
            step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        scale = 1.0
        while scale > 1e-10:
            trial = w - scale * step
            trial[0] = min(max(trial[0], low), high)
            value = loss(trial)
            if value <= current:
                break
            scale *= 0.5
        else:
            break
        moved = np.abs(trial - w).max()
        w, current = trial, value
        if moved <= 1e-12 * max(1.0, abs(w[0])):
            break
    return float(w[0]), float(w[1])


def _first_guess(rows: DataFrame, by: Sequence[str], slope_only: bool) -> DataFrame:
    n = F.sum("n").cast("double")
    cells = (
        rows.groupBy("_g", F.floor(F.col("z") * F.lit(float(1 << CELL_BITS))).alias("cell"))
        .agg(
            (F.sum(F.col("z") * F.col("n")) / n).alias("z"),
            n.alias("n"),
            F.sum("pos").alias("pos"),
        )
        # The clipped range of z bounds the cells of a group, however many rows it has.
        .groupBy("_g")
        .agg(F.collect_list(F.struct("z", "n", "pos")).alias("c"))
    )

    @F.pandas_udf("struct<a:double,b:double>")
    def solved(z: pd.Series, n: pd.Series, pos: pd.Series) -> pd.DataFrame:
        fits = [
            solve_cells(np.asarray(zi), np.asarray(ni), np.asarray(pi), slope_only)
            for zi, ni, pi in zip(z, n, pos)
        ]
        return pd.DataFrame(fits, columns=["a", "b"])

    fit = solved(*[F.col("c").getField(name) for name in ("z", "n", "pos")])
    return cells.select(*group_columns(by), fit.alias("fit")).select(
        *by,
        F.when(~F.isnan("fit.a"), F.col("fit.a")).alias("a"),
        F.when(~F.isnan("fit.b"), F.col("fit.b")).alias("b"),
    )


def _improved(
    rows: DataFrame, line: DataFrame, by: Sequence[str], size: int, slope_only: bool
) -> DataFrame:
    """One exact Newton step for each group of ``line``; other groups are left out."""
    open_ = line.select(group_key(by), "a", "b", F.lit(True).alias("open"))
    fitted = join_parameters(rows, open_, ["_g"], size, BROADCAST_BYTES).where("open")
    z, n, residual = F.col("z"), F.col("n"), F.col("n") * F.col("s") - F.col("pos")
    s = sigmoid(F.col("a") * z + F.col("b"))
    sums = (
        fitted.withColumn("s", s)
        .withColumn("w", n * F.col("s") * (F.lit(1.0) - F.col("s")))
        .groupBy("_g")
        .agg(
            F.first("a").alias("a"),
            F.first("b").alias("b"),
            F.sum(residual * z).alias("g1"),
            F.sum(residual).alias("g0"),
            F.sum(F.col("w") * z * z).alias("h11"),
            F.sum(F.col("w") * z).alias("h10"),
            F.sum("w").alias("h00"),
        )
    )
    a, b = F.col("a"), F.col("b")
    if slope_only:
        low, high = SLOPE_RANGE
        step = F.coalesce(F.try_divide("g1", "h11"), F.lit(0.0))
        new_a = F.greatest(F.lit(low), F.least(F.lit(high), a - step))
        new_b = F.lit(0.0)
        inside = (new_a > low) & (new_a < high)
    else:
        g1, h11 = F.col("g1") + SLOPE_PENALTY * a, F.col("h11") + SLOPE_PENALTY
        det = h11 * F.col("h00") - F.col("h10") * F.col("h10")
        new_a = a - F.coalesce(
            F.try_divide(F.col("h00") * g1 - F.col("h10") * F.col("g0"), det), F.lit(0.0)
        )
        new_b = b - F.coalesce(
            F.try_divide(h11 * F.col("g0") - F.col("h10") * g1, det), F.lit(0.0)
        )
        inside = new_a.isNotNull()
    moved = F.greatest(F.abs(new_a - a), F.abs(new_b - b)) / F.greatest(F.lit(1.0), F.abs(a))
    return sums.select(
        *group_columns(by),
        new_a.alias("a"),
        new_b.alias("b"),
        moved.alias("moved"),
        F.coalesce(inside & (moved <= STEP_TOLERANCE), F.lit(False)).alias("converged"),
    )


def fit_logit_line(
    train: DataFrame, y: str, z: Column, by: Sequence[str], slope_only: bool
) -> tuple[DataFrame, int]:
    """``by, a, b, converged`` and the measured size of that table in bytes.

    The source is read once: rows that agree in group and ``z`` become one row of a narrow
    table, on which all passes run. Groups that have settled leave. Only a count reaches
    the driver.
    """
    rows = materialize(
        train.select(group_key(by), z.alias("z"), number(y).alias("y"))
        .where(F.col("z").isNotNull() & F.col("y").isNotNull())
        .groupBy("_g", "z")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    )
    open_ = materialize(_first_guess(rows, by, slope_only))
    size = open_.count() * _ROW_BYTES
    done = []
    for left in range(MAX_PASSES, 0, -1):
        stepped = materialize(_improved(rows, open_, by, size, slope_only))
        # Groups without a fit have no step.
        moving = F.coalesce(F.col("moved") > STEP_TOLERANCE, F.lit(False))
        open_ = stepped.where(moving)
        if left == 1 or not open_.head(1):
            done.append(stepped)
            break
        done.append(stepped.where(~moving))
    return reduce(DataFrame.unionByName, done).select(*by, "a", "b", "converged"), size
