"""Fitted calibrators: a small parameter table per group, applied to any rows.

Fitting runs jobs and leaves a materialized table with one row per group; applying
is lazy and adds one column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import Bins
from ..functions.probability import EPS, clip, logit, number, sigmoid
from ..functions.sequences import interpolate
from ..session import materialize
from .bins import bin_arrays, grouped_bin_stats
from .interpolation import interpolate_rows
from .isotonic import isotonic_knots
from .keys import BROADCAST_BYTES, group_columns, group_key, join_parameters, table_bytes
from .newton import fit_logit_line


@dataclass(frozen=True)
class Calibrator:
    """Parameters per group and the expression that maps a probability through them."""

    parameters: DataFrame
    by: tuple[str, ...]
    calibrated: Callable[[Column], Column]
    size: int
    broadcast_bytes: int = BROADCAST_BYTES

    def transform(self, df: DataFrame, p: str = "y_prob", out: str = "p_cal") -> DataFrame:
        """``df`` with ``out``: NULL for a missing ``p`` or a group that was not fitted."""
        joined = join_parameters(df, self.parameters, self.by, self.size, self.broadcast_bytes)
        return joined.select(*df.columns, self.calibrated(F.col(p)).alias(out))


# Groups of up to so many knots carry them to their rows as arrays.
ARRAY_KNOTS = 4096


@dataclass(frozen=True)
class KnotCalibrator:
    """Knots per group, one row each, and the place of a probability among them.

    ``most`` is the number of knots of the largest group, ``size`` that of all in bytes.
    """

    parameters: DataFrame
    by: tuple[str, ...]
    score: Callable[[Column | str], Column]
    most: int
    size: int
    array_knots: int = ARRAY_KNOTS
    broadcast_bytes: int = BROADCAST_BYTES

    def transform(self, df: DataFrame, p: str = "y_prob", out: str = "p_cal") -> DataFrame:
        """``df`` with ``out``: NULL for a missing ``p`` or a group that was not fitted.

        Few knots are looked up in the row; where a group has more, the distinct places meet
        the knots in buckets of the axis, and no row or task holds the knots of a group.
        """
        place = self.score(F.col(p))
        if self.most > self.array_knots:
            return interpolate_rows(df, self.parameters, by=self.by, out=out, position=place)
        knots = self.parameters.groupBy(group_key(self.by)).agg(
            F.array_sort(F.collect_list(F.struct("knot_x", "knot_y"))).alias("_k")
        ).select(*group_columns(self.by), F.col("_k.knot_x").alias("_xs"), F.col("_k.knot_y").alias("_ys"))
        joined = join_parameters(df, knots, self.by, self.size, self.broadcast_bytes)
        return joined.select(*df.columns, interpolate(place, "_xs", "_ys").alias(out))


def fit_histogram(
    train: DataFrame,
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    edges: Sequence[float] | None = None,
) -> Calibrator:
    """Mean training label per bin.

    Empty bins are interpolated over the bin midpoints when at least two bins are
    known, and are 0 otherwise. Probabilities outside the edges have no value.
    """
    bins = Bins.of(edges)
    known = F.filter("bins", lambda b: b["mean_y"].isNotNull())
    arrays = bin_arrays(grouped_bin_stats(train, y, p, by, bins), bins).withColumn("known", known)
    knot_x = F.transform("known", lambda b: b["mid"])
    knot_y = F.transform("known", lambda b: b["mean_y"])
    filled = F.transform(
        "bins",
        lambda b: F.when(b["mean_y"].isNotNull(), b["mean_y"])
        .when(F.size("known") >= 2, interpolate(b["mid"], knot_x, knot_y))
        .otherwise(F.lit(0.0)),
    )
    parameters = materialize(arrays.select(*group_columns(by), filled.alias("bin_values")))
    return Calibrator(
        parameters,
        tuple(by),
        lambda c: F.get(F.col("bin_values"), bins.index_of(number(c))),
        table_bytes(parameters, arrays=["bin_values"]),
    )


def fit_isotonic(
    train: DataFrame,
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    eps: float = EPS,
    clipped: bool = True,
) -> KnotCalibrator:
    """Least-squares non-decreasing fit, linear between knots and flat outside them."""

    def score(c: Column | str) -> Column:
        return clip(c, eps) if clipped else number(c)

    parameters = materialize(isotonic_knots(train, y, score(p), by))
    # One number per group.
    per_group = parameters.groupBy(group_key(by)).agg(F.count(F.lit(1)).alias("n"))
    most, knots = per_group.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # An entry of both arrays, and a key per group, which has a knot at least.
    return KnotCalibrator(parameters, tuple(by), score, most, knots * 128)


def fit_platt(
    train: DataFrame,
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    eps: float = EPS,
    clipped: bool = True,
) -> Calibrator:
    """Logistic fit ``a * logit(p) + b`` with a slope penalty of 1e-6.

    ``a`` and ``b`` are NULL for a group with one class, which has no such fit.
    """
    parameters, size = fit_logit_line(train, y, logit(p, eps, clipped), by, slope_only=False)
    return Calibrator(
        parameters,
        tuple(by),
        lambda c: sigmoid(F.col("a") * logit(c, eps, clipped) + F.col("b")),
        size,
    )


def fit_temperature(
    train: DataFrame,
    y: str = "y_true",
    p: str = "y_prob",
    by: Sequence[str] = (),
    eps: float = EPS,
) -> Calibrator:
    """The temperature that minimizes the log loss of ``logit(p) / temperature``.

    ``converged`` is false where no finite, positive temperature does; it is then
    kept within [1e-4, 1e4].
    """
    line, size = fit_logit_line(train, y, logit(p, eps), by, slope_only=True)
    parameters = line.select(*by, (F.lit(1.0) / F.col("a")).alias("temperature"), "converged")
    return Calibrator(
        parameters, tuple(by), lambda c: sigmoid(logit(c, eps), F.col("temperature")), size
    )


def _scaled(model: Calibrator, test: DataFrame, p: str, out: str, return_model: bool):
    result = model.transform(test, p, out)
    return (result, model) if return_model else result


def histogram_scaling(
    train: DataFrame, test: DataFrame, y: str = "y_true", p: str = "y_prob",
    by: Sequence[str] = (), edges: Sequence[float] | None = None, out: str = "p_cal",
    return_model: bool = False,
):
    """Fit :func:`fit_histogram` on ``train`` and add ``out`` to ``test``."""
    return _scaled(fit_histogram(train, y, p, by, edges), test, p, out, return_model)


def isotonic_scaling(
    train: DataFrame, test: DataFrame, y: str = "y_true", p: str = "y_prob",
    by: Sequence[str] = (), eps: float = EPS, clipped: bool = True, out: str = "p_cal",
    return_model: bool = False,
):
    """Fit :func:`fit_isotonic` on ``train`` and add ``out`` to ``test``."""
    return _scaled(fit_isotonic(train, y, p, by, eps, clipped), test, p, out, return_model)


def platt_scaling(
    train: DataFrame, test: DataFrame, y: str = "y_true", p: str = "y_prob",
    by: Sequence[str] = (), eps: float = EPS, clipped: bool = True, out: str = "p_cal",
    return_model: bool = False,
):
    """Fit :func:`fit_platt` on ``train`` and add ``out`` to ``test``."""
    return _scaled(fit_platt(train, y, p, by, eps, clipped), test, p, out, return_model)


def temperature_scaling(
    train: DataFrame, test: DataFrame, y: str = "y_true", p: str = "y_prob",
    by: Sequence[str] = (), eps: float = EPS, out: str = "p_cal",
    return_model: bool = False,
):
    """Fit :func:`fit_temperature` on ``train`` and add ``out`` to ``test``."""
    return _scaled(fit_temperature(train, y, p, by, eps), test, p, out, return_model)
