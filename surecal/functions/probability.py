"""Probability expressions: missing values, clipping, logit, sigmoid, loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
# Smallest distance of a probability from 0 and 1 inside a double-precision log loss.
LOSS_EPS = 2.220446049250313e-16


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Cast to double with NaN read as missing, so that aggregates skip it."""
    value = as_column(c).cast("double")
    return F.when(~F.isnan(value), value)


def clip(p: Column | str, eps: float = EPS) -> Column:
    """Bring ``p`` into ``[eps, 1 - eps]``; a missing value stays missing."""
    value = number(p)
    return F.when(
        value.isNotNull(), F.greatest(F.lit(eps), F.least(value, F.lit(1.0 - eps)))
    )


def logit(p: Column | str, eps: float = EPS, clipped: bool = True) -> Column:
    """Log-odds. Without clipping, a probability of 0 or 1 or beyond is an error."""
    if clipped:
        value = clip(p, eps)
        return F.ln(value / (F.lit(1.0) - value))
    value = number(p)
    return F.when(
        (value <= 0.0) | (value >= 1.0),
        F.raise_error(F.lit("probability outside (0, 1) has no finite logit")).cast("double"),
    ).when(value.isNotNull(), F.ln(value / (F.lit(1.0) - value)))


def sigmoid(z: Column | str, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(as_column(z) / t)))


def log_loss(y: Column | str, p: Column | str) -> Column:
    """Per-row negative log-likelihood of a binary label."""
    label, prob = as_column(y), clip(p, LOSS_EPS)
    return -(label * F.ln(prob) + (F.lit(1.0) - label) * F.ln(F.lit(1.0) - prob))
