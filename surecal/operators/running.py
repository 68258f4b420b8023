"""Running totals over a value within a group, without one task per group.

A window over a whole group puts the group into one task, which a group holding a
third of all rows would not survive. Here the value axis is cut into nested buckets
by a fixed monotone function, totals are rolled up from fine to coarse buckets, and
offsets are handed back down. Every window then covers the children of one bucket.
The buckets depend on the value alone, so a re-run task always sees the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import number
from .keys import KEY, group_columns, group_key

# Buckets per unit of the axis, as powers of two, from coarse to fine.
LEVELS = (6, 22)


def axis(value: Column) -> Column:
    """A monotone spread of the real line: log-odds inside (0, 1), logarithms outside.

    Saturated probabilities, which crowd near 0 and 1, lie far apart on it.
    """
    inside = F.ln(value / (F.lit(1.0) - value))
    above = F.lit(64.0) + F.ln(F.greatest(value, F.lit(1.0)))
    below = F.lit(-800.0) - F.ln(F.lit(1.0) - F.least(value, F.lit(0.0)))
    spread = F.when(value >= 1.0, above).when(value <= 0.0, below).otherwise(inside)
    return F.greatest(F.lit(-1600.0), F.least(F.lit(800.0), spread))


def bucket(value: Column, bits: int) -> Column:
    # Never NULL to the planner: an inferred IS NOT NULL filter on one of the branches
    # below would keep their shared exchange from being reused.
    cell = F.floor(axis(value) * F.lit(float(1 << bits))).cast("long")
    return F.coalesce(cell, F.lit(0).cast("long"))


def running_totals(
    rows: DataFrame, value: str, sums: Sequence[str], levels: Sequence[int] = LEVELS
) -> DataFrame:
    """Add, per row, what lies below it in its group.

    ``rows`` has one row per ``(_g, value)`` and BIGINT columns ``sums``. For each
    of them the result has ``<name>_before`` (sum over smaller values) and
    ``<name>_total`` (sum over the group), and ``below``, the next smaller value.
    """
    names = [f"_b{i}" for i in range(len(levels))]
    fine = rows.withColumn(names[-1], bucket(F.col(value), levels[-1]))
    for i in range(len(levels) - 2, -1, -1):
        fine = fine.withColumn(
            names[i], F.shiftright(F.col(names[-1]), levels[-1] - levels[i])
        )

    def rolled_up(table: DataFrame, keys: list[str], top: str) -> DataFrame:
        return table.groupBy(KEY, *keys).agg(
            *[F.sum(s).alias(s) for s in sums], F.max(top).alias("_top")
        )

    tables = [rolled_up(fine, names, value)]
    for depth in range(len(names) - 1, 0, -1):
        tables.insert(0, rolled_up(tables[0], names[:depth], "_top"))

    def preceding(table: DataFrame, keys: list[str], order: str, top: str, keep: list[str]):
        """Sums and greatest value over the earlier children of the same bucket."""
        window = Window.partitionBy(KEY, *keys).orderBy(order)
        window = window.rowsBetween(Window.unboundedPreceding, -1)
        return table.select(
            KEY,
            *keep,
            *[
                F.coalesce(F.sum(s).over(window), F.lit(0).cast("long")).alias(f"{s}_before")
                for s in sums
            ],
            F.max(top).over(window).alias("below"),
        )

    offsets = preceding(tables[0], [], names[0], "_top", [names[0], *sums])
    group = Window.partitionBy(KEY)
    offsets = offsets.select(
        KEY,
        names[0],
        *[f"{s}_before" for s in sums],
        *[F.sum(s).over(group).alias(f"{s}_total") for s in sums],
        "below",
    )
    values = [c for c in rows.columns if c != KEY]
    for depth in range(1, len(names) + 1):
        keys = names[:depth]
        if depth == len(names):
            children, keep = preceding(fine, keys, value, value, keys + values), values
        else:
            keep = names[: depth + 1]
            children = preceding(tables[depth], keys, names[depth], "_top", keep)
        bases = offsets.select(
            KEY,
            *keys,
            *[F.col(f"{s}_before").alias(f"{s}_base") for s in sums],
            *[f"{s}_total" for s in sums],
            F.col("below").alias("below_base"),
        )
        # The window has the children sorted and hash-partitioned on these very keys,
        # so a merge join moves only the offsets.
        offsets = children.join(bases.hint("merge"), [KEY, *keys]).select(
            KEY,
            *keep,
            *[(F.col(f"{s}_base") + F.col(f"{s}_before")).alias(f"{s}_before") for s in sums],
            *[f"{s}_total" for s in sums],
            F.coalesce("below", "below_base").alias("below"),
        )
    return offsets


def quantile_fractions(probs: Sequence[float]) -> list[float]:
    """Fractions as they come out of a detour over percent."""
    return (np.asarray(probs, dtype=float) * 100.0 / 100.0).tolist()


# Up to this many fractions are compared one by one, inside generated code.
_COMPARED_FRACTIONS = 32


def _position(n: Column, fraction: Column) -> Column:
    """Where a quantile lies among ``n`` sorted values, counted from 0."""
    return (n - F.lit(1)).cast("double") * fraction


def _settled_before(rank: Column, n: Column, fractions: Sequence[float]) -> Column:
    """How many quantiles depend only on values of ranks below ``rank``."""
    if len(fractions) <= _COMPARED_FRACTIONS:
        return reduce(
            add, [(F.ceil(_position(n, F.lit(q))) < rank).cast("int") for q in fractions]
        )
    listed = F.array(*[F.lit(q) for q in fractions])
    return F.size(F.filter(listed, lambda q: F.ceil(_position(n, q)) < rank))


def between_ranks(lower: Column, upper: Column, t: Column) -> Column:
    """Linear interpolation, taken from the nearer end."""
    gap = upper - lower
    return F.when(t >= 0.5, upper - gap * (F.lit(1.0) - t)).otherwise(lower + gap * t)


def with_quantiles(ranked: DataFrame, value: str, fractions: Sequence[float]) -> DataFrame:
    """Add to ranked values (``n``, ``n_before``, ``n_total``, ``below``) what they settle.

    ``passed`` is the number of quantiles settled by smaller values alone, ``through``
    that with this value; ``settled`` is an ``array<struct<j, q>>`` of those whose upper rank is a rank of this value.
    The lower rank is then one of its ranks too, or the last one of ``below``.
    """
    n, first = F.col("n_total"), F.col("n_before")
    listed = F.array(*[F.lit(q) for q in fractions])

    def quantile(j: Column) -> Column:
        h = _position(n, F.get(listed, j))
        here = F.floor(h) >= first
        between = between_ranks(F.col("below"), F.col(value), h - F.floor(h))
        return F.struct(j.alias("j"), F.when(here, F.col(value)).otherwise(between).alias("q"))

    counted_up = ranked.select(
        "*",
        _settled_before(first, n, fractions).alias("passed"),
        _settled_before(first + F.col("n"), n, fractions).alias("through"),
    )
    # Quantiles settle in order, so those of this value are a run of indexes; for
    # nearly all values it is empty.
    settled = F.when(
        F.col("through") > F.col("passed"),
        F.transform(F.sequence(F.col("passed"), F.col("through") - 1), quantile),
    ).otherwise(F.array().cast("array<struct<j:int,q:double>>"))
    return counted_up.withColumn("settled", settled)


def counted(df: DataFrame, value: str, by: Sequence[str], times: str | None = None) -> DataFrame:
    """One row per group and distinct value, with its count; the value is not missing.

    ``times`` names a BIGINT column that tells how many rows each row stands for.
    """
    rows = F.count(F.lit(1)) if times is None else F.sum("_times")
    return (
        df.select(group_key(by), number(value).alias("_v"), *([F.col(times).alias("_times")] if times else []))
        .where(F.col("_v").isNotNull())
        .groupBy(KEY, "_v")
        .agg(rows.alias("n"))
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    name: str = "q",
    times: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group: ``by`` plus ``name`` (an array)."""
    return quantiles_of_counts(counted(df, value, by, times), probs, by, name)


def quantiles_of_counts(
    counts: DataFrame, probs: Sequence[float], by: Sequence[str], name: str = "q"
) -> DataFrame:
    """:func:`exact_quantiles` of what :func:`counted` gives."""
    fractions = quantile_fractions(probs)
    ranked = running_totals(counts, "_v", ["n"])
    settled = with_quantiles(ranked, "_v", fractions).select(KEY, F.explode("settled").alias("s"))
    # At most one row per group and quantile is left here.
    return (
        settled.groupBy(KEY)
        .agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["q"]).alias(name))
        .select(*group_columns(by), name)
    )
