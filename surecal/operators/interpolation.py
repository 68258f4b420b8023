"""Linear interpolation between knots that are rows, any number of them per group.

Knots and the distinct positions asked for go onto one axis, cut into nested buckets as for
running totals. Every bucket knows its first and last knot; windows over the children of
one bucket carry the last knot from the left and the next one from the right, and what a
bucket lacks comes from the bucket around it. No window covers a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import number
from .keys import KEY, group_columns, group_key, join_group_values
from .running import LEVELS, bucket


def _carried(table: DataFrame, keys: Sequence[str], order: str, first: str, last: str) -> DataFrame:
    """``left``: the last knot of the earlier children of a bucket; ``right``: the next of later ones.

    The second window is sorted the other way round, as a frame that reaches to the end would
    be gone through again for every row.
    """
    earlier = Window.partitionBy(KEY, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(KEY, *keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("left", F.max(last).over(earlier)).withColumn("right", F.min(first).over(later))


def bracketing_knots(points: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Add ``left`` and ``right``, the knots next to each point of a group, itself not included.

    ``points`` has one row per ``_g`` and ``x`` and a column ``knot``, a struct that starts with
    x, NULL where the point is no knot.
    """
    names = [f"_b{i}" for i in range(len(levels))]
    fine = points.withColumn(names[-1], bucket(F.col("x"), levels[-1]))
    for i in range(len(levels) - 2, -1, -1):
        fine = fine.withColumn(names[i], F.shiftright(F.col(names[-1]), levels[-1] - levels[i]))

    tables = [
        fine.groupBy(KEY, *names).agg(F.min("knot").alias("first"), F.max("knot").alias("last"))
    ]
    for depth in range(len(names) - 1, 0, -1):
        tables.insert(0, tables[0].groupBy(KEY, *names[:depth]).agg(
            F.min("first").alias("first"), F.max("last").alias("last")))

    around = None
    for depth in range(len(names) + 1):
        keys = names[:depth]
        if depth == len(names):
            children, keep = _carried(fine, keys, "x", "knot", "knot"), [c for c in points.columns if c != KEY]
        else:
            children, keep = _carried(tables[depth], keys, names[depth], "first", "last"), names[: depth + 1]
        if around is None:
            around = children.select(KEY, *keep, "left", "right")
            continue
        outer = around.select(KEY, *keys, F.col("left").alias("_left"), F.col("right").alias("_right"))
        # Children are sorted on these very keys by their window; only the outer rows move.
        around = children.join(outer.hint("merge"), [KEY, *keys]).select(
            KEY, *keep, F.coalesce("left", "_left").alias("left"), F.coalesce("right", "_right").alias("right")
        )
    return around


def _value(x: Column, knot: Column, left: Column, right: Column) -> Column:
    slope = (right["y"] - left["y"]) / (right["x"] - left["x"])
    return (
        F.when(knot.isNotNull(), knot["y"])
        .when(left.isNull(), right["y"])
        .when(right.isNull(), left["y"])
        .otherwise(slope * (x - left["x"]) + left["y"])
    )


def interpolated_positions(positions: DataFrame, knots: DataFrame) -> DataFrame:
    """(_g, x, y) for the distinct ``positions`` (_g, x), from ``knots`` (_g, x, y)."""
    knot = F.struct("x", "y")
    points = (
        positions.select(KEY, "x", F.lit(True).alias("asked"), F.lit(None).cast(
            knots.select(knot.alias("k")).schema["k"].dataType).alias("knot"))
        .unionByName(knots.select(KEY, "x", F.lit(False).alias("asked"), knot.alias("knot")))
        .groupBy(KEY, "x").agg(F.max("asked").alias("asked"), F.max("knot").alias("knot"))
    )
    return bracketing_knots(points).where("asked").select(
        KEY, "x", _value(F.col("x"), F.col("knot"), F.col("left"), F.col("right")).alias("y")
    )


def interpolate_rows(
    df: DataFrame,
    knots: DataFrame,
    x: str = "x",
    by: Sequence[str] = (),
    knot_x: str = "knot_x",
    knot_y: str = "knot_y",
    out: str = "y",
    position: Column | None = None,
) -> DataFrame:
    """``df`` with ``out``: the piecewise-linear value at ``x`` of the knots of its group.

    Flat outside the knots; NULL for a missing ``x`` and for a group without knots. Knots
    without both numbers are none; of knots at the same place the one with the greatest value
    counts. ``position`` is the place to look at, where it is not ``x`` itself.
    """
    at = number(x) if position is None else position
    placed = knots.select(
        group_key(by), number(knot_x).alias("x"), number(knot_y).alias("y")
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    asked = df.select(group_key(by), at.alias("x")).where(F.col("x").isNotNull()).distinct()
    values = interpolated_positions(asked, placed).select(
        *group_columns(by), F.col("x").alias("_at"), F.col("y").alias("_value")
    )
    placed_rows = df.withColumn("_at", at)
    return join_group_values(placed_rows, values, [*by, "_at"]).select(*df.columns, F.col("_value").alias(out))
