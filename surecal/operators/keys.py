"""Grouping keys and joins of rows with one-row-per-group tables.

A group is one struct column: structs compare null-safely under plain equality, so
a group whose key holds NULL is kept by joins, and joins, windows and aggregates on
the key share one hash partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

KEY = "_g"

# A table of fitted parameters is broadcast up to this many bytes.
BROADCAST_BYTES = 64 << 20


def group_key(by: Sequence[str]) -> Column:
    fields = [F.col(c) for c in by] or [F.lit(0).alias("all")]
    return F.struct(*fields).alias(KEY)


def group_columns(by: Sequence[str]) -> list[Column]:
    return [F.col(KEY).getField(c).alias(c) for c in by]


def table_bytes(df: DataFrame, row_bytes: int = 128, arrays: Sequence[str] = ()) -> int:
    """Size of a materialized table: a flat cost per row plus its array entries."""
    size = F.lit(row_bytes).cast("long")
    for name in arrays:
        size = size + F.coalesce(F.size(name), F.lit(0)).cast("long") * 16
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def join_parameters(
    df: DataFrame,
    parameters: DataFrame,
    by: Sequence[str],
    size: int,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join every row of ``df`` with the parameter row of its group.

    ``size`` is the measured size of ``parameters``. Up to ``limit`` they are
    broadcast and ``df`` is not shuffled. Beyond it both sides are shuffled on the
    group; adaptive execution splits the partition of a hot group, whatever its rows
    hold and however they repeat.
    """
    keyed = df.withColumn("_gl", group_key(by))
    right = parameters.select(
        group_key(by).alias("_gp"), *[c for c in parameters.columns if c not in by]
    )
    right = F.broadcast(right) if size <= limit else right.hint("merge")
    return keyed.join(right, F.col("_gl") == F.col("_gp"), "left").drop("_gl", "_gp")


def join_group_values(df: DataFrame, values: DataFrame, by: Sequence[str]) -> DataFrame:
    """:func:`join_parameters` with a table that is yet to be computed and measured."""
    table = materialize(values)
    arrays = [name for name, kind in table.dtypes if kind.startswith("array")]
    return join_parameters(df, table, by, table_bytes(table, arrays=arrays))
