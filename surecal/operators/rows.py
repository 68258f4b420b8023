"""Row order made explicit: a distributed row index and the first rows by a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .keys import join_parameters

# Up to so many rows are merged or sorted in one task.
MERGED_ROWS = 10_000
# Keys that a round of the search for the n-th one counts against.
PROBES = 64


def with_row_index(df: DataFrame, order_by: Sequence[str], out: str = "index") -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_by``.

    Rows are range-partitioned and written once, so that a re-run task keeps its
    boundaries; only one row per partition is numbered in one place.
    """
    return _numbered(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by), out)


def _numbered(df: DataFrame, out: str) -> DataFrame:
    """Add the 0-based position of each row as the partitions hold them, written once."""
    placed = materialize(df.withColumn("_at", F.monotonically_increasing_id()))
    # The id holds the partition in its upper bits and the row in its lower 33.
    part = F.shiftright("_at", 33)
    window = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(window), F.lit(0).cast("long")).alias("_base"))
    )
    # One row per partition: bounded by the partition count, whatever the data.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(
            *df.columns,
            (F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(out),
        )
    )


def head_n(df: DataFrame, order_by: Sequence[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in the order of ``order_by``; all of them for 0 or None.

    ``order_by`` should tell rows apart: among rows it ties, any may come first. A short head
    is merged from the heads of the tasks; for a longer one the n-th key is found by counting
    and the rows are filtered, so no task holds them.
    """
    if not n:
        return df
    if n <= MERGED_ROWS:
        return df.orderBy(*order_by).limit(n)
    return _selected(df, list(order_by), n)


def _selected(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by a search for the n-th key.

    Rows between two known keys are counted against probes drawn from among them, rows equal
    to a probe apart, until the n-th key is a probe or few rows are left to be sorted. Only
    probes and counts reach the driver; each round reads the key columns once. NULL comes
    before all values, as in a sort.
    """
    keys = df.select(F.struct(*order_by).alias("k"))
    inside, below = keys, 0
    while True:
        drawn = inside.orderBy(F.rand(below + 1)).limit(PROBES).agg(F.array_sort(F.collect_set("k")).alias("_p"))
        probes = drawn.first()["_p"]
        if not probes:
            return df
        # Two cells per probe: below it, and equal to it.
        cell = F.size(F.filter("_p", lambda q: q < F.col("k"))) * 2 + F.exists(
            "_p", lambda q: q == F.col("k")).cast("int")
        counts = _against(inside, probes).groupBy(cell.alias("cell")).count().collect()
        seen, found = below, None
        for row in sorted(counts, key=lambda r: r.cell):
            if seen + row["count"] >= n:
                found = row
                break
            seen += row["count"]
        if found is None:
            # Fewer than n rows in all.
            return df
        at, equal = divmod(found.cell, 2)
        if equal:
            last = probes[at]
            break
        if at > 0:
            inside = _against(inside, [probes[at - 1]]).where(F.col("k") > F.get("_p", F.lit(0))).select("k")
        if at < len(probes):
            inside = _against(inside, [probes[at]]).where(F.col("k") < F.get("_p", F.lit(0))).select("k")
        below = seen
        if found["count"] <= MERGED_ROWS:
            last = inside.orderBy("k").limit(n - below).agg(F.max("k").alias("k")).first().k
            break
    bound = F.get("_p", F.lit(0))
    before = _against(keys, [last]).where(F.col("k") < bound).count()
    marked = _against(df.withColumn("k_", F.struct(*order_by)), [last])
    first = marked.where(F.col("k_") < bound).select(*df.columns)
    ties = _numbered(marked.where(F.col("k_") == bound).select(*df.columns), "_i")
    return first.unionByName(ties.where(F.col("_i") < n - before).drop("_i"))


def _against(rows: DataFrame, probes: list) -> DataFrame:
    """``rows`` with the keys ``probes``, at most :data:`PROBES`, as an array ``_p``."""
    key = next(f for f in rows.schema if f.name in ("k", "k_")).dataType
    table = rows.sparkSession.createDataFrame([(probes,)], T.StructType([T.StructField("_p", T.ArrayType(key))]))
    return join_parameters(rows, table, [], 0)
