"""Isotonic regression by distributed pooling.

Neighbours that break the order belong to one block of the final fit, so any sorted
stretch may be pooled on its own first. Rows are pooled within slices of the value
axis, fine ones and then coarse ones. A block that is above all blocks of the slices before
its own and below all of those after it is settled: pooling averages, so nothing can ever
reach it. Only what lies around the borders of slices is left, and is pooled in stretches
of slices that no clean border cuts. Knots are rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.probability import number
from ..session import materialize
from .keys import KEY, group_columns, group_key, join_parameters, table_bytes
from .running import bucket

# Slices per unit of the value axis, as powers of two: blocks of fine slices are pooled
# again in coarser ones before those around borders meet. The axis is bounded, so a group has
# a few thousand coarse slices at most.
SLICE_BITS = (8, 2)
# Blocks at the end of an open key that are pooled with the next batch at first.
_TAIL = 64
# Rounds of whole-array pooling before the block-by-block pass takes over.
_ROUNDS = 64


def pool(
    first: np.ndarray, total: np.ndarray, count: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool neighbours whose means do not increase; ``first`` marks where a new group starts.

    Equal means become one block too, which leaves the fit as it is.

    Returns the start position, total and count of each block.
    """
    starts = np.arange(len(total))
    for _ in range(_ROUNDS):
        mean = total / count
        joins = np.flatnonzero((mean[:-1] >= mean[1:]) & ~first[1:])
        if not len(joins):
            return starts, total, count
        keep = np.delete(np.arange(len(total)), joins + 1)
        total, count = np.add.reduceat(total, keep), np.add.reduceat(count, keep)
        first, starts = first[keep], starts[keep]
    blocks: list[list] = []
    for begins, at, t, n in zip(first, starts, total, count):
        blocks.append([begins, at, t, n])
        while not blocks[-1][0] and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, _, t_last, n_last = blocks.pop()
            blocks[-1][2] += t_last
            blocks[-1][3] += n_last
    _, at, t, n = zip(*blocks)
    return np.array(at), np.array(t), np.array(n)


def _pool_table(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Blocks of sorted rows, where each starts, and the key of each."""
    table = table.combine_chunks()
    key = table["_k"].to_numpy()
    first = np.r_[True, key[1:] != key[:-1]]
    starts, total, count = pool(first, table["total"].to_numpy(), table["count"].to_numpy())
    at, ends = pa.array(starts), pa.array(np.r_[starts[1:], len(key)] - 1)
    pooled = pa.Table.from_arrays(
        [
            table[KEY].take(at),
            table["_k"].take(at),
            table["lo"].take(at),
            table["hi"].take(ends),
            pa.array(total, pa.float64()),
            pa.array(count, pa.float64()),
        ],
        schema=table.schema,
    )
    return pooled, starts, key[starts]


def pool_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool sorted batches of ``_g, _k, lo, hi, total, count`` per key ``_k``.

    Only the blocks of the key still open are held from one batch to the next, and only
    as many of the last ones are pooled again as the new batch can reach.
    """
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        new, tail = pa.Table.from_batches([batch]), _TAIL
        while True:
            cut = 0 if held is None else max(0, held.num_rows - tail)
            joined = new if held is None else pa.concat_tables([held.slice(cut), new])
            pooled, starts, key = _pool_table(joined)
            # The first block again as it was: nothing before it can change either.
            if cut == 0 or (len(starts) > 1 and starts[1] == 1):
                break
            tail *= 8
        closed = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1
        settled = [] if held is None else [held.slice(0, cut)]
        if closed:
            for part in [*settled, pooled.slice(0, closed)]:
                yield from part.to_batches()
            held = pooled.slice(closed)
        else:
            held = pa.concat_tables([*settled, pooled])
    if held is not None:
        yield from held.to_batches()


def _pooled(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pool all blocks that agree on ``keys``."""
    schema = T.StructType(
        [
            T.StructField(KEY, blocks.schema[KEY].dataType),
            T.StructField("_k", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in ("lo", "hi", "total", "count")],
        ]
    )
    return (
        blocks.repartition(*keys)
        .sortWithinPartitions(*keys, "lo")
        .select(KEY, F.xxhash64(*keys).alias("_k"), "lo", "hi", "total", "count")
        .mapInArrow(pool_batches, schema)
    )


def _slice_limits(blocks: DataFrame) -> DataFrame:
    """Per coarse slice: the greatest mean before it, the least after it, and its stretch.

    Blocks of a slice ascend, so its least and greatest means are all that others need. A
    border is clean if all means before it are below all means behind it.
    """
    slices = blocks.groupBy(KEY, "_slice").agg(F.min("_mean").alias("_least"), F.max("_mean").alias("_most"))
    up = Window.partitionBy(KEY).orderBy("_slice")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(KEY).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    limits = slices.select(
        KEY, "_slice", F.max("_most").over(before).alias("_before"), F.min("_least").over(after).alias("_after"),
        "_least",
    )
    clean = F.col("_before").isNull() | (F.col("_before") < F.least("_least", "_after"))
    return limits.withColumn("_stretch", F.sum(clean.cast("long")).over(up)).drop("_least")


def isotonic_blocks(df: DataFrame, y: str, score: Column, by: Sequence[str]) -> DataFrame:
    """``_g, lo, hi, total, count``: the blocks of the fit of each group."""
    points = (
        df.select(group_key(by), number(y).alias("_y"), score.alias("_p"))
        .where(F.col("_y").isNotNull() & F.col("_p").isNotNull())
        .groupBy(KEY, "_p")
        .agg(F.sum("_y").alias("total"), F.count(F.lit(1)).cast("double").alias("count"))
        .select(KEY, F.col("_p").alias("lo"), F.col("_p").alias("hi"), "total", "count")
    )
    blocks = points
    for bits in SLICE_BITS:
        blocks = _pooled(blocks.withColumn("_slice", bucket(F.col("lo"), bits)), [KEY, "_slice"])
    columns = [KEY, "lo", "hi", "total", "count"]
    blocks = materialize(blocks.select(*columns))
    sliced = blocks.withColumn("_slice", bucket(F.col("lo"), SLICE_BITS[-1])).withColumn(
        "_mean", F.col("total") / F.col("count"))
    limits = materialize(_slice_limits(sliced))
    placed = join_parameters(sliced, limits, [KEY, "_slice"], table_bytes(limits))
    settled = (
        (F.col("_before").isNull() | (F.col("_before") < F.col("_mean")))
        & (F.col("_after").isNull() | (F.col("_mean") < F.col("_after")))
    )
    loose = _pooled(placed.where(~settled), [KEY, "_stretch"])
    return placed.where(settled).select(*columns).unionByName(loose.select(*columns))


def isotonic_knots(df: DataFrame, y: str, score: Column, by: Sequence[str]) -> DataFrame:
    """``by, knot_x, knot_y``: both ends of every block, one row each."""
    ends = F.array_distinct(F.array("lo", "hi"))
    level = F.col("total") / F.col("count")
    return isotonic_blocks(df, y, score, by).select(
        *group_columns(by), F.explode(ends).alias("knot_x"), level.alias("knot_y")
    )
