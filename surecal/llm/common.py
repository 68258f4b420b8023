"""Helpers shared by the operators: tables, intermediate tables, text batches, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Texts are handed to array code in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 4_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df``, written once to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def discard(df: DataFrame) -> None:
    """Remove the table that :func:`written` made, once nothing reads it any more."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        delete(df.sparkSession, folder)


def shielded(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``keep`` renamed, and the columns under their own names.

    Whatever a caller's columns are called, they cannot meet those that an operator adds.
    """
    inner = [n if n in keep else f"c{i}" for i, n in enumerate(docs.columns)]
    return docs.toDF(*inner), [F.col(a).alias(b) for a, b in zip(inner, docs.columns)]


def text_or_empty(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case; most words have none and are only looked at."""
    return F.when(F.rlike(word, F.lit("[A-Z]")), F.translate(word, UPPER, LOWER)).otherwise(word)


def remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of an identifier written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def text_runs(
    batches: Iterator[pa.RecordBatch], column: str, run_bytes: int = RUN_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose ``column`` holds about ``run_bytes``."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start, total = 0, 0
        for i, size in enumerate(sizes):
            total += size or 0
            if total >= run_bytes:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, component).

    Alternates two star contractions. *Large*: every neighbour above a node is tied to
    the node's smallest neighbour. *Small*: so is every neighbour below it. Both keep
    connectivity and shrink paths by a constant factor, so a few rounds suffice; each is
    two aggregates with map-side combining and a join that adaptive execution can split.
    Edges are written after each round. Only a count and a checksum reach the driver.
    """
    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    current = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v").distinct(),
        "edges",
    )

    def mark(e: DataFrame):
        row = e.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        ).first()
        return tuple(row)

    before = mark(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # Here u > v holds for every edge.
        large = written(large, "edges-large")
        low = smallest(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = written(
            small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges"
        )
        after = mark(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Now every edge ties a node to the root of its star.
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def link_summary(nodes, copies, a, b, new):
    """What a task that verified links (a, b), both ways round, tells of them.

    Per node with a link: the copies it is newly linked with (links that ``new`` marks), and
    the smallest node its links here reach. Pairs themselves do not leave the task.
    """
    n = len(nodes)
    found = np.bincount(a[new], weights=copies[b[new]].astype(np.float64), minlength=n)
    root = np.arange(n)
    while True:
        lowest = root.copy()
        np.minimum.at(lowest, a, root[b])
        lowest = lowest[lowest]
        if (lowest == root).all():
            break
        root = lowest
    touched = np.bincount(a, minlength=n) > 0
    return pd.DataFrame(
        {"node": nodes[touched], "links": found[touched].astype(np.int64), "root": nodes[root[touched]]}
    )


def labelled_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` (node, copies) with links and component, from the summaries of all tasks."""
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return (
        nodes.select("node", "copies")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                F.coalesce("component", "node").alias("component"))
    )


def block_pairs(placed: DataFrame) -> DataFrame:
    """Rows with ``block`` of ``blocks``, once per pair (i, j) of blocks they take part in."""
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("other", others).withColumns(
        {"i": F.least("block", "other"), "j": F.greatest("block", "other")}
    ).drop("other", "blocks")
