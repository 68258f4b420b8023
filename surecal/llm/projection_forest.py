"""Near copies among vectors: a forest of random-projection trees, then exact cosines.

Each tree splits a node's unit vectors at the middle of their projections on a random direction;
a margin around the middle, as wide as pairs at the threshold lie apart, goes to both sides
(spill). Where most vectors lie in the margin, as in a group of near ones, a direction does not
split. Vectors that share a leaf of any tree are compared exactly. A tree's top levels are fitted
on a bounded sample of all vectors, and every leaf that is still too large is split again in the
same way on a sample of its own, until no direction tried there splits it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, labelled_nodes, written

THRESHOLD = 0.95
_TILE = 512


@dataclass(frozen=True)
class Settings:
    """Every level sends a share of a node's vectors both ways, so leaf rows grow with the number
    of levels; the margin is kept narrow and recall comes from the number of trees.

    ``spill``: least share of a node's vectors on each side of its middle that go both ways.

    ``reach``: width of the margin, in typical projected distances of a pair at the threshold.
    ``both``: a direction that would send a larger share of a node both ways does not split it.
    ``sample``: vectors a (sub)tree is fitted on; it bounds what one task fits, all vectors
    are placed. A leaf above ``leaf`` that does not split, or is left after ``rounds``, is
    compared in pairs of blocks.
    """

    trees: int = 8
    spill: float = 0.02
    reach: float = 0.5
    both: float = 0.15
    leaf: int = 512
    sample: int = 8_192
    levels: int = 8
    rounds: int = 8
    seed: int = 11


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector): non-zero vectors of finite components, of any length, as doubles."""
    return vectors.select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    ).where("vector IS NOT NULL").where(
        F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
        & F.exists("vector", lambda x: x != 0.0)
    )


@lru_cache(maxsize=4_096)
def _direction(tree: int, level: int, dim: int, seed: int) -> np.ndarray:
    direction = np.random.default_rng([seed, tree, level]).normal(size=dim)
    return direction / np.sqrt(direction @ direction)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _fit(
    x: np.ndarray, n: int, tree: int, level: int, levels: int, threshold: float, settings: Settings
) -> list[float]:
    """Low and high bound of every node, level by level: [lo, hi] of node 1, then 2, 3, ...

    ``x``: a sample of ``n`` unit vectors. Infinite bounds send all to the left: no split.
    """
    bounds = np.full((1 << levels, 2), np.inf)
    # A pair at the threshold is so far apart, on a random direction by a share 1 / sqrt(dim) of it.
    margin = settings.reach * np.sqrt(max(0.0, 2 - 2 * threshold) / x.shape[1]) / 2
    members = {1: np.arange(len(x))}
    for depth in range(levels):
        direction = _direction(tree, level + depth, x.shape[1], settings.seed)
        for node in range(1 << depth, 2 << depth):
            at = members.pop(node, None)
            if at is None or len(at) * n <= settings.leaf * len(x):
                continue
            p = x[at] @ direction
            lo, middle, hi = np.quantile(p, [0.5 - settings.spill, 0.5, 0.5 + settings.spill])
            lo, hi = min(lo, middle - margin), max(hi, middle + margin)
            if np.mean((p > lo) & (p <= hi)) > settings.both:
                members[2 * node] = at
                continue
            bounds[node] = lo, hi
            members[2 * node], members[2 * node + 1] = at[p <= hi], at[p > lo]
    return bounds.ravel().tolist()


def _descend(x: np.ndarray, tree: int, level: int, levels: int, bounds: np.ndarray, seed: int):
    """(row, node) of every leaf of a fitted (sub)tree each vector falls in."""
    row, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
    for depth in range(levels):
        p = (x @ _direction(tree, level + depth, x.shape[1], seed))[row]
        left, right = p <= bounds[node, 1], p > bounds[node, 0]
        row = np.concatenate([row[left], row[right]])
        node = np.concatenate([2 * node[left], 2 * node[right] + 1])
    return row, node


def _fitted(
    placed: DataFrame, nodes: DataFrame, large: DataFrame, level: int, threshold: float, settings: Settings
) -> DataFrame:
    """(tree, leaf, levels, bounds) of the leaves in ``large`` (tree, leaf, n) that split."""
    share = F.col("n") / settings.sample
    drawn = placed.join(large, ["tree", "leaf"]).where(
        F.pmod(F.xxhash64("node", "leaf"), F.lit(1 << 30)) * share < float(1 << 30)
    ).join(nodes.select("node", "vector"), "node")

    def fit(key, group: pd.DataFrame) -> pd.DataFrame:
        tree, leaf = int(key[0]), key[1]
        n = int(group["n"].iloc[0])
        # A level leaves up to (1 + both) / 2 of a node's vectors in a child; small nodes end early.
        levels = np.ceil(np.log(n / settings.leaf) / -np.log((1 + settings.both) / 2))
        levels = int(np.clip(levels, 1, settings.levels))
        bounds = _fit(_unit(np.stack(group["vector"].to_numpy())), n, tree, level, levels, threshold, settings)
        return pd.DataFrame(
            {"tree": [tree], "leaf": [leaf], "levels": [levels], "bounds": [bounds]}
        )[: int(np.isfinite(bounds).any())]

    return written(
        drawn.groupBy("tree", "leaf").applyInPandas(fit, "tree int, leaf bigint, levels int, bounds array<double>"),
        "forest",
    )


def _split(placed: DataFrame, nodes: DataFrame, fitted: DataFrame, level: int, settings: Settings) -> DataFrame:
    """The rows of the leaves in ``fitted``, placed in leaves below them."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, tree, leaf, levels = (batch.column(c).to_numpy() for c in ("node", "tree", "leaf", "levels"))
            vectors = batch.column("vector")
            flat, offsets = vectors.values.to_numpy(), vectors.offsets.to_numpy()
            order = np.lexsort((leaf, tree))
            starts = np.flatnonzero(np.r_[True, np.diff(leaf[order]) != 0])
            rows, leaves = [], []
            for at in np.split(order, starts[1:]):
                t, parent = int(tree[at[0]]), int(leaf[at[0]])
                bounds = batch.column("bounds")[int(at[0])].values.to_numpy().reshape(-1, 2)
                # All vectors of a leaf have one length.
                dim = int(offsets[at[0] + 1] - offsets[at[0]])
                x = flat[offsets[at][:, None] + np.arange(dim)]
                row, below = _descend(_unit(x), t, level, int(levels[at[0]]), bounds, settings.seed)
                # A leaf's number: a hash of its parent's and its place below it.
                mixed = np.uint64(parent * 0xD1342543DE82EF95 % 2**64) + below.astype(np.uint64)
                mixed *= np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                rows.append(at[row])
                leaves.append((mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
            row = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[row]), pa.array(tree[row]), pa.array(np.concatenate(leaves))],
                names=["node", "tree", "leaf"],
            )

    # A leaf that splits is shuffled with its vectors; what comes out is without them.
    inside = placed.join(fitted.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    return inside.join(nodes.select("node", "vector"), "node").join(fitted, ["tree", "leaf"]).select(
        "node", "vector", "tree", "leaf", "levels", "bounds"
    ).mapInArrow(descend, "node bigint, tree int, leaf bigint")


def plant(nodes: DataFrame, threshold: float = THRESHOLD, settings: Settings = Settings()) -> DataFrame:
    """(node, tree, leaf): every leaf of every tree each node falls in.

    Each length of vectors has a forest of its own: their trees start in leaves of their own.
    """
    whole = nodes.select(
        "node", F.size("vector").cast("bigint").alias("dim"),
        F.explode(F.sequence(F.lit(0), F.lit(settings.trees - 1))).alias("tree"),
    ).select("node", "tree", (F.col("dim") * settings.trees + F.col("tree")).alias("leaf"))
    done, open_, level = None, whole, 0
    for _ in range(settings.rounds):
        sizes = open_.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
        large = written(sizes.where(F.col("n") > settings.leaf), "large-leaves")
        fitted = _fitted(open_, nodes, large, level, threshold, settings)
        rest = open_.join(fitted, ["tree", "leaf"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if not fitted.head(1):
            return done
        open_ = written(_split(open_, nodes, fitted, level, settings), "leaves")
        level += settings.levels
    return done.unionByName(open_)


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row each row reaches, when links (a, b) join ``root``."""
    while True:
        apart = root[a] != root[b]
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]


class _Codes:
    """The leaves below ``leaf`` that each row of a task is in as well."""

    def __init__(self, codes: list, leaf: int):
        width = max(map(len, codes))
        self.all = np.full((len(codes), width), np.iinfo(np.int64).max)
        for r, c in enumerate(codes):
            self.all[r, : len(c)] = c
        below = self.all < leaf
        found, number, n = np.unique(self.all[below], return_inverse=True, return_counts=True)
        # Leaves of a single row here are shared with none; the others have numbers from 0.
        kept = np.where(n > 1, np.cumsum(n > 1) - 1, -1)
        self.numbers = np.full(self.all.shape, -1)
        self.numbers[below] = kept[number]
        self.count = int((n > 1).sum())

    def shared(self, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> np.ndarray:
        """Where linked rows and columns have such a leaf in common; by pair if links are few."""
        out = np.zeros_like(linked)
        width = self.all.shape[1]
        pairs = np.count_nonzero(linked)
        if not pairs or not self.count:
            return out
        if pairs * width * width < linked.size * self.count // 16:
            a, b = np.nonzero(linked)
            step = max(1, 4_000_000 // (width * width))
            for lo in range(0, pairs, step):
                c, d = a[lo : lo + step], b[lo : lo + step]
                p, q = self.numbers[rows[c]], self.numbers[columns[d]]
                out[c, d] = ((p[:, :, None] == q[:, None, :]) & (p >= 0)[:, :, None]).any(axis=(1, 2))
            return out
        for lo in range(0, self.count, 512):
            sides = []
            for chosen in (rows, columns):
                number = self.numbers[chosen] - lo
                at, place = np.nonzero((number >= 0) & (number < 512))
                side = np.zeros((len(chosen), min(512, self.count - lo)), dtype=np.float32)
                side[at, number[at, place]] = 1
                sides.append(side)
            out |= sides[0] @ sides[1].T > 0
        return out


def _links(group: pd.DataFrame, leaf: int, i: int, j: int, threshold: float) -> pd.DataFrame:
    """Per node with a link in blocks i and j: copies newly linked with, smallest row reached.

    Pairs are compared tile by tile and do not leave the task.
    """
    x = _unit(np.stack(group["vector"].to_numpy()))
    codes = _Codes(list(group["codes"]), leaf)
    nodes, copies = group["node"].to_numpy(), group["copies"].to_numpy().astype(np.float64)
    block = group["block"].to_numpy()
    left, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
    found, touched, root = np.zeros(len(x)), np.zeros(len(x), dtype=bool), np.arange(len(x))
    for lo in range(0, len(left), _TILE):
        rows = left[lo : lo + _TILE]
        linked = x[rows] @ x[columns].T >= threshold
        if i == j:
            linked &= rows[:, None] != columns[None, :]
        if not linked.any():
            continue
        apart = linked & (root[rows][:, None] != root[columns][None, :])
        a, b = np.nonzero(apart)
        root = _merged(root, rows[a], columns[b])
        touched[rows] |= linked.any(axis=1)
        new = (linked & ~codes.shared(rows, columns, linked)).astype(np.float64)
        found[rows] += new @ copies[columns]
        if i != j:
            touched[columns] |= linked.any(axis=0)
            found[columns] += copies[rows] @ new
    return pd.DataFrame(
        {"node": nodes[touched], "links": found[touched].astype(np.int64), "root": nodes[root[touched]]}
    )


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, settings: Settings = Settings()
) -> DataFrame:
    """Links and components of vectors with cosine >= threshold, in double precision.

    Takes ``vec_id`` and ``embedding``. One row per distinct (vec_id, embedding), also for
    null ids: vec_id, n_links (other such rows linked directly), component_id (smallest
    vec_id of the component), kept (vec_id = component_id). Vectors ``usable`` leaves out
    link with nothing. Equal vectors are one node and links of each other. A link in many
    leaves counts in the smallest one.
    """
    rows = vectors.groupBy("vec_id", "embedding").agg(F.count("*").alias("_n")).drop("_n")
    keyed = usable(rows).withColumn("node", F.xxhash64("vector"))
    # Two vectors of one number would be taken for copies: a second hash tells.
    second = F.xxhash64(F.lit("second"), "vector")
    copies = F.when(F.min(second) == F.max(second), F.count("*")).otherwise(
        F.raise_error(F.lit("two vectors share a hash")).cast("bigint"))
    nodes = written(
        keyed.groupBy("node").agg(copies.alias("copies"), F.first("vector").alias("vector")), "vectors"
    )
    placed = written(plant(nodes, threshold, settings), "placed")
    codes = placed.groupBy("node").agg(F.collect_set("leaf").alias("codes"))
    # A leaf of a single node has no pairs.
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / (4 * settings.leaf)).cast("int")
    work = block_pairs(
        placed.drop("tree").join(sizes, "leaf").withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node", "leaf"), F.col("blocks")).cast("int")).drop("n")
    ).join(nodes.join(codes, "node"), "node")

    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        return _links(group, int(key[0]), int(key[1]), int(key[2]), threshold)

    found = written(
        work.groupBy("leaf", "i", "j").applyInPandas(compare, "node bigint, links bigint, root bigint"), "links"
    )
    labelled = labelled_nodes(nodes, found)
    out = rows.join(
        keyed.select("vec_id", "node", "vector").join(labelled, "node")
        .select(F.col("vec_id").alias("_id"), F.xxhash64("vector").alias("_node"), "links", "copies", "component"),
        F.col("vec_id").eqNullSafe(F.col("_id"))
        & (F.xxhash64(F.transform("embedding", lambda x: x.cast("double"))) == F.col("_node")),
        "left",
    )
    least = out.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    return out.join(least, "component", "left").select(
        "vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("least", "vec_id").cast("bigint").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
