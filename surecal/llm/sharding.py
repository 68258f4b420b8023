"""Sharding by histogram sort: equal bytes per shard, one exchange of the documents.

Documents are ordered by (hash of the text, doc_id), so equal texts are neighbours. Splitters
of that order are found by probing: count exactly the bytes below each candidate key, keep
the bracket around each target, probe inside it again, until every splitter is within its
tolerance. Only then are documents exchanged, each once, straight to its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty, written

_LOW = -(2**63)
_ADDED = {"_part": T.IntegerType(), "_first": T.LongType()}


@dataclass(frozen=True)
class Settings:
    """``tolerance``: of a shard's bytes, at its borders. A shard is sorted in ``part_bytes`` parts.

    ``group_share``: a group of equal texts of up to this share of a shard's bytes is never cut;
    a border inside it moves to its nearer end, by half of the share at most.
    """

    tolerance: float = 0.005
    group_share: float = 0.1
    part_tolerance: float = 0.1
    part_bytes: int = 32 << 20
    probes: int = 48
    most_rounds: int = 40


def _number(k1: int, k2: int) -> int:
    return ((k1 - _LOW) << 64) | (k2 - _LOW)


def _packed(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Both keys as 16 bytes that sort like (k1, k2)."""
    both = np.stack([k1, k2], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def _packed_numbers(numbers: list[int]) -> np.ndarray:
    return np.array([n.to_bytes(16, "big") for n in numbers], dtype="S16")


def _counted(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int]]:
    """Exact (bytes, rows, least key, greatest key) between neighbouring probes, empty ones too."""
    edges = keys.sparkSession.sparkContext.broadcast(_packed_numbers(probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(size):
                continue
            packed = _packed(k1, k2)
            order = np.argsort(packed, kind="stable")
            slot = np.searchsorted(edges.value, packed[order], side="right")
            starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            ends = np.r_[starts[1:], len(slot)] - 1
            lo, hi = order[starts], order[ends]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot[starts].astype(np.int32)), pa.array(np.add.reduceat(size[order], starts)),
                 pa.array((ends - starts + 1).astype(np.int64)), pa.array(k1[lo]), pa.array(k2[lo]),
                 pa.array(k1[hi]), pa.array(k2[hi])],
                names=["slot", "bytes", "rows", "a1", "a2", "b1", "b2"],
            )

    parts = keys.mapInArrow(run, "slot int, bytes bigint, rows bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    # One row per interval between probes.
    rows = parts.groupBy("slot").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
        F.min(F.struct("a1", "a2")).alias("a"), F.max(F.struct("b1", "b2")).alias("b"),
    ).collect()
    out = [(0, 0, 0, 0)] * (len(probes) + 1)
    for r in rows:
        out[r.slot] = (r.bytes, r.rows, _number(r.a.a1, r.a.a2), _number(r.b.b1, r.b.b2))
    return out


def _spread(lo: int, hi: int, n: int) -> list[int]:
    """Up to n keys in (lo, hi], evenly spaced; a key counts what lies below it."""
    return sorted({lo + max(1, (hi - lo) * (i + 1) // (n + 1)) for i in range(n)} | {hi}) if hi > lo else []


def find_splitters(
    keys: DataFrame, pieces: int, per_shard: int, settings: Settings = Settings()
) -> tuple[list[int], list[tuple[int, int]]]:
    """Splitters of (k1, k2, size) rows into ``pieces``, and exact (bytes, rows) below each.

    Every ``per_shard``-th splitter borders a shard and has the tighter tolerance. A splitter
    stops early where the bracket holds one key only: rows of equal keys stay together.
    """
    whole, rows, lo, hi = _counted(keys, [])[0]
    if not rows:
        return [0] * (pieces - 1), [(0, 0)] * (pieces - 1)
    size = whole / pieces
    allowed = [
        size * (per_shard * settings.tolerance if (j + 1) % per_shard == 0 else settings.part_tolerance)
        for j in range(pieces - 1)
    ]
    # Per open splitter: least and greatest key of its bracket, and (bytes, rows) below it.
    brackets = {j: (lo, hi, 0, 0, whole, rows) for j in range(pieces - 1)}
    done: dict[int, tuple[int, int, int]] = {}
    for round_ in range(settings.most_rounds):
        probes = sorted({p for b in brackets.values() for p in _spread(b[0], b[1], settings.probes)})
        counts = _counted(keys, probes) if probes else []
        below, below_rows = np.cumsum([0] + [c[0] for c in counts]), np.cumsum([0] + [c[1] for c in counts])
        for j, (lo, hi, low, low_rows, high, high_rows) in list(brackets.items()):
            target = size * (j + 1)
            # below[i] lies below probes[i - 1]; below[0] is 0.
            i = int(np.searchsorted(below, target, side="right")) - 1
            i = min(i, len(probes))
            near = [(abs(int(below[k]) - target), k) for k in (i, i + 1) if 1 <= k <= len(probes)]
            gap, k = min(near, default=(np.inf, 0))
            stuck = not probes or counts[i][2] == counts[i][3]
            if gap <= allowed[j] or stuck or round_ == settings.most_rounds - 1:
                options = [(gap, probes[k - 1], int(below[k]), int(below_rows[k]))] if k else []
                options += [(abs(low - target), lo, low, low_rows), (abs(high - target), hi + 1, high, high_rows)]
                _, key, b, r = min(options)
                done[j] = (key, b, r)
                del brackets[j]
            else:
                brackets[j] = (
                    counts[i][2], counts[i][3], int(below[i]), int(below_rows[i]),
                    int(below[i] + counts[i][0]), int(below_rows[i] + counts[i][1]),
                )
        if not brackets:
            break
    _spare_groups(keys, done, size, per_shard, settings)
    order = sorted(done[j] for j in range(pieces - 1))
    return [k for k, _, _ in order], [(b, r) for _, b, r in order]


def _spare_groups(keys: DataFrame, done: dict, size: float, per_shard: int, settings: Settings) -> None:
    """Move the borders of shards out of groups of equal texts that are not too large.

    The bytes below both ends of the group of each border are counted exactly, in one scan.
    Splitters within a shard follow where its border passes them.
    """
    borders = [j for j in sorted(done) if (j + 1) % per_shard == 0]
    ends = {j: ((done[j][0] >> 64) << 64, min(((done[j][0] >> 64) + 1) << 64, 2**128 - 1)) for j in borders}
    probes = sorted({k for pair in ends.values() for k in pair})
    if not probes:
        return
    counts = _counted(keys, probes)
    below, rows = np.cumsum([c[0] for c in counts]), np.cumsum([c[1] for c in counts])
    at = {k: (k, int(below[i]), int(rows[i])) for i, k in enumerate(probes)}
    for j in borders:
        first, last = at[ends[j][0]], at[ends[j][1]]
        inside = first[1] < done[j][1] < last[1]
        if inside and last[1] - first[1] <= settings.group_share * size * per_shard:
            done[j] = min(first, last, key=lambda end: abs(end[1] - size * (j + 1)))
    for j in done:
        earlier = [done[b] for b in borders if b < j][-1:]
        later = [done[b] for b in borders if b > j][:1]
        if j not in ends:
            done[j] = min([max([done[j], *earlier]), *later])


def shard_documents(docs: DataFrame, shards: int = 16, settings: Settings = Settings()) -> DataFrame:
    """``docs`` (all columns) with size, shard and slot; every shard's bytes are near equal.

    ``size`` is the UTF-8 bytes of the text plus one, also for null texts. ``slot`` counts
    from 0 within a shard. Equal texts share a shard where they are up to ``group_share`` of
    its bytes, so shards differ by about as much at most where such groups are many; larger
    groups are spread. Rows equal in text and id always share one. An empty table gives no rows.
    """
    size = (F.octet_length(text_or_empty()) + 1).cast("bigint")
    keyed = docs.drop("size", "shard", "slot").withColumns({
        "size": size, "_k1": F.xxhash64("text"),
        "_k2": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOW)),
    })
    keys = written(keyed.select("_k1", "_k2", "size"), "shard-keys")
    whole = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-whole // (shards * settings.part_bytes)))
    pieces = shards * per_shard
    splitters, below = find_splitters(keys, pieces, per_shard, settings)
    starts = np.array([0] + [r for _, r in below], dtype=np.int64)
    first = starts - starts[(np.arange(pieces) // per_shard) * per_shard]
    shared = docs.sparkSession.sparkContext.broadcast((_packed_numbers(splitters), first))
    names = [f.name for f in keyed.schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, offsets = shared.value
        at = [names.index("_k1"), names.index("_k2")]
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in at)
            part = np.searchsorted(edges, _packed(k1, k2), side="right") if len(k1) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(part.astype(np.int32)), pa.array(offsets[part])],
                names=[*names, *_ADDED],
            )

    schema = T.StructType([*keyed.schema.fields, *[T.StructField(n, t) for n, t in _ADDED.items()]])
    placed = keyed.mapInArrow(place, schema).repartitionById(pieces, F.col("_part")).sortWithinPartitions("_k1", "_k2")
    # The low 33 bits of this id count the rows of a partition, which here is one part.
    in_part = F.monotonically_increasing_id().bitwiseAND(2**33 - 1)
    return placed.withColumns({
        "shard": F.floor(F.col("_part") / per_shard).cast("int"), "slot": F.col("_first") + in_part,
    }).drop("_k1", "_k2", *_ADDED)
