"""Exact top-k by inner product over a bit-sliced index.

Components become integers floor(256 * x). A block of rows is stored as bitmaps, one per
component and bit. For a query, slices are added as bitmaps (shifted by the digits of each
weight, complemented for negative digits) into slices of the score. The k best rows are
selected from the most significant slice downward; rows tied at the boundary are settled by
their number, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Rows of a block, and components of a block or of a part of the queries, at most.
BLOCK_ROWS = 32_768
BLOCK_COMPONENTS = 4_194_304
# Queries of a part, at most, until there are MOST_PARTS parts; every part is sent every block.
BLOCK_QUERIES = 64
MOST_PARTS = 4
# Groups of blocks; every group is sent every part.
MOST_GROUPS = 64
MOST_TASKS = 20_000
# Score slices of so many queries are selected from at once.
QUERY_RUN = 16
_ONE = np.uint64(1)


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q, dim): distinct rows that take part, of any length."""
    v = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    ).distinct()
    return v.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256.0)).alias("q"),
        F.size("embedding").alias("dim"),
    )


def sliced(values: np.ndarray, low: int, bits: int) -> np.ndarray:
    """Bitmaps (components x bits x words) of rows x components integers >= low."""
    rows, dim = values.shape
    out = np.zeros((dim, bits, -(-rows // 64) * 8), dtype=np.uint8)
    for d in range(dim):
        shifted = values[:, d] - low
        for b in range(bits):
            packed = np.packbits(((shifted >> b) & 1).astype(np.uint8), bitorder="little")
            out[d, b, : len(packed)] = packed
    return out.view(np.uint64)


def digits(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plus and minus bits of each weight, w = plus - minus, with the fewest bits in all."""
    size = np.abs(weights).astype(np.uint64)
    triple = size * np.uint64(3)
    plus, minus = (((a & ~b) >> _ONE).astype(np.int64) for a, b in ((triple, size), (size, triple)))
    return np.where(weights < 0, minus, plus), np.where(weights < 0, plus, minus)


class Adder:
    """Slices of sum_d plus_d * x_d + minus_d * (complement of x_d) over one block of rows.

    A component is a number of ``bits`` slices, and each bit of its weight adds it (or its
    complement) once, shifted by that bit. Two numbers of the same shift are added to the sum
    in one pass: the sum's slices keep the parity, the carries are a number of the next shift.
    """

    def __init__(self, slices: np.ndarray, planes: int):
        _, self.bits, words = slices.shape
        self.numbers = slices, ~slices
        self.half = np.empty(slices.shape[1:], dtype=np.uint64)
        # Carries may run past the last slice of a sum, where they are all zero.
        self.sum = np.empty((planes + self.bits + 1, words), dtype=np.uint64)
        self.spare: list[np.ndarray] = []

    def __call__(self, plus: np.ndarray, minus: np.ndarray, out: np.ndarray) -> None:
        total, half = self.sum, self.half
        total[:] = 0
        carries: list[np.ndarray] = []
        for shift in range(len(out)):
            at = total[shift : shift + self.bits]
            added = [
                number[d] for number, weights in zip(self.numbers, (plus, minus))
                for d in np.flatnonzero((weights >> shift) & 1)
            ]
            following: list[np.ndarray] = []
            while added or carries:
                x, x_spare = (carries.pop(), True) if carries else (added.pop(), False)
                carry = self.spare.pop() if self.spare else np.empty_like(half)
                if added or carries:
                    y, y_spare = (carries.pop(), True) if carries else (added.pop(), False)
                    np.bitwise_xor(at, x, out=half)
                    np.bitwise_and(at, x, out=carry)
                    np.bitwise_xor(half, y, out=at)
                    np.bitwise_and(half, y, out=half)
                    np.bitwise_or(carry, half, out=carry)
                    if y_spare:
                        self.spare.append(y)
                else:
                    np.bitwise_and(at, x, out=carry)
                    np.bitwise_xor(at, x, out=at)
                following.append(carry)
                if x_spare:
                    self.spare.append(x)
            carries = following
        self.spare += carries
        out[:] = total[: len(out)]


def selected(total: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (queries x words): rows surely among the k best, and rows tied for the rest."""
    sure, open_ = np.zeros_like(valid), valid.copy()
    for plane in total[::-1]:
        ones = open_ & plane
        count = (np.bitwise_count(sure).sum(axis=1) + np.bitwise_count(ones).sum(axis=1))[:, None]
        sure = np.where(count <= k, sure | ones, sure)
        open_ = np.where(count > k, ones, np.where(count == k, np.uint64(0), open_ & ~plane))
    return sure, open_


def first_rows(bitmap: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` rows of a bitmap."""
    # So many words that are not empty hold as many rows at least.
    words = np.flatnonzero(bitmap)[:most]
    word, bit = np.nonzero(np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, 64))
    return (words[word] * 64 + bit)[:most]


def best_of_block(ids, slices, low, query_ids, weights, k) -> pd.DataFrame:
    """The k best rows of one block for each query; ``ids`` ascend, so ties go to smaller ones."""
    rows, (dim, bits, words) = len(ids), slices.shape
    # Digits add up to less than twice the weight.
    adder = Adder(slices, (2 * int(np.abs(weights).sum(axis=1).max()) * ((1 << bits) - 1)).bit_length())
    every = np.packbits(np.arange(words * 64) < rows, bitorder="little").view(np.uint64)
    first, after = (np.searchsorted(ids, query_ids, side=side) for side in ("left", "right"))
    found = []
    for start in range(0, len(weights), QUERY_RUN):
        run = range(start, min(start + QUERY_RUN, len(weights)))
        plus, minus = digits(weights[run.start : run.stop])
        planes = max(1, (int((plus + minus).sum(axis=1).max()) * ((1 << bits) - 1)).bit_length())
        total = np.empty((planes, len(run), words), dtype=np.uint64)
        valid = np.tile(every, (len(run), 1))
        for i, q in enumerate(run):
            adder(plus[i], minus[i], total[:, i])
            own = np.arange(first[q], after[q])
            np.bitwise_and.at(valid[i], own // 64, ~(_ONE << (own % 64).astype(np.uint64)))
        sure, tied = selected(total, valid, k)
        for i, q in enumerate(run):
            r = first_rows(sure[i], k)
            r = np.concatenate([r, first_rows(tied[i], k - len(r))])
            bit = (total[:, i, r // 64] >> (r % 64).astype(np.uint64)) & _ONE
            score = (bit << np.arange(planes, dtype=np.uint64)[:, None]).sum(axis=0, dtype=np.uint64)
            # Scores fit 64 bits, their parts may not: both are added modulo 2^64.
            shift = (int(weights[q].sum()) * low - int(minus[i].sum()) * ((1 << bits) - 1)) % 2**64
            found.append((np.full(len(r), query_ids[q]), ids[r], (score + np.uint64(shift)).view(np.int64)))
    q, r, score = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"query_id": q, "vec_id": r, "score": score})


def top_k(vectors: DataFrame, k: int = 5, queries=None) -> DataFrame:
    """Per query its k highest integer inner products: query_id, rank, vec_id, score.

    ``queries`` is a condition on vec_id (default: divisible by 50). A query meets every row
    of its own length but those of its own id; ties go to the smaller vec_id. Null ids, and
    vectors that are null, empty or hold null or non-finite components take no part; repeated
    rows count once. Scores are 64-bit: components that could exceed them are refused.
    Every block of rows meets every part of the queries of its length, each pair on its own.
    A task has a group of blocks and a part. Groups grow with the rows, and parts with the
    queries up to BLOCK_COMPONENTS, so what is sent grows with the input and not its square.
    """
    chosen = F.col("vec_id") % 50 == 0 if queries is None else queries
    rows = written(quantised(vectors), "quantised")
    # One row per length of vectors.
    n, asks, dim = F.count("*"), F.count(F.when(chosen, 1)), F.col("dim")
    block = F.greatest(F.lit(64), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_COMPONENTS) / dim)))
    lengths = written(
        rows.groupBy("dim").agg(n.alias("n"), asks.alias("asks")).where("asks > 0").select(
            "dim", F.ceil(F.col("n") / block).cast("int").alias("blocks"),
            F.greatest(
                F.least(F.lit(MOST_PARTS), F.ceil(F.col("asks") / BLOCK_QUERIES)),
                F.ceil(F.col("asks") * dim / BLOCK_COMPONENTS),
            ).cast("int").alias("parts"),
        ).withColumn("groups", F.least("blocks", F.lit(MOST_GROUPS))),
        "lengths",
    )
    units = int(lengths.agg(F.coalesce(F.sum(F.col("groups").cast("bigint") * F.col("parts")), F.lit(1))).first()[0])
    tasks = min(units, MOST_TASKS)

    def index(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        values = np.stack(group["q"].to_numpy())
        low, high = int(values.min()), int(values.max())
        bits = max(1, (high - low).bit_length())
        if bits > 62:
            raise ValueError("these components do not fit 64 bits")
        return row_of(group, "block", sliced(values, low, bits).astype("<u8"), low, bits)

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        weights = np.stack(group["q"].to_numpy())
        size = max(abs(int(weights.min())), abs(int(weights.max())))
        bits = next(b for b in (8, 16, 32, 64) if size < 1 << (b - 1) or b == 64)
        return row_of(group, "part", weights.astype(f"<i{bits // 8}"), 0, bits)

    def row_of(group, number, data, low, bits) -> pd.DataFrame:
        return pd.DataFrame({
            "dim": [group["dim"].iloc[0]], number: [group[number].iloc[0]],
            "ids": [group["vec_id"].to_numpy().astype("<i8").tobytes()], "data": [data.tobytes()],
            "low": [low], "bits": [bits],
        })

    payload = "ids binary, data binary, low bigint, bits int"
    placed = rows.join(lengths, "dim")
    sliced_rows = written(
        placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .groupBy("dim", "block").applyInPandas(index, f"dim int, block int, {payload}"),
        "bit-slices",
    )
    asked = written(
        placed.where(chosen)
        .withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int"))
        .groupBy("dim", "part").applyInPandas(ask, f"dim int, part int, {payload}"),
        "asked",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for row in range(batch.num_rows):
                asks, dim, group, part, ids, data, low, bits = (column[row].as_py() for column in batch.columns)
                ids = np.frombuffer(ids, dtype="<i8")
                if asks:
                    at, query_ids = (dim, group, part), ids
                    weights = np.frombuffer(data, dtype=f"<i{bits // 8}").reshape(-1, dim).astype(np.int64)
                    continue
                # No query may have been dealt to a part.
                if at != (dim, group, part):
                    continue
                most = max(abs(low), abs(low + (1 << bits)))
                if most * max(abs(int(weights.min())), abs(int(weights.max()))) * dim >= 2**62:
                    raise ValueError("inner products of these components do not fit 64 bits")
                slices = np.frombuffer(data, dtype="<u8").reshape(dim, bits, -1)
                yield pa.RecordBatch.from_pandas(
                    best_of_block(ids, slices, low, query_ids, weights, k), preserve_index=False
                )

    # The part comes first, then the blocks of the group. Short rows of much work are dealt by
    # number, or they would share a few tasks.
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = "dim", "group", "part", "ids", "data", "low", "bits"
    number = F.col("group").cast("bigint") * F.col("parts") + F.col("part") + F.pmod(F.xxhash64("dim"), F.lit(tasks))
    pairs = (
        sliced_rows.join(lengths, "dim")
        .withColumns({"group": F.col("block") % F.col("groups"), "part": others("parts")})
        .select(F.lit(False).alias("asks"), *columns, "parts")
        .unionByName(
            asked.join(lengths, "dim").withColumn("group", others("groups"))
            .select(F.lit(True).alias("asks"), *columns, "parts")
        )
        .repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int"))
        .sortWithinPartitions("dim", "group", "part", F.desc("asks"))
    )
    found = pairs.select("asks", *columns).mapInArrow(
        search, "query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
