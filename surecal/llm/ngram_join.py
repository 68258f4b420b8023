"""N-gram Jaccard self-join: MinHash banding, then exact verification of candidates.

Texts are compared as sets of word n-grams (lower case, cut at white space). A text of
1 to n-1 words has one n-gram, the whole of it; a null or blank text has none and links
with nothing. Equal texts are one node of the search and count as links of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, labelled_nodes, link_summary, text_runs, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
HASHES = 128
# Members of a bucket are compared in blocks of about so many, and of so many bytes of text; a
# task holds two blocks. A longer text is not cut.
BLOCK = 256
BLOCK_BYTES = 8_000_000
_KNOWN_WORDS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have while a pair at the threshold is still found.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands.
    """
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1.0 - (1.0 - threshold**rows) ** bands >= recall:
            return bands, rows
    raise ValueError(f"{hashes} hashes cannot reach a recall of {recall} at {threshold}")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _KNOWN_WORDS:
            self[word] = value
        return value


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def _shingle_hashes(texts: list[str | None], words: int, known: _WordHashes):
    """Hashes of all n-grams of all texts, end to end, and how many each text has."""
    tokens = [(t or "").lower().split() for t in texts]
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = np.fromiter((known[w] for t in tokens for w in t), dtype=np.uint64, count=lengths.sum())
    counts = np.where(lengths >= words, lengths - words + 1, (lengths > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    h = np.zeros(len(flat) + words, dtype=np.uint64)
    padded = np.concatenate([flat, np.zeros(words, dtype=np.uint64)])
    for i in range(words):
        h = _scrambled(h * _MIX + np.concatenate([padded[i:], padded[:i]]))
    keep = np.zeros(len(flat), dtype=bool)
    ends = starts[1:]
    position = np.arange(len(flat), dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    keep = position + words <= ends[doc]
    hashes = h[: len(flat)]
    short = np.flatnonzero((lengths > 0) & (lengths < words))
    for d in short:
        hashes[starts[d]] = xxhash.xxh3_64_intdigest(" ".join(tokens[d]))
        keep[starts[d]] = True
    return hashes[keep], counts


def _signatures(hashes: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of the texts that have n-grams."""
    rng = np.random.default_rng(20_240_229)
    odd = rng.integers(1, 2**63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, size=bands * rows, dtype=np.uint64)
    some = counts[counts > 0]
    first = np.concatenate([[0], np.cumsum(some)[:-1]])
    out = np.zeros((len(some), bands), dtype=np.uint64)
    for band in range(bands):
        for row in range(rows):
            k = band * rows + row
            mixed = hashes * odd[k] + add[k]
            mixed ^= mixed >> np.uint64(32)
            least = np.minimum.reduceat(mixed, first)
            out[:, band] = _scrambled(out[:, band] * _MIX + least)
    return out.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, bytes, bands) of every row; bands are null for texts without n-grams."""
    schema = "doc_id bigint, digest string, bytes bigint, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for part in text_runs(batches, "text"):
            texts = part.column("text").to_pylist()
            hashes, counts = _shingle_hashes(texts, words, known)
            has = np.flatnonzero(counts > 0)
            values: list = [None] * len(texts)
            if len(has):
                for i, row in zip(has, _signatures(hashes, counts, bands, rows)):
                    values[i] = row
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "digest", "bytes")), pa.array(values, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "bytes", "bands"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"),
        F.octet_length(F.col("text").cast("string")).cast("bigint").alias("bytes"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, schema)


def _sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """N-grams of all texts as (text index, n-gram number), each once; and how many numbers."""
    hashes, counts = _shingle_hashes(texts, words, _WordHashes())
    kinds, numbers = np.unique(hashes, return_inverse=True)
    n = max(1, len(kinds))
    pairs = np.unique(np.repeat(np.arange(len(texts)), counts) * n + numbers)
    return pairs // n, pairs % n, n


def _shared(rows: np.ndarray, cols: np.ndarray, n: int, kinds: int) -> np.ndarray:
    """How many n-grams each two of ``n`` texts share, in slices of the n-gram numbers."""
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    # An n-gram of a single text adds nothing to another pair.
    often = np.bincount(cols, minlength=kinds)[cols] > 1
    rows, cols = rows[often], np.unique(cols[often], return_inverse=True)[1]
    out = np.zeros((n, n), dtype=np.float32)
    width = 4096
    edges = np.searchsorted(cols, np.arange(0, (cols[-1] + 1 if len(cols) else 0) + width, width))
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            part = np.zeros((n, width), dtype=np.float32)
            part[rows[lo:hi], cols[lo:hi] % width] = 1.0
            out += part @ part.T
    return out


def _verified(
    group: pd.DataFrame, band: int, words: int, threshold: float, both: bool
) -> pd.DataFrame:
    """Links within one pair of blocks (or one block); those no earlier band holds are new."""
    texts, side = group["text"].tolist(), group["side"].to_numpy()
    n = len(texts)
    rows, cols, kinds = _sets(texts, words)
    shared = _shared(rows, cols, n, kinds)
    size = np.bincount(rows, minlength=n).astype(np.float64)
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if both:
        linked &= side[:, None] != side[None, :]
    all_bands = np.stack(group["bands"].to_numpy())
    a, b = np.nonzero(linked)
    new = np.ones(len(a), dtype=bool)
    for lo in range(0, len(a), 65_536):
        x, y = a[lo : lo + 65_536], b[lo : lo + 65_536]
        new[lo : lo + 65_536] = ~(all_bands[x, :band] == all_bands[y, :band]).any(axis=1)
    return link_summary(group["node"].to_numpy(), group["copies"].to_numpy(), a, b, new)


def ngram_join(
    docs: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    hashes: int = HASHES,
) -> DataFrame:
    """Links and classes of documents whose n-gram sets have a Jaccard similarity >= threshold.

    Takes ``doc_id`` and ``text``; other columns play no part. Returns one row per distinct
    (doc_id, text), also for null ids: doc_id, digest (MD5 of the text, null for null),
    n_links (other such rows linked directly), class_id (smallest doc_id of the class;
    null ids come last), kept (true for one row of each class).

    One scan computes the signatures. Bands are shuffled as narrow rows; the texts of nodes
    that share a bucket are fetched in one join. A bucket of any size is compared block by
    block, each pair of blocks in its own task, so a large group of near copies is neither
    gathered in one place nor expanded into pairs.
    """
    bands, rows = banding(threshold, recall, hashes)
    rows_in = written(signatures(docs, words, bands, rows), "signatures")
    members = rows_in.groupBy("doc_id", "digest").agg(
        F.first("bands", True).alias("bands"), F.max("bytes").alias("bytes")
    )
    nodes = members.where("bands IS NOT NULL").groupBy("digest").agg(
        F.xxhash64("digest").alias("node"), F.min("doc_id").alias("first_id"),
        F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("bytes").alias("bytes"),
    )
    nodes = written(nodes, "nodes")
    if nodes.groupBy("node").count().where("count > 1").head(1):
        raise RuntimeError("two texts have one 64-bit number")
    entries = nodes.select("node", "bytes", F.posexplode("bands").alias("band", "bucket"))
    buckets = (
        entries.groupBy("band", "bucket")
        .agg(
            F.count("*").alias("n"), F.sum("bytes").alias("size"), F.min("node").alias("least"),
            F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s1"),
            F.sum(F.hash("node").cast("bigint")).alias("s2"),
        )
        .where("n > 1")
    )
    # Buckets with the same members do the same work: the first band's stays.
    buckets = written(
        buckets.groupBy("n", "size", "least", "s1", "s2").agg(F.min(F.struct("band", "bucket")).alias("b"))
        .select("b.band", "b.bucket", "n", "size"),
        "buckets",
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int")
    placed = (
        entries.join(buckets, ["band", "bucket"])
        .select("node", "band", "bucket", blocks.alias("blocks"),
                F.pmod(F.xxhash64("node", "band"), blocks).cast("int").alias("block"))
    )
    tasks = block_pairs(placed)
    wanted = nodes.join(tasks.select("node").distinct(), "node")
    texts = (
        docs.select(
            F.col("doc_id").alias("first_id"), F.md5(F.col("text").cast("binary")).alias("_digest"),
            F.col("text").cast("string").alias("text"),
        )
        .alias("d")
        .join(
            wanted.alias("w"),
            F.col("d.first_id").eqNullSafe(F.col("w.first_id")) & (F.col("_digest") == F.col("digest")),
        )
        .groupBy("node", "copies", "bands").agg(F.first("text").alias("text"))
    )
    texts = written(texts, "candidates")
    work = tasks.join(texts, "node")

    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        band, _, i, j = key
        return _verified(
            group.assign(side=group["block"] == j), int(band), words, threshold, both=i != j
        )

    found = written(
        work.groupBy("band", "bucket", "i", "j").applyInPandas(
            compare, "node bigint, links bigint, root bigint"
        ),
        "links",
    )
    labelled = nodes.select("digest", "node").join(labelled_nodes(nodes, found), "node").drop("node")
    # Classes by component, then a number for each: the smallest id in it.
    rows_out = members.select("doc_id", "digest").join(labelled, "digest", "left")
    single = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    least = (
        rows_out.where("component IS NOT NULL").groupBy("component").agg(F.min(single).alias("least"))
    )
    out = rows_out.join(least, "component", "left")
    return out.select(
        "doc_id", "digest",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.coalesce(single == F.col("least"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``ngram_join`` keeps; rows repeated with id and text stay once."""
    keyed = docs.withColumn("_digest", F.md5(F.col("text").cast("binary"))).dropDuplicates(
        ["doc_id", "_digest"]
    )
    kept = result.where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept"))
    return keyed.join(
        kept,
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_digest").eqNullSafe(F.col("_kept")),
        "left_semi",
    ).drop("_digest")
