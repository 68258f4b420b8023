"""Toxicity of texts: subword-bag embeddings, averaged, into a linear softmax.

A word is the bag of its character n-grams (with its boundaries marked) and itself, each
hashed to a row of an embedding table. A text is the mean over its words of the mean over
each word's rows. The table and the softmax are trained jointly. Misspellings and unseen
inflections share most n-grams with words that were seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, text_runs

_WORD = re.compile(r"[^\W_]+")
_KNOWN_WORDS = 300_000
THRESHOLD = 0.7


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that training reads, and so the driver's work.

    They are the rows with the smallest hash of their id, half of each label where there
    are enough. Everything else sees all rows.
    """

    sample_rows: int = 6_000
    buckets: int = 1 << 16
    shortest: int = 3
    longest: int = 5
    dim: int = 4
    epochs: int = 10
    batch: int = 32
    rate: float = 1.5
    floor: float = 1e-8
    clean_weight: float = 3.0
    seed: int = 7


def subwords(word: str, settings: Settings) -> list[int]:
    """Rows of the embedding table for one word."""
    marked = f"<{word}>"
    grams = {marked}
    for n in range(settings.shortest, settings.longest + 1):
        grams.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return [xxhash.xxh3_64_intdigest(g) % settings.buckets for g in sorted(grams)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Words(dict):
    """Number of each word and, by number, its subword rows."""

    def __init__(self, settings: Settings):
        self.settings, self.rows = settings, []

    def __missing__(self, word: str) -> int:
        self.rows.append(np.array(subwords(word, self.settings), dtype=np.int64))
        self[word] = len(self.rows) - 1
        return self[word]


@dataclass(frozen=True)
class Model:
    """``vectors`` (buckets x 2): what a subword row adds to the two logits; ``bias`` (2)."""

    vectors: np.ndarray
    bias: np.ndarray
    settings: Settings



def train(texts: list[str | None], labels: list[int], settings: Settings = Settings()) -> Model:
    """Minibatch Adagrad on the cross-entropy; clean rows together weigh ``clean_weight`` times the toxic.

    Without rows of both labels the model is the share of toxic rows among them (one half
    without any rows), the same for every text.
    """
    rng = np.random.default_rng(settings.seed)
    y = np.array(labels, dtype=np.int64)
    share = np.bincount(y, minlength=2) if len(y) else np.zeros(2, dtype=np.int64)
    if not share.all():
        bias = np.log((share + 1.0) / (share.sum() + 2.0)) if len(y) else np.zeros(2)
        return Model(np.zeros((settings.buckets, 2), np.float32), bias, settings)
    known = _Words(settings)
    bags = []
    for text in texts:
        numbers = np.array([known[w] for w in words_of(text)], dtype=np.int64)
        bags.append(np.unique(numbers, return_counts=True))
    rows = known.rows
    counts_of = np.array([len(r) for r in rows], dtype=np.int64)
    table = rng.normal(0.0, 0.1, (settings.buckets, settings.dim))
    heads = rng.normal(0.0, 0.5, (settings.dim, 2))
    bias = np.zeros(2)
    seen_table, seen_heads, seen_bias = np.full(settings.buckets, settings.floor), 1e-8, 1e-8
    weight = np.array([settings.clean_weight, 1.0]) * len(y) / share
    weight /= weight[y].mean()
    for epoch in range(settings.epochs):
        rate = settings.rate * (1.0 - epoch / settings.epochs)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), settings.batch):
            docs = order[lo : lo + settings.batch]
            sizes = np.array([len(bags[d][0]) for d in docs])
            numbers = np.concatenate([bags[d][0] for d in docs])
            if not len(numbers):
                continue
            share_of = np.concatenate([bags[d][1] / max(1, bags[d][1].sum()) for d in docs])
            doc = np.repeat(np.arange(len(docs)), sizes)
            # Each word of the batch once: mean of its rows, then mean over each text.
            words, at = np.unique(numbers, return_inverse=True)
            lengths = counts_of[words]
            used = np.concatenate([rows[w] for w in words])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            word_vectors = np.add.reduceat(table[used], starts, axis=0) / lengths[:, None]
            mix = np.zeros((len(docs), len(words)))
            np.add.at(mix, (doc, at), share_of)
            means = mix @ word_vectors
            logits = means @ heads + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1.0
            p *= weight[y[docs]][:, None] / len(docs)
            to_words = (mix.T @ (p @ heads.T)) / lengths[:, None]
            spread = np.repeat(to_words, lengths, axis=0)
            to_rows = np.stack(
                [np.bincount(used, spread[:, k], minlength=settings.buckets) for k in range(settings.dim)],
                axis=1,
            )
            to_heads, to_bias = means.T @ p, p.sum(axis=0)
            seen_table += (to_rows**2).mean(axis=1)
            seen_heads, seen_bias = seen_heads + (to_heads**2).mean(), seen_bias + (to_bias**2).mean()
            table -= rate * to_rows / np.sqrt(seen_table)[:, None]
            heads -= rate * to_heads / np.sqrt(seen_heads)
            bias -= rate * to_bias / np.sqrt(seen_bias)
    return Model((table @ heads).astype(np.float32), bias, settings)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A bounded sample of labelled texts, as (toxic, text)."""
    ids = (
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .where(remainder("doc_id", 3) != 1)
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    place = F.xxhash64("doc_id")
    half = settings.sample_rows // 2
    chosen = (
        ids.where("toxic = 0").orderBy(place, "doc_id").limit(half)
        .unionByName(ids.where("toxic = 1").orderBy(place, "doc_id").limit(half))
    )
    # At most sample_rows rows of two numbers.
    return (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        .orderBy("doc_id").select("toxic", "text")
    )


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from labels, never from rows whose crc32(doc_id as text) mod 3 is 1.

    Null labels and ids are left out; of repeated ids the larger label and the smaller text
    count.
    """
    rows = training_rows(docs, labels, settings).collect()
    return train([r.text for r in rows], [r.toxic for r in rows], settings)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (all columns) with toxic_score (0 to 1) and toxic_predicted (0 or 1).

    Null and blank texts get what the softmax says of no words at all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[str, float] = {}
        edge = float(model.bias[1] - model.bias[0])
        vectors = (model.vectors[:, 1] - model.vectors[:, 0]).astype(np.float64)
        for part in text_runs(batches, "text"):
            scores = []
            for text in part.column("text").to_pylist():
                words = words_of(text)
                total = 0.0
                for word in words:
                    value = known.get(word)
                    if value is None:
                        value = float(vectors[subwords(word, model.settings)].mean())
                        if len(known) < _KNOWN_WORDS:
                            known[word] = value
                    total += value
                z = edge + (total / len(words) if words else 0.0)
                scores.append(1.0 / (1.0 + np.exp(-min(max(z, -700.0), 700.0))))
            out = pa.array(scores, pa.float64())
            flags = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, out, flags], names=[*part.schema.names, "toxic_score", "toxic_predicted"]
            )

    plain = docs.withColumn("text", F.col("text").cast("string")).drop("toxic_score", "toxic_predicted")
    added = [T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())]
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *added]))
