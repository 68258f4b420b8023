"""Named queries of the operators, over whole tables and with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, filter_audit, mixing, phrase_index, pieces, secrets, sharding, spelling, token_files, toxicity
from .bit_sliced import top_k
from .common import remainder, table, text_or_empty
from .ngram_join import ngram_join
from .projection_forest import near_vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The model file of the piece vocabulary; SURECAL_PIECES names another one.
PIECES = os.environ.get("SURECAL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")

# Ranks of a byte-level vocabulary, its fixed word pattern, and an id it leaves free.
RANKS = os.environ.get("SURECAL_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_near_vectors(spark, sf):
    """Links and component of every vector."""
    return near_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query
def op2_secrets(spark, sf):
    """Secrets of every document: counts and a digest of the base rules, all spans."""
    found = secrets.find_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in kinds],
        F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.spans_text(F.col("secrets")).alias("spans"),
    )


@query
def op3_ngram_join(spark, sf):
    """Class and number of links of every document."""
    return ngram_join(table(spark, sf, "documents")).select("doc_id", "n_links", "class_id", "kept")


@query
def op4_token_counts(spark, sf):
    """Tokens of every document, counted in flat token files written from the documents."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    folder, stored = token_files.write_token_files(docs, RANKS, WORD_PATTERN, END_ID)
    blocks = token_files.read_token_files(spark, folder, names=stored.select("file").distinct())
    counted = token_files.count_tokens(blocks, END_ID).withColumn("file", F.substring_index("file", "/", -1))
    return counted.join(token_files.document_order(stored), ["file", "ordinal"]).select(
        "doc_id", "n_tokens", "file", "ordinal", "start"
    )


@query
def op5_pieces(spark, sf):
    """Piece ids of every document, and whether they give the text back."""
    vocabulary = pieces.Vocabulary.read(PIECES)
    encoded = pieces.encode_documents(table(spark, sf, "documents").select("doc_id", "text"), vocabulary)
    return pieces.decode_documents(encoded, vocabulary).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("restored"),
    )


@query
def op6_sharding(spark, sf):
    """Shard and slot of every document, for 16 shards of near equal bytes."""
    placed = sharding.shard_documents(table(spark, sf, "documents"))
    return placed.select(
        "doc_id", "size", F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def labelled_languages(spark, docs, sf):
    """The labelled table of the mix: documents that have labels, by language."""
    labels = table(spark, sf, "labels").select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels, "doc_id", "left_semi")


@query
def op9_mixing(spark, sf):
    """Rate and copies of every document, for language shares smoothed by a power of 0.7."""
    docs = table(spark, sf, "documents")
    mix = mixing.fit_rates(docs.select("doc_id", "text"), labelled_languages(spark, docs, sf), weights=0.7)
    return mix.rates.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows"))).select(
        "doc_id", "tokens", mixing.domain_of(mix).alias("domain"), "rate", mixing.copies(mix).alias("copies"),
        F.lit(mix.steps).alias("steps"), F.lit(mix.distance).alias("distance"),
    )


@query
def op7_language_model(spark, sf):
    """Log probabilities of every document, learned from six sevenths of them."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = bloom_lm.score(docs, bloom_lm.training_texts(docs))
    return scored.select(
        "doc_id", (F.coalesce(remainder("doc_id", 7), F.lit(0)) == 2).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


@query
def op8_top_k(spark, sf):
    """The five nearest vectors by integer inner product, for every fiftieth vector."""
    return top_k(table(spark, sf, "embeddings"))


@query
def op10_toxicity(spark, sf):
    """Toxicity of every document, learned from two thirds of the labels."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"),
        F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"),
    )


@query
def op11_decontaminate(spark, sf):
    """Benchmark passages in every document: words hit, items found, near ones."""
    found = phrase_index.find_phrases(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )


@query
def op12_filter_audit(spark, sf):
    """What each of five filters removes after others, per source, order and step."""
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op13_spelling(spark, sf):
    """Near words, form and root of every word that occurs often enough."""
    return spelling.variants(table(spark, sf, "documents").select("doc_id", "text"))
