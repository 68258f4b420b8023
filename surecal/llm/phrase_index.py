"""Benchmark passages in documents: a positional inverted index, searched from the rarest words.

The words of all documents that any benchmark item uses are posted as (term, document,
position), sorted by term within each part. A benchmark window is looked up by its rarest
term; the lists of the next rarest ones, shifted by their place in the window, are intersected
with what is left, first within a few words (proximity), then exactly, until all words of the
window agree (phrase). All of it is column expressions.

A document is a row: rows that share a doc_id but not a text stay apart, whole repeated rows
have the same result each. A null text has no words, a null doc_id is an id like others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_or_empty, written

# Fixed value: a word, before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The term posted behind the last word of each document; its position is the number of words.
END = -1
# What is known of the benchmark alone is broadcast up to so many bytes, by count; beyond that
# it is joined by shuffles.
BROADCAST_BYTES = 64 << 20
# A generous size of a word of a window: its text, count, place and term, as objects.
WORD_BYTES = 200


Hint = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    """``window``: words of a phrase. Near: the ``near_terms`` rarest words of a window stand
    at most ``slop`` words from where the rarest one puts them."""

    window: int = 10
    slop: int = 2
    near_terms: int = 3


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id string, terms): every run of ``window`` words of an item, or all of a short one."""
    held = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.transform(words(text_or_empty()), lower_ascii).alias("all"),
    ).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.slice("all", i, F.lit(window)))
    return held.select("item_id", F.explode(cut).alias("terms")).distinct()


def with_end(words: DataFrame) -> DataFrame:
    """(word, term): numbered distinct words, and the empty one, which stands for the end."""
    end = words.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(END).cast("bigint").alias("term"))
    return words.distinct().withColumn("term", F.monotonically_increasing_id()).unionByName(end)


def post(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (term, doc, position) of the words in ``vocabulary`` (word, term), END included."""
    text = text_or_empty()
    # No word is empty, so the empty one can stand for the end. The text ends here: what an
    # explode is selected with is computed for each word.
    held = docs.select(
        F.struct("doc_id", F.xxhash64(text).alias("text_hash")).alias("doc"),
        F.concat(words(text), F.array(F.lit(""))).alias("all"),
    )
    # Never empty; the outer form keeps the planner from testing that by cutting each text twice.
    tokens = held.select("doc", F.posexplode_outer("all").alias("position", "found"))
    return (
        tokens.withColumn("word", lower_ascii(F.col("found")))
        .join(vocabulary, "word")
        .select("term", "doc", "position")
        .sortWithinPartitions("term")
    )


def search_plan(windows: DataFrame, vocabulary: DataFrame, index: DataFrame) -> DataFrame:
    """(window, probes): the terms of each window, rarest first, where all of them occur."""
    counts = index.where(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = windows.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "word"))
    probe = F.struct("n", "word", "offset", "term")
    return (
        placed.join(vocabulary, "word").join(counts, "term")
        .groupBy("window", "size").agg(F.array_sort(F.collect_list(probe)).alias("probes"))
        .where(F.size("probes") == F.col("size"))
        .select("window", "probes")
    )


def _probe(k: int, field: str) -> Column:
    return F.get("probes", F.lit(k))[field]


def _lists(index: DataFrame, plan: DataFrame, k: int, hint: Hint) -> DataFrame:
    """The postings of the terms that are the k-th rarest of any window."""
    terms = plan.where(F.size("probes") > k).select(_probe(k, "term").alias("term")).distinct()
    return index.join(hint(terms), "term", "left_semi")


def _places(index: DataFrame, plan: DataFrame, hint: Hint) -> DataFrame:
    """(window, doc, start, exact): where the rarest term puts each window."""
    anchor = plan.select("window", _probe(0, "term").alias("term"), _probe(0, "offset").alias("offset"))
    return index.join(hint(anchor), "term").select(
        "window", "doc", (F.col("position") - F.col("offset")).alias("start"), F.lit(True).alias("exact")
    )


def _intersected(
    places: DataFrame, index: DataFrame, plan: DataFrame, k: int, slop: int, hint: Hint
) -> DataFrame:
    """``places`` whose k-th rarest term is at most ``slop`` words off; ``exact`` where it is not off.

    Positions are compared within stretches as wide as the tolerance, so a place looks into two
    stretches at most. Windows of fewer terms pass.
    """
    width = 2 * slop + 1
    short = plan.where(F.size("probes") <= k).select("window")
    term = plan.where(F.size("probes") > k).select(
        "window", _probe(k, "term").alias("term"), _probe(k, "offset").alias("offset")
    )

    def stretch(position: Column) -> Column:
        return F.floor(position / F.lit(width))

    wanted = places.join(hint(term), "window").withColumn("at", F.col("start") + F.col("offset")).withColumn(
        "stretch", F.explode(F.array_distinct(F.array(stretch(F.col("at") - slop), stretch(F.col("at") + slop))))
    )
    listed = _lists(index, plan, k, hint).withColumn("stretch", stretch(F.col("position")))
    met = wanted.join(listed, ["doc", "term", "stretch"]).withColumn("off", F.abs(F.col("position") - F.col("at")))
    found = (
        met.where(F.col("off") <= slop).groupBy("window", "doc", "start")
        .agg(F.max(F.col("exact") & (F.col("off") == 0)).alias("exact"))
    )
    passed = places.join(hint(short), "window", "left_semi").distinct()
    return found.unionByName(passed)


def _phrases(places: DataFrame, index: DataFrame, plan: DataFrame, known: int, hint: Hint) -> DataFrame:
    """(window, doc, start, size) of the exact ``places`` whose terms from the ``known``-th on agree too."""
    exact = written(
        places.where("exact").select("window", "doc", "start").distinct().join(hint(plan), "window")
        .withColumn("size", F.size("probes")),
        "phrase-places",
    )
    # Only the lists of documents that have a place are read on.
    documents = written(exact.select("doc").distinct(), "phrase-documents")
    lists = index.where(F.col("term") != END).join(documents, "doc", "left_semi")
    rest = exact.select(
        "window", "doc", "start", "size", F.explode(F.slice("probes", known + 1, F.size("probes"))).alias("p")
    ).select("window", "doc", "start", "size", "p.term", (F.col("start") + F.col("p.offset")).alias("position"))
    agreed = (
        rest.join(lists, ["doc", "term", "position"], "left_semi")
        .groupBy("window", "doc", "start", "size").agg(F.count(F.lit(1)).alias("agreed"))
        .where(F.col("agreed") == F.col("size") - known)
    )
    whole = exact.where(F.col("size") <= known)
    return agreed.drop("agreed").unionByName(whole.select("window", "doc", "start", "size"))


def _listed_items(found: DataFrame, items: DataFrame, out: str) -> DataFrame:
    """(doc, out): the sorted ids of the items whose windows were found, each once."""
    return (
        found.select("doc", "window").distinct().join(items, "window")
        .groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias(out))
    )


def find_phrases(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_hit, items, near_items per row of ``docs`` (doc_id, text).

    ``items`` are the ids (as strings, sorted) of items with a window that occurs word for
    word, ``near_items`` of those with a near one; ``n_hit`` counts words inside occurring
    windows, each once. An empty table on either side gives no hits. Only counts of
    the data, no rows, pass through the driver.
    """
    by_item = written(item_windows(items.select("item_id", "text"), settings.window), "item-windows")
    windows = written(
        by_item.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()), "windows"
    )
    vocabulary = written(with_end(windows.select(F.explode("terms").alias("word"))), "vocabulary")
    size = windows.agg(F.coalesce(F.sum(F.size("terms").cast("bigint")), F.lit(0))).first()[0] * WORD_BYTES
    hint: Hint = F.broadcast if size <= BROADCAST_BYTES else lambda t: t
    index = written(post(docs.select("doc_id", "text"), hint(vocabulary)), "postings", compression="zstd")
    plan = written(search_plan(windows, vocabulary, index), "search-plan")
    places = _places(index, plan, hint)
    for k in range(1, settings.near_terms):
        places = written(_intersected(places, index, plan, k, settings.slop, hint), "places")
    phrases = written(_phrases(places, index, plan, settings.near_terms, hint), "phrases")

    owners = by_item.join(windows, "terms").select("window", "item_id")
    inside = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))
    hit = (
        phrases.select("doc", "start", "size").distinct().select("doc", inside.alias("position")).distinct()
        .groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    none = F.array().cast("array<string>")
    return (
        index.where(F.col("term") == END).select("doc", F.col("position").cast("bigint").alias("n_words"))
        .join(hit, "doc", "left")
        .join(_listed_items(phrases, owners, "items"), "doc", "left")
        .join(_listed_items(places, owners, "near_items"), "doc", "left")
        .select(
            F.col("doc.doc_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
        )
    )
