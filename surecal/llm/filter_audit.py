"""How filters interact: sorted lists of failing ids per part, merged by galloping.

Every document gets a number in one written scan, and each part keeps, per range of numbers
and filter, the sorted list of those that fail. What a filter removes after others is a
difference of its list and a union of theirs; both come from galloping searches, the shorter
list leaping through the longer one. A range is bounded, so lists are too; only sizes leave a
task, and sums of sizes per part answer every order of the filters.

A document is a row. A null text is empty, a null part is the part ''; a document without
labels is neither good nor toxic, one with several label rows is what any of them says. Equal
rows are copies of none of each other, as neither has the smaller id; a null id is
smaller than none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, permutations
from math import factorial
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty, written

LETTERS = "ABCDE"
# Documents whose numbers agree above so many bits are one range.
RANGE_BITS = 16
# A text that makes up this share of all rows or more is looked up by broadcast, so there are
# at most as many such texts as the inverse.
HEAVY_SHARE = 1e-3
# What a size counts: all documents of a difference, the good ones, the toxic ones.
MARKS = ("n", "good", "toxic")


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions A to D; E needs the other documents."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    sizes = F.get(
        F.transform(F.array(words), lambda w: F.struct(
            F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct"))),
        F.lit(0),
    )
    return {
        "_sizes": sizes,
        "A": F.col("_sizes.n") < 50,
        "B": F.col("_sizes.distinct") * 100 < F.col("_sizes.n") * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") * 100 > F.length(text).cast("bigint") * 5,
        "D": F.rlike(text, F.lit(r"[#$%&*|]")),
    }


def scanned(docs: DataFrame) -> DataFrame:
    """(number, doc_id, part, failed, digest): one pass over the texts, written.

    ``failed`` has the bits of A to D.
    """
    text = text_or_empty()
    tests = conditions(text)
    rows = docs.withColumn("_sizes", tests.pop("_sizes"))
    bits = [F.when(test, 1 << LETTERS.index(letter)).otherwise(0) for letter, test in tests.items()]
    return written(
        rows.select(
            F.monotonically_increasing_id().alias("number"), "doc_id",
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            reduce(add, bits).alias("failed"),
            F.sha2(text.cast("binary"), 256).alias("digest"),
        ),
        "scanned",
    )


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with the bit of E set for those whose text a smaller id has.

    Texts that occur once are not joined at all; the few very frequent ones are broadcast, so
    no task gets all copies of a text.
    """
    groups = written(
        rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"),
        "copies",
    )
    least = F.lit(HEAVY_SHARE * rows.count())
    heavy, light = groups.where(F.col("n") > least), groups.where(F.col("n") <= least)
    found = rows.join(
        F.broadcast(heavy.select("digest", F.col("first").alias("first_heavy"))), "digest", "left"
    )
    # Rows of the frequent texts go anywhere: their digest has no partner on the other side.
    key = F.when(F.col("first_heavy").isNull(), F.col("digest")).otherwise(
        F.concat(F.lit("-"), F.col("number").cast("string")))
    found = found.withColumn("key", key).join(
        light.select(F.col("digest").alias("key"), F.col("first").alias("first_light")), "key", "left"
    )
    copy = F.coalesce(F.col("doc_id") > F.coalesce("first_heavy", "first_light"), F.lit(False))
    return found.select(
        "number", "doc_id", "part", (F.col("failed") + F.when(copy, 1 << 4).otherwise(0)).alias("failed")
    )


def failing_lists(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, range, documents, A..E, good, toxic): sorted lists of numbers, written.

    Documents that pass everything are only counted.
    """
    marks = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    ).where("doc_id is not null and (good = 1 or toxic = 1)")
    labelled = rows.join(marks, "doc_id", "left")

    def listed(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.col("number"))))

    fails = F.col("failed") > 0
    return written(
        labelled.groupBy("part", F.shiftright("number", RANGE_BITS).alias("range")).agg(
            F.count(F.lit(1)).alias("documents"),
            *[listed(F.col("failed").bitwiseAND(1 << i) > 0).alias(c) for i, c in enumerate(LETTERS)],
            *[listed(fails & (F.col(c) == 1)).alias(c) for c in ("good", "toxic")],
        ),
        "failing",
    )


def gallop(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of the ascending ``keys``: how many of the ascending ``ids`` are below it.

    A search leaps ahead by doubling steps until it has passed its key, then closes in by
    halving; all keys leap at once, as array operations.
    """
    low = np.zeros(len(keys), dtype=np.int64) - 1
    high = np.full(len(keys), len(ids), dtype=np.int64)
    open_, step = np.arange(len(keys)), 1
    while len(open_):
        at = low[open_] + step
        short = at < len(ids)
        short[short] = ids[at[short]] < keys[open_[short]]
        high[open_[~short]] = np.minimum(at[~short], len(ids))
        low[open_[short]] = at[short]
        open_, step = open_[short], step * 2
    # ids[low] < key <= ids[high], with the ends of the list taken as infinite.
    while len(wide := np.flatnonzero(high - low > 1)):
        middle = (low[wide] + high[wide]) // 2
        below = ids[middle] < keys[wide]
        low[wide[below]] = middle[below]
        high[wide[~below]] = middle[~below]
    return high


def held(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is one of ``ids``, and its place there."""
    at = gallop(keys, ids)
    found = at < len(ids)
    found[found] = ids[at[found]] == keys[found]
    return found, at


def merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The union of sorted lists, sorted, and for each id the lists that have it, as bits.

    The longest list comes first; each shorter one then gallops through what is merged.
    """
    ids, bits = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for i in sorted(range(len(lists)), key=lambda i: -len(lists[i])):
        found, at = held(lists[i], ids)
        bits[at[found]] |= 1 << i
        ids = np.insert(ids, at[~found], lists[i][~found])
        bits = np.insert(bits, at[~found], 1 << i)
    return ids, bits


def difference_sizes(lists: list[np.ndarray], marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all differences and unions, from one merge of the lists.

    ``differences[f, s, m]``: of list f without the union of the lists in the set s (one bit
    per list), by mark m; ``unions[s]``.
    """
    ids, bits = merge(lists)
    sets = np.arange(1 << len(lists))
    weights = [np.ones(len(ids)), *[held(ids, mark)[0].astype(float) for mark in marks]]
    cells = np.stack([np.bincount(bits, weights=w, minlength=len(sets)) for w in weights], axis=1)
    apart = (sets[:, None] & sets[None, :]) == 0
    differences = np.stack([(apart & (sets >> f & 1 == 1)) @ cells for f in range(len(lists))])
    unions = ~apart @ cells[:, 0]
    return np.rint(differences).astype(np.int64), np.rint(unions).astype(np.int64)


_SIZES = T.StructType([
    T.StructField("part", T.StringType()),
    T.StructField("filter", T.IntegerType()),
    T.StructField("before", T.IntegerType()),
    *[T.StructField(c, T.LongType()) for c in ("documents", "gone", *MARKS)],
])


def _sizes_of_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sizes per part, summed over the ranges of a batch."""
    f, s = np.indices((len(LETTERS), 1 << len(LETTERS))).reshape(2, -1)
    keep = (s >> f & 1) == 0
    f, s = f[keep], s[keep]
    for batch in batches:
        sums: dict[str, list] = {}
        for row in batch.itertuples(index=False):
            lists = [np.asarray(getattr(row, c), dtype=np.int64) for c in LETTERS]
            marks = [np.asarray(getattr(row, c), dtype=np.int64) for c in MARKS[1:]]
            found = [row.documents, *difference_sizes(lists, marks)]
            sums[row.part] = [a + b for a, b in zip(sums[row.part], found)] if row.part in sums else found
        for part, (documents, differences, unions) in sums.items():
            yield pd.DataFrame({
                "part": part, "filter": f.astype(np.int32), "before": s.astype(np.int32),
                "documents": documents, "gone": unions[s],
                **{c: differences[f, s, i] for i, c in enumerate(MARKS)},
            })


def _orders(spark) -> DataFrame:
    """The 600 steps of all orders: (filter_order, step, filter, before)."""
    rows = []
    for order in permutations(range(len(LETTERS))):
        name, before = "".join(LETTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            rows.append((name, step, f, before))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def _shapley_weights() -> list[tuple[int, int, int]]:
    """(filter, before, orders that apply the filter right after this set)."""
    k = len(LETTERS)
    return [
        (f, sum(1 << i for i in s), factorial(n) * factorial(k - 1 - n))
        for f in range(k) for n in range(k) for s in combinations([i for i in range(k) if i != f], n)
    ]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step; see the module for what counts as what.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; other columns
    are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = with_copies(scanned(docs.select("doc_id", "text", "source")))
    lists = failing_lists(rows, labels.select("doc_id", "quality", "toxic"))
    sizes = written(
        lists.mapInPandas(_sizes_of_lists, _SIZES)
        .groupBy("part", "filter", "before")
        .agg(*[F.sum(c).alias(c) for c in ("documents", "gone", *MARKS)]),
        "sizes",
    )
    # 80 rows per part, whatever the data; the tables joined with them are fixed.
    weights = spark.createDataFrame(_shapley_weights(), "filter int, before int, orders bigint")
    totals = sizes.join(F.broadcast(weights), ["filter", "before"]).groupBy("part", "filter").agg(
        F.max("n").alias("fails"), F.min("n").alias("unique_fails"),
        F.sum(F.col("n") * F.col("orders")).alias("shapley"),
    )
    return (
        sizes.join(F.broadcast(_orders(spark)), ["filter", "before"]).join(totals, ["part", "filter"])
        .select(
            "part", "filter_order", "step",
            (F.col("documents") - F.col("gone") - F.col("n")).alias("kept"),
            F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails",
            F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
        )
    )
