"""Spelling variants: words one edit apart, from a composition of finite automata.

The vocabulary, a minimal acceptor, is composed with a transducer that makes exactly one edit
(insert, delete or replace a code point) and with the acceptor again; the pairs that the
composition accepts are the near words. It is cut by where it starts: words that share their
first characters form one partition, entered at the state which these lead to, and hold all
pairs that differ behind them; mirrored words do the same for pairs that differ before. A
partition of too many words is dealt into blocks, of which every two are composed.

Spark counts the words, deals out the partitions and chooses the forms; an automaton never
holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, lower_ascii, written

# Fixed value: a run of letters.
RUN = "[A-Za-zÀ-ÿ]+"


@dataclass(frozen=True)
class Settings:
    """``noise``: of the runs of a document, those whose checksum it divides lose a code point
    (0: none). A form needs ``ratio`` times the occurrences of the word."""

    min_length: int = 6
    min_count: int = 5
    noise: int = 199
    ratio: int = 5
    block_words: int = 20_000


class Acceptor:
    """Minimal automata over a shared set of states, one root per sorted list of words.

    States with the same continuations are one state, also across lists. Every state knows how
    many words lead on from it, so a path through an automaton counts up the rank of its word.
    """

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self.skip: list[dict[str, int]] = []
        self._known: dict[tuple, int] = {}

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.next)
            total, skip = int(final), {}
            for label, target in arcs:
                skip[label] = total
                total += self.count[target]
            self.next.append(dict(arcs))
            self.skip.append(skip)
            self.final.append(final)
            self.count.append(total)
        return state

    def add(self, words: list[str]) -> int:
        """The root of the automaton of ``words``, distinct and in code-point order."""
        # The path of the last word: its label into each node, whether that ends a word, its arcs.
        path: list[list] = [["", False, []]]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                label, final, arcs = path.pop()
                path[-1][2].append((label, self._state(final, arcs)))

        last = ""
        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            close(shared)
            path.extend([c, False, []] for c in word[shared:])
            path[-1][1] = True
            last = word
        close(0)
        return self._state(path[0][1], path[0][2])

    def common(self, one: int, two: int, barred: str | None = None) -> list[tuple[int, int, int]]:
        """Words that both states accept, as runs of ranks (first rank, second rank, length).

        Words that start with ``barred`` are left out.
        """
        if barred is None and one == two:
            return [(0, 0, self.count[one])]
        runs, open_ = [], [(one, two, 0, 0)]
        while open_:
            one, two, i, j = open_.pop()
            if one == two and barred is None:
                runs.append((i, j, self.count[one]))
                continue
            if self.final[one] and self.final[two]:
                runs.append((i, j, 1))
            first, second = self.next[one], self.next[two]
            for label in first if len(first) <= len(second) else second:
                if label != barred and label in first and label in second:
                    open_.append((first[label], second[label], i + self.skip[one][label], j + self.skip[two][label]))
            barred = None
        return runs


class _Edits:
    """The one-edit transducer between two states of the acceptor, and what follows the edit."""

    def __init__(self, acceptor: Acceptor, same: bool) -> None:
        self.acceptor, self.same = acceptor, same
        self._follow: dict[tuple, list] = {}
        self._edits: dict[tuple[int, int], list] = {}

    def _after(self, one: int, two: int, barred: str | None = None) -> list:
        key = (one, two, barred)
        runs = self._follow.get(key)
        if runs is None:
            runs = self._follow[key] = self.acceptor.common(one, two, barred)
        return runs

    def at(self, one: int, two: int) -> list[tuple[int, int, int]]:
        """Runs of ranks of the pairs whose first difference lies right behind these states."""
        known = self._edits.get((one, two))
        if known is not None:
            return known
        a, out = self.acceptor, []

        def put(i: int, j: int, runs: list) -> None:
            out.extend((i + x, j + y, n) for x, y, n in runs)

        first, second = a.next[one], a.next[two]
        for c, r in first.items():
            for d, s in second.items():
                if c != d and not (self.same and c > d):
                    put(a.skip[one][c], a.skip[two][d], self._after(r, s))
            # The first word has c more. What follows may not start with c, or the words would
            # still agree here; so each pair comes up at one place only.
            put(a.skip[one][c], 0, self._after(r, two, c))
        if not self.same:
            for d, s in second.items():
                put(0, a.skip[two][d], self._after(one, s, d))
        self._edits[one, two] = out
        return out


def near_ranks(first: list[str], second: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (i, j) of all words of the sorted lists that are one edit apart.

    With one list, each unordered pair of its words once.
    """
    acceptor = Acceptor()
    root = acceptor.add(first)
    other = root if second is None else acceptor.add(second)
    edits, runs = _Edits(acceptor, second is None), []
    open_ = [(root, other, 0, 0)]
    # Before the edit both sides read the same labels.
    while open_:
        one, two, i, j = open_.pop()
        runs.extend((i + x, j + y, n) for x, y, n in edits.at(one, two))
        mine, theirs = acceptor.next[one], acceptor.next[two]
        for label, r in mine.items():
            s = theirs.get(label)
            # One word alone has no partner among itself.
            if s is not None and not (second is None and acceptor.count[r] == 1):
                open_.append((r, s, i + acceptor.skip[one][label], j + acceptor.skip[two][label]))
    if not runs:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    i, j, n = np.array(runs, dtype=np.int64).T
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(i, n) + within, np.repeat(j, n) + within


def counted_words(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, n): the runs of letters of all texts, some with a code point lost, counted.

    Words shorter or rarer than ``settings`` asks are left out. A null text has no runs, a
    null doc_id is written as an empty text.
    """
    held = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0)).alias("runs"),
    )
    # The outer form: the other one has the planner cut each text twice.
    runs = held.select("id", F.explode_outer("runs").alias("run")).where(F.length("run") >= settings.min_length)
    word = F.col("run")
    runs = runs.select("id", lower_ascii(word).alias("run"))
    if settings.noise:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = F.pmod("h", F.length("run")).cast("int")
        shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(F.col("h") % settings.noise == 0, shorter).otherwise(F.col("run"))
    return (
        runs.select(word.alias("word")).where(F.length("word") >= settings.min_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= settings.min_count)
    )


def _partitioned(words: DataFrame, settings: Settings) -> DataFrame:
    """Words dealt to start partitions: (mirrored, start, i, j, block, word, n)."""
    shared = settings.min_length // 2
    sides = F.array(*[
        F.struct(F.lit(m).alias("mirrored"), F.substr(w, F.lit(1), F.lit(shared)).alias("start"), w.alias("path"))
        for m, w in ((False, F.col("word")), (True, F.reverse("word")))
    ])
    dealt = words.select("word", "n", F.explode(sides).alias("side")).select("side.*", "n")
    sizes = dealt.groupBy("mirrored", "start").agg(
        F.ceil(F.count(F.lit(1)) / settings.block_words).cast("int").alias("blocks")
    )
    blocks = dealt.join(sizes, ["mirrored", "start"]).withColumn(
        "block", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int")
    )
    return block_pairs(blocks)


def _pairs(part: pd.DataFrame, mirrored: bool, shared: int) -> pd.DataFrame:
    """Both directions of the near pairs of one partition."""
    block = part["block"].to_numpy()
    cut = int(np.searchsorted(block, block[-1]))
    paths, n = part["path"].tolist(), part["n"].to_numpy()
    if cut == 0:
        i, j = near_ranks(paths)
    else:
        i, j = near_ranks(paths[:cut], paths[cut:])
        j = j + cut
    words = np.array([p[::-1] for p in paths] if mirrored else paths, dtype=object)
    if mirrored and len(i):
        # Words that agree on their first characters met in the other half.
        heads = np.array([w[:shared] for w in words], dtype=object)
        apart = heads[i] != heads[j]
        i, j = i[apart], j[apart]
    a, b = np.r_[i, j], np.r_[j, i]
    return pd.DataFrame({"word": words[a], "near": words[b], "near_n": n[b]})


def _partition_pairs(shared: int):
    keys = ["mirrored", "start", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            change = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(change)
            # The last partition may go on in the next batch.
            for begin, end in zip(starts[:-1], starts[1:]):
                yield _pairs(rows.iloc[begin:end], bool(rows["mirrored"].iat[begin]), shared)
            held = rows.iloc[starts[-1]:] if len(starts) else rows
        if held is not None and len(held):
            yield _pairs(held, bool(held["mirrored"].iat[0]), shared)

    return run


def near_words(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, near, near_n): all ordered pairs of ``words`` (word, n) that are one edit apart."""
    keys = ["mirrored", "start", "i", "j"]
    return (
        _partitioned(words, settings).repartition(*keys)
        .sortWithinPartitions(*keys, "block", "path")
        .select(*keys, "block", "path", "n")
        .mapInPandas(_partition_pairs(settings.min_length // 2), "word string, near string, near_n bigint")
    )


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last, the way doubling each round."""
    way = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        way = written(
            way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots"
        )
    return way


def variants(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """word, form, root, n, n_near, form_n for every counted word of ``docs`` (doc_id, text).

    ``form`` is the most frequent near word, the smallest in code-point order of equally
    frequent ones, where it has ``ratio`` times the occurrences; ``root`` where forms lead in
    the end. An empty table has no words. Repeated rows count as often as they are there.
    """
    if settings.ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = written(counted_words(docs, settings), "words")
    # The least pair: most occurrences first, then code-point order.
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    found = near_words(words, settings).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.m") >= F.col("n") * settings.ratio
    formed = written(
        words.join(found, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"),
        ),
        "formed",
    )
    # Occurrences grow by the ratio from form to form, which bounds the steps of a way.
    most = formed.agg(F.max("form_n")).first()[0]
    rounds = 0 if most is None else ceil(log2(max(1.0, log(most / settings.min_count, settings.ratio)) + 1))
    ways = roots(formed.where("form is not null"), rounds)
    return formed.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
