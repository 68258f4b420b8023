"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels of their binary logarithm; an n-gram
of level L is inserted L times, each time with its level. A count is read back by probing
level 1, 2, ... until a probe misses. Probabilities are the pair counts smoothed by the word
counts. Exact word counts travel with the filter for the add-one base score.

The filter is cut into blocks by ranges of the n-gram's hash, each of the size its entries ask
for. It is sent to the workers in segments of a bounded size, one after another. Texts are read
once: each run of texts sends its distinct n-grams to the segments that know them, and every
n-gram is probed once, whatever the number of segments. Levels then come back to their run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import delete, discard, remainder, text_or_empty, text_runs, written

_K = np.uint64(0x9E3779B97F4A7C15)
_END = xxhash.xxh3_64_intdigest(b"\x00end")
_START = xxhash.xxh3_64_intdigest(b"\x00start")
_LOW = np.uint64(0xFFFFFFFF)
_KNOWN_WORDS = 200_000
_RUN_BYTES = 2 << 20
# Texts that share one probe of each n-gram, and how hard they are packed meanwhile.
_PROBE_RUN_BYTES = 4 << 20
_PACK_LEVEL = 3
_FLUSH = 900_000
_LEVELS = 40


@dataclass(frozen=True)
class Settings:
    """``pair_weight``: how many word counts a pair's history weighs in the smoothing.

    ``block_bytes``: text per filter block. ``segment_bytes`` bounds what is broadcast at once.
    """

    bits_per_entry: int = 10
    probes: int = 6
    pair_weight: float = 2.0
    block_bytes: int = 4 << 20
    segment_bytes: int = 64 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(history * _K + word)


def _block(grams: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each n-gram; ascending n-grams have ascending blocks."""
    return ((grams >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """64-bit values, all first bytes, then all second ones: equal high bytes compress away."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(dtype).reshape(-1)


def _packed(grams: np.ndarray) -> bytes:
    """Ascending hashes as their differences."""
    return _planes(np.diff(grams, prepend=np.uint64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


def level(count: np.ndarray) -> np.ndarray:
    """1 for one, 2 for 2 and 3, 3 for 4 to 7 and so on."""
    return np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1


def level_count(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1) - 0.5, 0.0)


class _Words(dict):
    """Numbers of the words met lately, and their hashes; 0 is the end of a text."""

    def __init__(self):
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.found = [_END]

    def __missing__(self, word: bytes) -> int:
        number = len(self.found)
        self.found.append(xxhash.xxh3_64_intdigest(word))
        self[word] = number
        return number

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of each text, an end after each; and how many tokens each text has.

        Words are cut at the ASCII white space, ASCII letters are lower-cased.
        """
        flat: list[int] = []
        counts = []
        for text in texts:
            words = (text or "").encode().lower().split()
            flat += map(self.__getitem__, words)
            flat.append(0)
            counts.append(len(words) + 1)
        return np.array(flat, dtype=np.int64), np.array(counts, dtype=np.int64)


def _histories(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], np.cumsum(counts)[:-1]])] = _START
    return before


def _distinct(known: _Words, texts: list[str | None], places: bool = False):
    """Distinct words and pairs of some texts, each ascending, and how often they occur.

    With ``places`` also the tokens of each text, and of every token the place of its word and
    of its pair among the distinct ones.
    """
    numbers, lengths = known.read(texts)
    hashes, n = np.array(known.found, dtype=np.uint64), np.bincount(numbers, minlength=len(known.found))
    used = np.flatnonzero(n)
    used = used[np.argsort(hashes[used])]
    tokens = hashes[numbers]
    grams = _pair(_histories(tokens, lengths), tokens)
    if not places:
        return (hashes[used], n[used]), np.unique(grams, return_counts=True)
    pairs, pair_at = np.unique(grams, return_inverse=True)
    word_at = np.zeros(len(hashes), dtype=np.int64)
    word_at[used] = np.arange(len(used))
    return lengths, hashes[used], word_at[numbers], pairs, pair_at


def _summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams)
    grams, n = grams[order], n[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
    return grams[first], np.add.reduceat(n, first) if len(first) else n


def _halves(grams: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of n-grams with level ``at``."""
    h = _mixed(grams + np.uint64(at * int(_K) % 2**64))
    return h >> np.uint64(32), (h & _LOW) | np.uint64(1)


def _position(a: np.ndarray, b: np.ndarray, i: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """Place of probe ``i`` among ``bits`` bits."""
    return (((a + np.uint64(i) * b) & _LOW) * bits >> np.uint64(32)).astype(np.int64)


def build(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, int]:
    """The model as rows (block, bits, filter, once, words, counts, ...), and the number of blocks.

    ``once`` (words seen once), ``words`` and ``counts`` are a block's exact word counts.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // settings.block_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held = {"word": [empty], "pair": [empty]}

        def merged() -> int:
            for kind, parts in held.items():
                held[kind] = [_summed(*(np.concatenate(x) for x in zip(*parts)))]
            return sum(len(parts[0][0]) for parts in held.values())

        def rows() -> pa.RecordBatch:
            out = {"block": pa.array(np.arange(blocks, dtype=np.int32))}
            for kind in held:
                grams, n = held[kind][0]
                held[kind] = [empty]
                ends = np.searchsorted(_block(grams, blocks), np.arange(blocks + 1))
                spans = list(zip(ends[:-1], ends[1:]))
                out[kind] = pa.array([_packed(grams[i:j]) for i, j in spans], pa.binary())
                out[f"{kind}_n"] = pa.array([_planes(n[i:j]) for i, j in spans], pa.binary())
            batch = pa.RecordBatch.from_pydict(out)
            filled = [bool(len(w) or len(p)) for w, p in zip(batch["word"].to_pylist(), batch["pair"].to_pylist())]
            return batch.filter(pa.array(filled, pa.bool_()))

        for part in text_runs(batches, "text", _RUN_BYTES):
            if len(known) > _KNOWN_WORDS:
                known.restart()
            words, pairs = _distinct(known, part.column("text").to_pylist())
            held["word"].append(words)
            held["pair"].append(pairs)
            if sum(len(h[0]) for parts in held.values() for h in parts) > _FLUSH and merged() > _FLUSH // 2:
                yield rows()
        merged()
        yield rows()
        # The worker goes on to other tasks: what this one used is given back.
        known.restart()
        pa.default_memory_pool().release_unused()

    def pack(group: pa.Table) -> pa.Table:
        def totals(kind: str) -> tuple[np.ndarray, np.ndarray]:
            grams = [_unpacked(x) for x in group[kind].to_pylist()]
            return _summed(np.concatenate(grams), np.concatenate([_from_planes(x) for x in group[f"{kind}_n"].to_pylist()]))

        words, times = totals("word")
        pairs, pair_times = totals("pair")
        grams, levels = np.concatenate([words, pairs]), level(np.concatenate([times, pair_times]))
        bits = max(64, -(-int(levels.sum()) * settings.bits_per_entry // 64) * 64)
        flags = np.zeros(bits, dtype=np.uint8)
        for at in range(1, int(levels.max()) + 1):
            a, b = _halves(grams[levels >= at], at)
            for i in range(settings.probes):
                flags[_position(a, b, i, np.uint64(bits))] = 1
        once = times == 1
        return pa.table({
            "block": group["block"].slice(0, 1), "bits": pa.array([bits], pa.int64()),
            "filter": [np.packbits(flags, bitorder="little").tobytes()],
            "once": [words[once].tobytes()], "words": [words[~once].tobytes()],
            "counts": [times[~once].tobytes()], "n_tokens": [int(times.sum())], "n_words": [len(words)],
        })

    grams = docs.select(text_or_empty().cast("string").alias("text")).mapInArrow(
        count, "block int, word binary, word_n binary, pair binary, pair_n binary"
    )
    return written(
        grams.groupBy("block").applyInArrow(
            pack, "block int, bits bigint, filter binary, once binary, words binary, counts binary, n_tokens bigint, n_words bigint"
        ),
        "language-model",
    ), blocks


class Segment:
    """Some blocks of the model, as arrays: what one pass over the texts knows."""

    def __init__(self, model: DataFrame, blocks: int, probes: int):
        """``model``: the rows of the segment, read to the driver column by column."""

        def column(name: str, dtype) -> np.ndarray:
            return np.frombuffer(b"".join(bytes(r[0]) for r in model.select(name).orderBy("block").collect()), dtype=dtype)

        self.blocks, self.probes = blocks, probes
        self.start = np.full(blocks, -1, dtype=np.int64)
        self.bits = np.ones(blocks, dtype=np.int64)
        at = 0
        for r in model.select("block", "bits").orderBy("block").collect():
            self.start[r.block], self.bits[r.block] = at, r.bits
            at += r.bits
        self.filter = column("filter", np.uint8)
        self.once = np.sort(column("once", np.uint64))
        words = column("words", np.uint64)
        order = np.argsort(words)
        self.words = words[order]
        self.counts = column("counts", np.int64)[order]

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Levels read from the filter; 0 for n-grams of other segments.

        Ascending n-grams are read fastest: neighbouring probes fall close together.
        """
        out = np.zeros(len(grams), dtype=np.uint8)
        block = _block(grams, self.blocks)
        at_gram = np.flatnonzero(self.start[block] >= 0)
        block = block[at_gram]
        start, bits, grams = self.start[block], self.bits[block].astype(np.uint64), grams[at_gram]
        for at in range(1, _LEVELS + 1):
            if not len(at_gram):
                break
            a, b = _halves(grams, at)
            for i in range(self.probes):
                p = start + _position(a, b, i, bits)
                hit = ((self.filter[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
                if not hit.all():
                    # Those that missed are not probed again.
                    at_gram, start, bits, grams, a, b = (x[hit] for x in (at_gram, start, bits, grams, a, b))
            out[at_gram] = at
        return out

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Exact counts of words; 0 for those of other segments."""
        found = np.zeros(len(words), dtype=np.int64)
        for known, counts in ((self.once, None), (self.words, self.counts)):
            if len(known):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hit = known[at] == words
                found[hit] = 1 if counts is None else counts[at[hit]]
        return found


def _segments(model: DataFrame, limit: int) -> list[list[int]]:
    """Runs of blocks whose bytes stay below the limit."""
    size = F.length("filter") + F.length("once") + F.length("words") + F.length("counts")
    out, held = [[]], 0
    for r in model.select("block", size.alias("n")).orderBy("block").collect():
        if out[-1] and held + r.n > limit:
            out.append([])
            held = 0
        out[-1].append(r.block)
        held += r.n
    return out


def score(docs: DataFrame, training: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` as doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: one token, the end. Every row of ``docs`` gives a row. Without
    training texts N and V are 0, and every token has probability 1 under the base model.
    """
    model, blocks = build(training.select("text"), settings)
    sums = model.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    n, v = int(sums[0] or 0), int(sums[1] or 0)
    starts = training.count()
    spark = docs.sparkSession
    segments = _segments(model, settings.segment_bytes)
    firsts = np.array([chosen[0] if chosen else 0 for chosen in segments[1:]], dtype=np.int64)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    schema = "segment int, run bigint, a binary, b binary, c binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per run of texts: the texts themselves (segment -1), and its n-grams by segment."""
        known = _Words()
        run = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=_PACK_LEVEL))
        for part in text_runs(batches, "text", _PROBE_RUN_BYTES):
            if len(known) > _KNOWN_WORDS:
                known.restart()
            (words, _), (pairs, _) = _distinct(known, part.column("text").to_pylist())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as stream:
                stream.write_batch(part)
            rows = [(-1, run, sink.getvalue().to_pybytes(), None, None)]
            word_ends, pair_ends = (
                np.r_[0, np.searchsorted(_block(grams, blocks), firsts), len(grams)] for grams in (words, pairs)
            )
            for at in range(len(segments)):
                w, p = words[word_ends[at]:word_ends[at + 1]], pairs[pair_ends[at]:pair_ends[at + 1]]
                rows.append((at, run, _packed(w), _packed(p), None))
            yield _batch(rows)
            run += 1

    def probe(shared):
        def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                for at, run, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    words = _unpacked(a)
                    read = model.levels(words).tobytes(), model.levels(_unpacked(b)).tobytes()
                    yield _batch([(at, run, *read, _planes(model.exact(words)))])

        return levels

    def finish(group: pa.Table) -> pa.Table:
        """Scores of the texts of one run, from what all segments know of its n-grams."""
        rows = sorted(zip(*(group[name].to_pylist() for name in ("segment", "a", "b", "c"))), key=lambda row: row[0])
        with pa.ipc.open_stream(rows[0][1]) as stream:
            part = stream.read_all()
        counts, _, word_at, _, pair_at = _distinct(_Words(), part["text"].to_pylist(), places=True)
        # Segments ascend as the n-grams do.
        word, pair = (np.frombuffer(b"".join(row[i] for row in rows[1:]), np.uint8).astype(np.int64) for i in (1, 2))
        exact = np.concatenate([_from_planes(row[3]) for row in rows[1:]])[word_at]
        word, pair = level_count(word)[word_at], level_count(pair)[pair_at]
        first = np.cumsum(counts) - counts
        history = np.empty_like(word)
        history[1:] = word[:-1]
        history[first] = starts
        p1 = (word + 1.0) / (n + v + 1.0)
        history = np.maximum(history, pair)
        p = (pair + settings.pair_weight * p1) / (history + settings.pair_weight)
        base = np.add.reduceat(np.log10(exact + 1.0), first) - counts * np.log10(n + v + 1.0)
        return pa.table({
            "doc_id": part["doc_id"], "n_tokens": counts, "n_known": np.add.reduceat((exact > 0).astype(np.int64), first),
            "base_score": base, "score": np.add.reduceat(np.log10(np.minimum(p, 1.0)), first),
        })

    path = scratch_path(spark, "text-runs")
    texts.mapInArrow(read, schema).write.partitionBy("segment").parquet(path, compression="zstd")
    rows = spark.read.schema(schema).parquet(path)
    found = scratch_path(spark, "levels")
    for i, chosen in enumerate(segments):
        part = model.where(F.col("block").between(*((chosen[0], chosen[-1]) if chosen else (1, 0))))
        # At most segment_bytes, or one block.
        shared = spark.sparkContext.broadcast(Segment(part, blocks, settings.probes))
        mine = rows.where(F.col("segment") == i).select("segment", "run", "a", "b")
        mine.mapInArrow(probe(shared), schema).write.mode("append").parquet(found)
        shared.destroy()
        delete(spark, f"{path}/segment={i}")
    discard(model)
    levels = rows.where("segment = -1").unionByName(spark.read.schema(schema).parquet(found))
    final = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = levels.groupBy("run").applyInArrow(finish, final)
    return scored.withColumn("train_tokens", F.lit(n).cast("bigint"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["segment", "run", "a", "b", "c"])


def training_texts(docs: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id as text) mod 7 is not 2; null ids are among them."""
    return docs.where(F.coalesce(remainder("doc_id", 7), F.lit(0)) != 2)
