import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from surecal.llm import bloom_lm
from surecal.llm.common import table
from surecal.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower) + [None]


def brute(rows):
    train = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        ts = tokens(t)
        out.append((i, len(ts), sum(train[x] > 0 for x in ts), n,
                    sum(log10((train[x] + 1) / (n + v + 1)) for x in ts)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string")
    return bloom_lm.score(df, bloom_lm.training_texts(df), bloom_lm.Settings(**settings)).collect()


ROWS = [(i, f"The cat {i % 7} SAT on\tthe é mat\x85x {i} y") for i in range(200)] + [
    (300, None), (301, ""), (None, "the cat"), (302, "Ünseen WORDS only"), (303, "very long " * 60_000), (5, "the cat"),
    (None, None)]


def test_base_scores(spark):
    out = run(spark, ROWS)
    same([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out], brute(ROWS))
    assert all(r.score <= 0 for r in out)


def brute_scores(rows, weight=2.0):
    """Scores from exact counts of words and pairs, by level, without any filter."""
    def middle(c):
        return 1.5 * 2.0 ** (c.bit_length() - 1) - 0.5 if c else 0.0

    words, pairs, starts = Counter(), Counter(), 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            ts = tokens(t)
            words.update(ts)
            pairs.update(zip(["<start>", *ts[:-1]], ts))
            starts += 1
    n, v, out = sum(words.values()), len(words), []
    for i, t in rows:
        ts, total = tokens(t), 0.0
        for before, x in zip([None, *ts[:-1]], ts):
            history = starts if before is None else middle(words[before])
            pair = middle(pairs["<start>" if before is None else before, x])
            p = (pair + weight * (middle(words[x]) + 1) / (n + v + 1)) / (max(history, pair) + weight)
            total += log10(min(p, 1.0))
        out.append((i is None, i or 0, len(ts), total))
    return sorted(out)


@pytest.mark.parametrize("segment_bytes", [112 << 20, 4_000])
def test_scores_by_brute_force(spark, segment_bytes):
    """With a filter too wide for errors, scores are those of exact counts read by level."""
    out = run(spark, ROWS, bits_per_entry=60, probes=20, block_bytes=50_000, segment_bytes=segment_bytes)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in out)
    want = brute_scores(ROWS)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-9)


def test_hashes_survive_packing():
    grams = np.sort(np.random.default_rng(1).integers(0, 2**64 - 1, 1_000, dtype=np.uint64))
    assert (bloom_lm._unpacked(bloom_lm._packed(grams)) == grams).all()
    assert len(bloom_lm._unpacked(bloom_lm._packed(grams[:0]))) == 0
    block = bloom_lm._block(grams, 7)
    assert (np.diff(block) >= 0).all() and set(block) == set(range(7))


def test_segments_do_not_change_results(spark):
    one = run(spark, ROWS, block_bytes=50_000)
    many = run(spark, ROWS, block_bytes=50_000, segment_bytes=1_000)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    for a, b in zip(sorted(one, key=key), sorted(many, key=key)):
        assert a[:3] == b[:3] and a.score == b.score and a.base_score == pytest.approx(b.base_score)


def test_no_rows_and_no_training(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert bloom_lm.score(df.limit(0), df).count() == 0
    alone = bloom_lm.score(df, df.limit(0)).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score) == (3, 0, 0, 0.0)


def test_levels_are_read_back():
    rng = np.random.default_rng(0)
    counts = np.concatenate([rng.integers(1, 200, 20_000), [10**6]])
    assert (bloom_lm.level(np.array([1, 2, 3, 4, 7, 8])) == [1, 2, 2, 3, 3, 4]).all()
    middle = bloom_lm.level_count(bloom_lm.level(counts))
    assert ((middle / counts < 1.51) & (middle / counts > 0.66)).all()


def test_pair_model_beats_words_on_held_out_text(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op7_language_model"](spark, sf)
    rows = out.where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    same([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out.collect()], brute(docs))


def test_filter_gives_levels_back():
    """Every stored level is read back, or a higher one at the filter's error rate."""
    rng = np.random.default_rng(4)
    grams = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    levels = rng.integers(1, 6, 20_000)
    bits = int(levels.sum()) * 8
    flags = np.zeros(bits, dtype=np.uint8)
    for at in range(1, 6):
        a, b = bloom_lm._halves(grams[levels >= at], at)
        for i in range(5):
            flags[bloom_lm._position(a, b, i, np.uint64(bits))] = 1
    segment = object.__new__(bloom_lm.Segment)
    segment.blocks, segment.probes = 1, 5
    segment.start, segment.bits = np.zeros(1, np.int64), np.array([bits])
    segment.filter = np.packbits(flags, bitorder="little")
    got = segment.levels(grams)
    assert (got >= levels).all() and (got == levels).mean() > 0.95
    other = segment.levels(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    assert (other > 0).mean() < 0.05


def test_error_rate_of_the_production_filter(spark):
    """Unseen word pairs read as seen, in the model that ``build`` makes with ``Settings()``."""
    rng = np.random.default_rng(6)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 200))) for _ in range(300)]
    settings = bloom_lm.Settings()
    model, blocks = bloom_lm.build(spark.createDataFrame([(t,) for t in texts], "text string"), settings)
    segment = bloom_lm.Segment(model, blocks, settings.probes)
    unseen = segment.levels(rng.integers(0, 2**63, 200_000, dtype=np.uint64))
    assert (unseen > 0).mean() < 0.011
