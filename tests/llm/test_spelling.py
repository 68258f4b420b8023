import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import compare, connect
from surecal.llm import spelling
from surecal.llm.common import LOWER, UPPER
from surecal.llm.spelling import Settings

SMALL = str.maketrans(UPPER, LOWER)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counts(docs, s):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if s.noise and h % s.noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= s.min_length and c >= s.min_count}


def brute(docs, s=Settings()):
    n = counts(docs, s)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= s.ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, docs, s=Settings()):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id bigint, text string, word string, n int")
    return sorted(map(tuple, spelling.variants(df.select("doc_id", "text", "word", "n"), s).collect()))


def documents(seed, letters, size):
    """Texts over few letters, so that words have many near ones, some far more frequent."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(letters), rng.integers(4, 10))) for _ in range(size)]
    words += [w[:i] + c + w[i + 1:] for w in words[:40] for i, c in [(int(rng.integers(len(w))), "É")]]
    weights = rng.zipf(1.3, len(words)).clip(max=2000).astype(float)
    docs = [
        (i if i % 17 else None, " ".join(rng.choice(words, 300, p=weights / weights.sum())))
        for i in range(30)
    ]
    docs[3] = (3, docs[3][1].upper())
    return docs + [(1, None), (2, ""), (5, "123 -- !"), docs[4], docs[4], (6, ("x" * 20_000 + " ") * 3 + ("y" + "x" * 19_999 + " ") * 3)]


@pytest.mark.parametrize("letters,size", [("ab", 300), ("abcÿß", 300), ("abcdefgh", 200)])
def test_against_brute_force(spark, letters, size):
    s = Settings(min_count=2, noise=7)
    docs = documents(1, letters, size)
    assert run(spark, docs, s) == brute(docs, s)


@pytest.mark.parametrize("s", [
    Settings(min_count=1, noise=0, block_words=7), Settings(min_length=1, min_count=3, noise=5, ratio=2, block_words=20),
    Settings(min_length=3, min_count=2, ratio=2),
])
def test_blocks_and_short_words(spark, s):
    docs = documents(2, "abc", 150)
    assert run(spark, docs, s) == brute(docs, s)


def test_long_ways(spark):
    # Each word leads to one a letter further on, five times as frequent; the last has ties.
    words = {"aaaaaa": 2, "aaaaab": 4, "aaaabb": 8, "aaabbb": 16, "aabbbb": 32, "abbbbb": 64, "bbbbbb": 128, "abbbbbb": 128}
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    s = Settings(min_count=1, noise=0, ratio=2)
    got = run(spark, docs, s)
    assert got == brute(docs, s)
    assert {r[2] for r in got} == {"abbbbbb", "bbbbbb"}


def test_empty_and_refused(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "short words only")]) == []
    with pytest.raises(ValueError):
        run(spark, [], Settings(ratio=1))


lists = st.lists(st.text("abc", max_size=6), unique=True, min_size=1, max_size=40).map(sorted)


@settings(max_examples=200, deadline=None)
@given(lists)
def test_pairs_of_one_list(words):
    i, j = spelling.near_ranks(words)
    got = sorted(tuple(sorted((words[a], words[b]))) for a, b in zip(i, j))
    assert got == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


@settings(max_examples=200, deadline=None)
@given(lists, lists)
def test_pairs_of_two_lists(first, second):
    i, j = spelling.near_ranks(first, second)
    got = sorted((first[a], second[b]) for a, b in zip(i, j))
    assert got == sorted((a, b) for a in first for b in second if one_edit(a, b))


@settings(max_examples=100, deadline=None)
@given(lists)
def test_acceptor_is_minimal(words):
    acceptor = spelling.Acceptor()
    root = acceptor.add(words)
    assert acceptor.count[root] == len(words)
    # One state per set of continuations.
    heads = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(acceptor.next) == len({frozenset(w[len(h):] for w in words if w.startswith(h)) for h in heads})


def test_query_matches_sql(spark, sf):
    assert compare(spark, connect(sf), sf, "op13_spelling") is None
