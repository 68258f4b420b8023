import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import compare, connect
from surecal.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(docs):
    """The set of failed letters of each (doc_id, text, source), one document after another."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in docs:
        t = t or ""
        words = WORD.findall(t)
        bad = set()
        if len(words) < 50:
            bad.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            bad.add("C")
        if re.search("[#$%&*|]", t):
            bad.add("D")
        if i is not None and first[t] < i:
            bad.add("E")
        out.append(bad)
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    bad = failing(docs)
    parts = sorted({s or "" for _, _, s in docs})
    out, sums = [], {}
    for part in parts:
        mine = [(i, b) for (i, _, s), b in zip(docs, bad) if (s or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(i, b) for i, b in left if f in b]
                left = [(i, b) for i, b in left if f not in b]
                out.append([
                    part, "".join(order), step, len(left), len(gone), sum(f in b for _, b in mine) - len(gone),
                    sum(b == {f} for _, b in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ])
                sums[part, f] = sums.get((part, f), 0) + len(gone)
    return sorted(tuple([*r, sums[r[0], r[1][r[2] - 1]]]) for r in out)


def run(spark, docs, labels):
    d = spark.createDataFrame(
        [(i, t, s, "x", 1, 2) for i, t, s in docs],
        "doc_id bigint, text string, source string, part string, failed int, number int")
    lab = spark.createDataFrame([(*r, 7) for r in labels], "doc_id bigint, quality int, toxic int, good int")
    return sorted(map(tuple, filter_audit.audit(d, lab).collect()))


LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    None, "", LONG, LONG + " #", LONG.upper(), "same " * 80, "same " * 80 + "|", "A B C", LONG + "\x0b\x0c é ",
    "x" * 50_000, LONG * 200, " ".join("ab" for _ in range(60)), "SHOUT " * 49 + "$",
]


def documents(n):
    rng = np.random.default_rng(n)
    # A third of all rows share a source, a third of them a text.
    return [
        (int(i) if rng.random() > 0.02 else None, TEXTS[rng.integers(len(TEXTS))] if rng.random() < 0.7 else LONG + f" {i}",
         "hot" if rng.random() < 0.4 else [None, "", "a", "b"][rng.integers(4)])
        for i in rng.permutation(n)
    ]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE_BITS", 3)
    docs = documents(400)
    docs += docs[:5] + [(3, "another text of one id", "a"), (3, None, "a")]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 400, 3)]
    labels = [(i, int(q), int(t)) for i, q, t in labels] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (9999, 1, 1), (6, None, None)]
    assert run(spark, docs, labels) == brute(docs, labels)


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_frequent_texts(spark, monkeypatch, share):
    monkeypatch.setattr(filter_audit, "HEAVY_SHARE", share)
    docs = documents(120)
    assert run(spark, docs, []) == brute(docs, [])


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == []
    clean = [(1, LONG, "a"), (2, LONG + " x", None)]
    got = run(spark, clean, [])
    assert got == brute(clean, []) and len(got) == 1200 and {r[4] for r in got} == {0}


ids = st.lists(st.integers(0, 60), unique=True).map(sorted).map(lambda x: np.array(x, dtype=np.int64))


@settings(max_examples=200, deadline=None)
@given(ids, ids)
def test_gallop_counts_below(keys, held):
    assert filter_audit.gallop(keys, held).tolist() == np.searchsorted(held, keys).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(ids, min_size=1, max_size=5), ids)
def test_sizes_of_sets(lists, mark):
    merged, bits = filter_audit.merge(lists)
    assert merged.tolist() == sorted(set().union(*map(set, (x.tolist() for x in lists))))
    differences, unions = filter_audit.difference_sizes(lists, [mark])
    for s in range(1 << len(lists)):
        union = set().union(*[set(lists[i].tolist()) for i in range(len(lists)) if s >> i & 1])
        assert unions[s] == len(union)
        for f in range(len(lists)):
            left = set(lists[f].tolist()) - union
            if not s >> f & 1:
                assert differences[f, s].tolist() == [len(left), len(left & set(mark.tolist()))]


def test_query_matches_sql(spark, sf):
    assert compare(spark, connect(sf), sf, "op12_filter_audit") is None
