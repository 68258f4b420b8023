import re
from collections import Counter
from hashlib import sha256

import pytest

from compare import compare, connect
from surecal.llm import phrase_index
from surecal.llm.common import LOWER as SMALL
from surecal.llm.common import UPPER as GREAT
from surecal.llm.phrase_index import Settings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(GREAT, SMALL)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10, slop=2, near_terms=3):
    """doc_id, n_words, n_hit, items, near items of each row, by reading every text in full."""
    corpus = Counter(w for _, t in docs for w in words(t))
    windows = {
        (i if i is not None else "", tuple(w[k : k + size]))
        for i, t in items for w in [words(t)] if w for k in range(max(len(w) - size, 0) + 1)
    }
    out = []
    for doc_id, text in docs:
        held, hit, found, near = words(text), set(), set(), set()
        for item, window in windows:
            n = len(window)
            for p in range(len(held) - n + 1):
                if tuple(held[p : p + n]) == window:
                    hit.update(range(p, p + n))
                    found.add(str(item))
            if all(corpus[w] for w in window):
                rare = sorted((corpus[w], w.encode(), o) for o, w in enumerate(window))[:near_terms]
                for p, w in enumerate(held):
                    start = p - rare[0][2]
                    if w.encode() == rare[0][1] and all(
                        any(0 <= q < len(held) and held[q].encode() == r[1]
                            for q in range(start + r[2] - slop, start + r[2] + slop + 1))
                        for r in rare[1:]
                    ):
                        near.add(str(item))
        out.append((doc_id, len(held), len(hit), sorted(found), sorted(near)))
    return sorted(out, key=str)


def run(spark, docs, items, **settings):
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id bigint, text string, term int, word string, position int")
    b = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id bigint, text string, window int")
    return sorted((tuple(r) for r in phrase_index.find_phrases(d, b, Settings(**settings)).collect()), key=str)


ITEMS = [
    (1, "One two THREE four five six seven eight nine ten eleven twelve"), (2, "alpha beta"), (10, "zero"),
    (3, None), (4, ""), (5, "!!! ..."), (6, "the the the the the the the the the the the"), (7, "never seen words here"),
    (8, "one two three four five six seven eight nine ten"), (8, "gamma delta"), (None, "Ünï straße É"),
]
P = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, None), (2, ""), (3, f"x {P} y {P}"), (4, P.replace("five", "5")), (5, "ALPHA, beta-alpha beta; zero"),
    (6, "the " * 40), (7, f"{P} " * 300 + "tail"), (8, "gamma  delta ünï STRASSE É ünï straße É ünï straße é"),
    (9, "one two three four FIVE, six? seven--eight nine\nten twelve"), (None, f"null {P}"), (None, None),
    (3, "alpha"), (5, "ALPHA, beta-alpha beta; zero"), (5, "ALPHA, beta-alpha beta; zero"), (11, "a" * 100_000 + " zero" + "\x00zero\x7f" * 3),
    (12, "six seven one two zero three four five eight nine ten eleven"),
]


def test_against_brute_force(spark):
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("size,slop,near_terms", [(3, 0, 2), (4, 1, 1), (1, 2, 3), (5, 3, 5)])
def test_other_settings(spark, size, slop, near_terms):
    got = run(spark, DOCS, ITEMS, window=size, slop=slop, near_terms=near_terms)
    assert got == brute(DOCS, ITEMS, size, slop, near_terms)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DOCS, []) == brute(DOCS, [])


def test_passage_in_a_third_of_all_rows(spark):
    docs = [(i, f"w{i} {P} z{i % 7}" if i % 3 == 0 else f"one two w{i} three") for i in range(600)]
    assert run(spark, docs, ITEMS) == brute(docs, ITEMS)


def test_no_python_in_the_plan(spark, sf):
    from surecal.llm.queries import QUERIES

    plan = QUERIES["op11_decontaminate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_matches_sql(spark, sf):
    assert compare(spark, connect(sf), sf, "op11_decontaminate") is None
    assert sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_benchmark_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(phrase_index, "BROADCAST_BYTES", 0)
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)
