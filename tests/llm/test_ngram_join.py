from itertools import combinations

import pytest
from pyspark.sql import types as T

from surecal.llm import ngram_join as module
from surecal.llm.common import table
from surecal.llm.ngram_join import banding, ngram_join, one_of_each

SCHEMA = "doc_id bigint, text string, digest string, lang string"


def grams(text):
    tokens = (text or "").lower().split()
    if not tokens:
        return set()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))}


def brute(rows):
    """(doc_id, text) -> (links, class, kept) by comparing all pairs."""
    nodes = sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    sets = [grams(t) for _, t in nodes]
    links, root = [0] * len(nodes), list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(nodes)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {nodes[i]: (links[i], nodes[find(i)][0]) for i in range(len(nodes))}


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = ngram_join(df.select("doc_id", "text", "digest", "lang"))
    want = brute(rows)
    texts = {(r[0], r[1]) for r in rows}
    out = got.collect()
    assert len(out) == len(texts)
    from hashlib import md5
    by = {(i, None if t is None else md5(t.encode()).hexdigest()): v for (i, t), v in want.items()}
    assert {(r.doc_id, r.digest): (r.n_links, r.class_id) for r in out} == by
    for cls in {r.class_id for r in out if r.n_links}:
        assert sum(r.kept for r in out if r.class_id == cls and r.n_links) == 1
    return out


def test_banding_reaches_the_recall():
    bands, rows = banding(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, "  \n"), (4, "a b c"), (5, "A b  c"), (6, "a b c d"), (7, long),
        (8, long + " tail"), (8, "another text with the same id here"), (None, "a b c"),
        (None, long), (9, "x y z u v w x y z u v w"), (9, "x y z u v w x y z u v w"),
    ]
    check(spark, [(i, t, "d", "en") for i, t in rows])


def test_empty_table(spark):
    assert ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text, "", "") for r in table(spark, sf, "documents").collect()]
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    base = [words[(i * i + i // 3) % 10] + str(i % 17) for i in range(60)]
    for i in range(700):
        copy = list(base)
        copy[i % 60] = f"n{i}"
        if i % 3 == 0:
            copy[(i * 7) % 60] = "m"
        rows.append((10_000 + i, " ".join(copy), "", ""))
    check(spark, rows)


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = [(1, "a b c d e f", "x", "en"), (1, "a b c d e f", "x", "en"), (2, "a b c d e f", "y", "de"),
            (3, None, "z", None), (None, "q r s t u v", "z", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = one_of_each(df, ngram_join(df))
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3]


def test_blocks_of_few_bytes_give_the_same_links(spark, monkeypatch):
    """Long texts make more blocks, down to less than a text each; no link is lost or counted twice."""
    monkeypatch.setattr(module, "BLOCK_BYTES", 4_000)
    base = [f"word{i}" for i in range(80)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[i] = f"n{i}"
        rows.append((i, " ".join(copy * (1 + i % 2)), "", ""))
    rows.append((100, " ".join(base * 30), "", ""))
    check(spark, rows)
