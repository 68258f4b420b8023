import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from surecal.llm import bit_sliced

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<double>, rank int"


def brute(rows, k):
    ok = {(i, tuple(e)) for i, e in rows if i is not None and e
          and all(x is not None and np.isfinite(x) for x in e)}
    q = [(i, [int(np.floor(256.0 * x)) for x in e]) for i, e in ok]
    out = []
    for i, a in q:
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q if j != i and len(a) == len(b))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale,k", [(0.01, 5), (1.0, 5), (40.0, 3)])
def test_against_brute_force(spark, monkeypatch, scale, k):
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 100)
    monkeypatch.setattr(bit_sliced, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) * scale]) for i in range(700)]
    # Many ties and copies.
    rows += [(1000 + i, rows[50][1]) for i in range(60)] + [(7, rows[7][1])]
    rows += [(2000, None), (2050, [NAN, 1.0, 1.0, 1.0]), (2100, [INF, 0.0, 0.0, 0.0]), (2150, [None, 1.0, 1.0, 1.0]),
             (2200, []), (None, [1.0] * 4), (2250, [0.0] * 4), (-50, [-1.0, 2.0, -3.0, 0.5])]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA)
    got = sorted(map(tuple, bit_sliced.top_k(df, k).collect()))
    assert got == brute(rows, k)


def test_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=(2, 5, 5, 9)[i % 4])]) for i in range(400)]
    rows += [(1000, [1e-3]), (1050, [3.0] * 700), (1051, [-2.0] * 700)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA)
    assert sorted(map(tuple, bit_sliced.top_k(df).collect())) == brute(rows, 5)


def test_components_near_the_limit(spark):
    big = [(0, [2.0**20, -(2.0**20)]), (1, [2.0**20, 2.0**20 - 1 / 256]), (50, [-(2.0**20), 2.0**20])]
    df = spark.createDataFrame([(i, e, 1) for i, e in big], SCHEMA)
    assert sorted(map(tuple, bit_sliced.top_k(df).collect())) == brute(big, 5)
    with pytest.raises(Exception, match="64 bits"):
        bit_sliced.top_k(spark.createDataFrame([(0, [2.0**30, 1.0], 1), (1, [2.0**30, 1.0], 1)], SCHEMA)).collect()


def test_every_vector_asks(spark, monkeypatch):
    # Blocks are sent to a few parts of the queries, not once for every few queries; parts to groups of blocks.
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 100)
    monkeypatch.setattr(bit_sliced, "MOST_GROUPS", 2, raising=False)
    monkeypatch.setattr(bit_sliced, "BLOCK_QUERIES", 3)
    values = np.random.default_rng(4).normal(size=(1_500, 3))
    df = spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate(values)], SCHEMA)
    searched = []
    search = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: searched.append(self) or search(self, *a, **b))
    got = sorted(map(tuple, bit_sliced.top_k(df, 4, F.lit(True)).collect()))
    q = np.floor(256.0 * values).astype(int)
    scores = q @ q.T
    want = []
    for i in range(len(q)):
        best = sorted((-s, j) for j, s in enumerate(scores[i].tolist()) if j != i)[:4]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == want
    data = "slices" if "slices" in searched[0].columns else "data"
    sent = searched[0] if data == "slices" else searched[0].where("not asks")
    sizes = [r[0] for r in sent.select(F.length(data)).collect()]
    blocks = [r[0] for r in sent.select("ids", F.length(data).alias("n")).distinct().select("n").collect()]
    assert len(blocks) == 15 and sum(sizes) <= 8 * sum(blocks)
    assert searched[0].where("asks").count() == 2 * 4


def test_parts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "BLOCK_COMPONENTS", 400, raising=False)
    monkeypatch.setattr(bit_sliced, "MOST_PARTS", 2, raising=False)
    rng = np.random.default_rng(5)
    rows = [(i * 10, [float(x) for x in rng.normal(size=(4, 7)[i % 2])]) for i in range(600)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA)
    assert sorted(map(tuple, bit_sliced.top_k(df).collect())) == brute(rows, 5)


@pytest.mark.parametrize("low,high,size", [(-3, 4, 5), (0, 1, 1), (-(2**28), 2**29, 2**28), (7, 7, 9), (-1, -1, 2**59), (-(2**57), 2**57, 3)])
def test_added_slices(low, high, size):
    rng = np.random.default_rng(6)
    values = rng.integers(low, high, endpoint=True, size=(150, 6))
    weights = rng.integers(-size, size, endpoint=True, size=(40, 6))
    weights[0], weights[1], weights[2], values[140:] = 0, size, -size, values[0]
    ids, asks = np.arange(150) // 2 * 2, np.arange(0, 80, 2)
    lowest = int(values.min())
    slices = bit_sliced.sliced(values, lowest, max(1, int(values.max() - lowest).bit_length()))
    found = bit_sliced.best_of_block(ids, slices, lowest, asks, weights, 20)
    for q, w in zip(asks, weights):
        got = sorted((-s, i) for i, s in found.loc[found["query_id"] == q, ["vec_id", "score"]].itertuples(index=False))
        scores = [sum(int(a) * int(b) for a, b in zip(v, w)) for v in values]
        assert got == sorted((-s, i) for i, s in zip(ids.tolist(), scores) if i != q)[:20]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, -1.0], 1), (2, [0.0, 0.0], 1)], SCHEMA)
    assert sorted(map(tuple, bit_sliced.top_k(df).collect())) == [(0, 1, 2, 0), (0, 2, 1, -65536)]
    assert bit_sliced.top_k(df.limit(0)).collect() == []
    assert bit_sliced.top_k(df.where("vec_id = 1")).collect() == []


def test_query_matches_sql(spark, sf):
    assert compare(spark, connect(sf), sf, "op8_top_k") is None
