import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surecal.operators.calibration import (
    fit_histogram,
    fit_isotonic,
    fit_platt,
    fit_temperature,
    histogram_scaling,
    isotonic_scaling,
    platt_scaling,
    temperature_scaling,
)
from surecal.operators import calibration, isotonic
from surecal.operators.isotonic import pool


def frame(seed=5, n=3000, decimals=None):
    rng = np.random.default_rng(seed)
    p = rng.beta(3, 1.2, n)
    p = p.round(decimals) if decimals else p
    return pd.DataFrame({
        "y_prob": p, "y_true": (rng.random(n) < 0.2 + 0.6 * p ** 2).astype(int),
        "g": rng.choice(["a", "b", None], n, p=[0.6, 0.3, 0.1]),
    })


def groups(f):
    yield "a", f[f.g == "a"]
    yield "b", f[f.g == "b"]
    yield None, f[f.g.isna()]


def brute_isotonic(p, y):
    x, inverse = np.unique(np.clip(p, 1e-6, 1 - 1e-6), return_inverse=True)
    s, n = np.bincount(inverse, weights=y), np.bincount(inverse).astype(float)
    cs, cn = np.r_[0, np.cumsum(s)], np.r_[0, np.cumsum(n)]
    fit = [
        max(min((cs[v] - cs[u]) / (cn[v] - cn[u]) for v in range(i + 1, len(x) + 1)) for u in range(i + 1))
        for i in range(len(x))
    ]
    return x, np.array(fit)


def test_pool_falls_back_to_blocks():
    mean = np.r_[np.arange(500.0), -1e9]
    starts, total, count = pool(np.r_[True, np.zeros(500, bool)], mean, np.ones(501))
    assert starts.tolist() == [0] and count.tolist() == [501.0]
    first = np.array([True, False, True, False])
    starts, total, _ = pool(first, np.array([3.0, 1.0, 0.0, 5.0]), np.ones(4))
    assert starts.tolist() == [0, 2, 3] and total.tolist() == [4.0, 0.0, 5.0]


def test_isotonic_golden(spark):
    rows = [(.1, 0), (.2, 1), (.2, 0), (.3, 0), (.4, 1), (.9, 1)]
    df = spark.createDataFrame(rows, "y_prob double, y_true int")
    test = spark.createDataFrame([(x,) for x in (.1, .2, .3, .4, .9, .35, .0, 1.0, None)], "y_prob double")
    got = [r["p_cal"] for r in isotonic_scaling(df, test).collect()]
    want = [0, 1 / 3, 1 / 3, 1, 1, (1 / 3 + 1) / 2, 0, 1]
    assert got[-1] is None
    np.testing.assert_allclose(got[:-1], want, atol=1e-12)


@pytest.mark.parametrize("decimals", [2, None])
@pytest.mark.parametrize("partitions", [1, 8])
@pytest.mark.parametrize("batch", [10000, 7])
def test_isotonic_matches_definition(spark, decimals, partitions, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    f = frame(n=500, decimals=decimals)
    df = spark.createDataFrame(f).repartition(partitions)
    out = isotonic_scaling(df, df, by=["g"]).toPandas()
    for g, part in groups(out):
        x, fit = brute_isotonic(part.y_prob, part.y_true)
        want = np.interp(np.clip(part.y_prob, 1e-6, 1 - 1e-6), x, fit)
        np.testing.assert_allclose(part.p_cal, want, atol=1e-9)
        assert part.p_cal.sum() == pytest.approx(part.y_true.sum(), abs=1e-6)


@pytest.fixture(autouse=True)
def default_batches(spark):
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_histogram_matches_pandas(spark):
    f = frame(decimals=None)
    f = f[(f.y_prob < 0.2) | (f.y_prob > 0.45)]
    test = spark.createDataFrame(pd.DataFrame({"y_prob": [0.0, 0.05, 0.25, 0.3, 0.44, 0.77, 1.0, 1.2, -1.0], "g": "a"}))
    got = histogram_scaling(spark.createDataFrame(f), test, by=["g"]).toPandas().p_cal
    part = f[f.g == "a"]
    edges = np.linspace(0, 1, 11)
    mid = (edges[1:] + edges[:-1]) / 2
    means = part.groupby(pd.cut(part.y_prob, edges, labels=False, include_lowest=True)).y_true.mean()
    filled = np.interp(mid, mid[means.index.astype(int)], means)
    index = pd.cut(pd.Series([0.0, 0.05, 0.25, 0.3, 0.44, 0.77, 1.0, 1.2, -1.0]), edges, labels=False, include_lowest=True)
    want = [np.nan if np.isnan(i) else filled[int(i)] for i in index]
    np.testing.assert_allclose(got.astype(float), want, atol=1e-12)


def test_histogram_with_one_known_bin_fills_zero(spark):
    train = spark.createDataFrame([(0.55, 1), (0.58, 0)], "y_prob double, y_true int")
    test = spark.createDataFrame([(0.55,), (0.1,)], "y_prob double")
    assert [r["p_cal"] for r in histogram_scaling(train, test).collect()] == [0.5, 0.0]


def newton(z, y, slope_only):
    """Newton with short steps, run to the end."""
    w = np.array([0.1, 0.0])
    for _ in range(400):
        s = 1 / (1 + np.exp(-(w[0] * z + w[1])))
        r, v = s - y, s * (1 - s)
        if slope_only:
            step = np.array([(r * z).sum() / (v * z * z).sum(), 0.0])
        else:
            h = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum()]])
            step = np.linalg.solve(h, np.array([(r * z).sum() + 1e-6 * w[0], r.sum()]))
        w -= step * min(1.0, 0.1 / max(np.abs(step).max(), 1e-300))
    return w


@pytest.mark.parametrize("decimals", [2, None])
def test_platt_and_temperature_match_newton(spark, decimals):
    f = frame(decimals=decimals)
    df = spark.createDataFrame(f).repartition(3)
    platt, temp = fit_platt(df, by=["g"]), fit_temperature(df, by=["g"])
    lines = {r["g"]: r for r in platt.parameters.collect()}
    temps = {r["g"]: r for r in temp.parameters.collect()}
    for g, part in groups(f):
        p = np.clip(part.y_prob.to_numpy(), 1e-6, 1 - 1e-6)
        z = np.log(p / (1 - p))
        a, b = newton(z, part.y_true.to_numpy(), False)
        assert lines[g]["a"] == pytest.approx(a, abs=1e-9)
        assert lines[g]["b"] == pytest.approx(b, abs=1e-9)
        assert lines[g]["converged"]
        t = 1 / newton(z, part.y_true.to_numpy(), True)[0]
        assert temps[g]["temperature"] == pytest.approx(t, abs=1e-8)
        assert temps[g]["converged"]
    out = platt.transform(df).groupBy("g").agg(F.avg("p_cal").alias("p"), F.avg("y_true").alias("y"))
    for r in out.collect():
        assert r["p"] == pytest.approx(r["y"], abs=1e-9)
    half = spark.createDataFrame([(0.5, "a"), (0.9, "a"), (0.2, "zz")], "y_prob double, g string")
    got = [r["p_cal"] for r in temp.transform(half).collect()]
    assert got[0] == 0.5 and got[1] > 0.5 and got[2] is None


def test_without_groups_and_return_model(spark):
    df = spark.createDataFrame(frame(n=400, decimals=2)[["y_prob", "y_true"]])
    out, model = temperature_scaling(df, df, return_model=True)
    assert out.count() == 400 and model.parameters.columns == ["temperature", "converged"]
    out, model = platt_scaling(df, df, return_model=True)
    assert out.where("p_cal between 0 and 1").count() == 400
    assert model.parameters.columns == ["a", "b", "converged"]


def test_degenerate_fits(spark):
    rows = (
        [("one_class", p, 1) for p in (0.6, 0.7, 0.9)]
        + [("reversed", 0.9, 0), ("reversed", 0.1, 1), ("reversed", 0.8, 0)]
        + [("half", 0.5, 0), ("half", 0.5, 1)]
    )
    df = spark.createDataFrame(rows, "g string, y_prob double, y_true int")
    t = {r["g"]: r for r in fit_temperature(df, by=["g"]).parameters.collect()}
    assert t["one_class"]["temperature"] == pytest.approx(1e-4) and not t["one_class"]["converged"]
    assert t["reversed"]["temperature"] == pytest.approx(1e4) and not t["reversed"]["converged"]
    assert t["half"]["temperature"] == 1.0
    lines = {r["g"]: r for r in fit_platt(df, by=["g"]).parameters.collect()}
    assert lines["one_class"]["a"] is None and not lines["one_class"]["converged"]


def test_unclipped_logit_of_one_is_an_error(spark):
    df = spark.createDataFrame([(1.0, 1), (0.2, 0)], "y_prob double, y_true int")
    with pytest.raises(Exception, match="no finite logit"):
        fit_platt(df, clipped=False)


def test_shuffled_join_gives_the_same(spark):
    f = frame(n=800, decimals=2)
    df = spark.createDataFrame(f)
    model = fit_histogram(df, by=["g"])
    wide = model.transform(df).orderBy("g", "y_prob", "y_true").toPandas()
    from dataclasses import replace

    shuffled = replace(model, broadcast_bytes=0).transform(df)
    assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
    pd.testing.assert_frame_equal(
        wide, shuffled.orderBy("g", "y_prob", "y_true").toPandas()
    )


def flat_batches(rows, step=10_000):
    """Sorted scores of one key, all with label 0."""
    for at in range(0, rows, step):
        lo = np.arange(at, min(rows, at + step), dtype=float)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * len(lo), pa.int64()), pa.array([7] * len(lo), pa.int64()), pa.array(lo), pa.array(lo),
             pa.array(np.zeros(len(lo))), pa.array(np.ones(len(lo)))],
            names=["_g", "_k", "lo", "hi", "total", "count"],
        )


def test_a_flat_stretch_is_one_block():
    began = time.perf_counter()
    out = list(isotonic.pool_batches(flat_batches(3_200_000)))
    blocks = [b for batch in out for b in batch.to_pylist()]
    assert len(blocks) == 1 and (blocks[0]["lo"], blocks[0]["hi"], blocks[0]["count"]) == (0.0, 3_199_999.0, 3.2e6)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("step", [1, 7, 50, 5_000])
def test_batches_pool_as_one(step):
    rng = np.random.default_rng(step)
    keys = np.sort(rng.integers(0, 3, 3_000))
    lo = np.arange(3_000, dtype=float)
    total, count = rng.random(3_000) + lo / 500 - 4 * (lo > 2_500), rng.integers(1, 4, 3_000).astype(float)

    def batches(step):
        for at in range(0, 3_000, step):
            s = slice(at, at + step)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[s]), pa.array(keys[s]), pa.array(lo[s]), pa.array(lo[s]), pa.array(total[s]), pa.array(count[s])],
                names=["_g", "_k", "lo", "hi", "total", "count"],
            )

    def pooled(step):
        return [(r["_k"], r["lo"], r["hi"], round(r["total"], 9), r["count"])
                for b in isotonic.pool_batches(batches(step)) for r in b.to_pylist()]

    assert pooled(step) == pooled(3_000)


def test_one_class_has_two_knots(spark):
    df = spark.range(0, 5_000).select((F.col("id") / 5_000).alias("y_prob"), F.lit(0).alias("y_true"))
    model = calibration.fit_isotonic(df)
    assert model.parameters.count() == 2
