import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surecal.functions.sequences import interpolate
from surecal.operators.curves import (
    curve_of_points,
    equal_frequency_curve,
    mean_curve,
    reliability_bars,
)


def runs_frame(seed=3):
    rng = np.random.default_rng(seed)
    p = rng.beta(2, 1, 900).round(3)
    return pd.DataFrame({
        "y_prob": p, "y_true": (rng.random(900) < p).astype(int),
        "run": rng.choice(["r1", "r2", "r3"], 900), "g": rng.choice(["a", "b"], 900),
    })


def qcut_curve(part, n_bins):
    bins = pd.qcut(part.y_prob, n_bins, labels=False, duplicates="drop")
    s = part.groupby(bins).agg(c=("y_prob", "mean"), y=("y_true", "mean"))
    return s.c.to_numpy(), s.y.to_numpy()


def test_interpolate_matches_numpy(spark):
    rng = np.random.default_rng(0)
    xs, ys = np.sort(rng.random(23)).tolist(), rng.random(23).tolist()
    q = [-1.0, 2.0, *xs, *rng.random(50).tolist()]
    df = spark.createDataFrame([(float(v), xs, ys) for v in q], "x double, xs array<double>, ys array<double>")
    got = [r[0] for r in df.select(interpolate("x", "xs", "ys")).collect()]
    np.testing.assert_allclose(got, np.interp(q, xs, ys), atol=1e-15)
    none = spark.createDataFrame([(0.5, [], [])], df.schema).select(interpolate("x", "xs", "ys"))
    assert none.first()[0] is None


def test_bars(spark):
    f = runs_frame()
    got = reliability_bars(spark.createDataFrame(f), by=["g"]).toPandas()
    for _, part in got.groupby("g"):
        n = part.n.to_numpy()
        np.testing.assert_allclose(part.shade, (n - n.min()) / (n.max() - n.min() + 1e-8))
        ok = part.std_y.notna()
        np.testing.assert_allclose(part.err[ok], part.std_y[ok] / (part.n[ok] + 1e-8))
    plain = reliability_bars(spark.createDataFrame(f), eps=0.0).toPandas()
    assert plain.shade.min() == 0.0 and plain.shade.max() == 1.0


@pytest.mark.parametrize("band", [None, "std", "stderr", "minmax"])
def test_mean_curve(spark, band):
    f = runs_frame()
    got = mean_curve(spark.createDataFrame(f), "run", by=["g"], n_bins=7, error_band=band).toPandas()
    for g, part in f.groupby("g"):
        curves = [qcut_curve(r, 7) for _, r in part.groupby("run")]
        grid = np.linspace(min(c[0].min() for c in curves), max(c[0].max() for c in curves), 100)
        ys = np.array([np.interp(grid, *c) for c in curves])
        have = got[got.g == g].sort_values("i")
        np.testing.assert_allclose(have.x, grid, atol=1e-14)
        np.testing.assert_allclose(have["mean"], ys.mean(0), atol=1e-12)
        if band is None:
            assert have.lo.isna().all()
            continue
        half = {"std": ys.std(0), "stderr": ys.std(0) / np.sqrt(3), "minmax": None}[band]
        lo, hi = (ys.min(0), ys.max(0)) if half is None else (ys.mean(0) - half, ys.mean(0) + half)
        np.testing.assert_allclose(have.lo, lo, atol=1e-9)
        np.testing.assert_allclose(have.hi, hi, atol=1e-9)
        assert (have.n_runs == 3).all()


def test_runs_without_bins_are_left_out(spark):
    df = spark.createDataFrame(
        [("a", 0.1, 0), ("a", 0.9, 1), ("b", 0.5, 1), ("b", 0.5, 0)],
        "run string, y_prob double, y_true int",
    )
    rows = mean_curve(df, "run", n_bins=2).collect()
    assert len(rows) == 100 and {r["n_runs"] for r in rows} == {1}


def test_bad_band(spark):
    with pytest.raises(ValueError):
        mean_curve(spark.range(1), "id", error_band="other")


@pytest.mark.parametrize("n_points", [5, 200])
def test_curve_of_points(spark, n_points):
    rng = np.random.default_rng(1)
    runs = {}
    for r in "abc":
        x = np.unique(np.r_[rng.random(300), np.linspace(0, 1, n_points)[1:4], -0.2, 1.3])
        runs[r] = (x, rng.random(len(x)))
    rows = [(r, float(a), float(b)) for r, (x, y) in runs.items() for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "run string, mean_conf double, mean_y double").repartition(6)
    got = curve_of_points(df, "run", n_points=n_points).orderBy("i").toPandas()
    grid = np.linspace(0, 1, n_points)
    ys = np.array([np.interp(grid, x, y) for x, y in runs.values()])
    np.testing.assert_allclose(got["mean"], ys.mean(0), atol=1e-12)
    np.testing.assert_allclose(got.hi, ys.mean(0) + ys.std(0) / np.sqrt(3), atol=1e-12)


def test_equal_frequency_curve(spark):
    f = runs_frame()
    got = equal_frequency_curve(spark.createDataFrame(f)).orderBy("bin").toPandas()
    c, y = qcut_curve(f, 10)
    np.testing.assert_allclose(got.mean_conf, c)
    np.testing.assert_allclose(got.mean_y, y)
    assert spark.createDataFrame(f).select(F.count("*")).first()[0] == 900
