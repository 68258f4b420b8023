import numpy as np
import pytest

from surecal.operators import calibration
from surecal.operators.interpolation import interpolate_rows
from surecal.operators.isotonic import isotonic_blocks
from surecal.functions.probability import number


def pooled(x, y):
    """Fit at each distinct x by merging neighbours, one after another."""
    xs = np.unique(x)
    blocks = []
    for v in xs:
        blocks.append([y[x == v].sum(), (x == v).sum(), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return xs, np.repeat([s / n for s, n, _ in blocks], [k for _, _, k in blocks])


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    knots, asked, want = [], [], {}
    for g, size in (("a", 400), ("b", 1), (None, 30), ("few", 2)):
        xs = np.unique(np.r_[rng.uniform(-3, 3, size), rng.uniform(0.4, 0.4001, size // 3), [1e9, -1e9][: size // 100]])
        ys = rng.normal(size=len(xs))
        knots += [(g, float(a), float(b)) for a, b in zip(xs, ys)]
        at = np.r_[rng.uniform(-4, 4, 200), xs[:20], [2e9, -2e9, 0.0, 1.0], np.repeat(0.5, 100)]
        for i, v in enumerate(at):
            asked.append((f"{g}{i}", g, float(v)))
            want[f"{g}{i}"] = float(np.interp(v, xs, ys))
    asked += [("none", "a", None), ("nan", "a", float("nan")), ("unknown", "z", 0.5)]
    knots += [("a", None, 1.0), ("a", 0.1, None)]
    df = spark.createDataFrame(asked, "id string, g string, x double")
    k = spark.createDataFrame(knots, "g string, knot_x double, knot_y double")
    got = {r.id: r.y for r in interpolate_rows(df, k, by=["g"]).collect()}
    assert len(got) == len(asked)
    for i, v in got.items():
        assert (v is None) == (i in ("none", "nan", "unknown"))
        if v is not None:
            assert v == pytest.approx(want[i], rel=1e-9, abs=1e-9), i


def test_no_knots_and_no_rows(spark):
    k = spark.createDataFrame([], "knot_x double, knot_y double")
    df = spark.createDataFrame([(1.0,)], "x double")
    assert interpolate_rows(df, k).first().y is None
    assert interpolate_rows(df.limit(0), k).collect() == []


@pytest.mark.parametrize("noise", [0.0, 1e-4, 0.05, 2.0])
def test_isotonic_of_continuous_labels(spark, noise):
    rng = np.random.default_rng(7)
    x = np.r_[rng.uniform(0.001, 0.999, 3000), np.repeat(0.25, 500), rng.beta(0.2, 0.2, 500).clip(1e-9, 1 - 1e-9)]
    y = x + rng.normal(size=len(x)) * noise + np.where((x > 0.4) & (x < 0.6), 0.5 - x, 0) * (noise > 1)
    xs, fit = pooled(x, y)
    df = spark.createDataFrame([(float(a), float(b), i % 2) for i, (a, b) in enumerate(zip(x, y))], "p double, y double, g int")
    blocks = sorted((r.lo, r.hi, r.total / r["count"]) for r in isotonic_blocks(df, "y", number("p"), []).collect())
    got = np.concatenate([np.repeat(m, ((xs >= lo) & (xs <= hi)).sum()) for lo, hi, m in blocks])
    assert len(got) == len(fit) and np.allclose(got, fit, rtol=1e-9, atol=1e-9)
    assert all(a[2] < b[2] for a, b in zip(blocks, blocks[1:]))


def test_both_ways_of_a_fitted_transform(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(p), float(p * p + rng.normal() * 0.01)) for g in ("a", "b") for p in rng.uniform(0, 1, 800)]
    train = spark.createDataFrame(rows, "g string, y_prob double, y_true double")
    test = spark.createDataFrame(
        [(g, float(p)) for g in ("a", "b", "c") for p in rng.uniform(-0.5, 1.5, 300)] + [("a", None)], "g string, y_prob double")
    model = calibration.fit_isotonic(train, by=["g"], clipped=False)
    assert model.most > 20
    short = sorted(map(str, model.transform(test).collect()))
    many = calibration.KnotCalibrator(model.parameters, model.by, model.score, model.most, model.size, array_knots=0)
    assert len(short) == 901 and [r.split("p_cal=")[1][:12] for r in sorted(map(str, many.transform(test).collect()))] == [
        r.split("p_cal=")[1][:12] for r in short]
