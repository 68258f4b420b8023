import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surecal.operators.analysis import (
    box_outliers,
    box_stats,
    group_sizes,
    lowess_trend,
    model_sizes,
    weighted_mean,
    with_group_size,
    with_model_size,
    zscore,
)
from surecal.operators.keys import join_parameters
from surecal.operators.rows import head_n, with_row_index


def metric_frame(seed=9, n=60):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "dataset": rng.choice(["d1", "d2", "d3"], n), "prompt": rng.choice(["p", "q"], n),
        "model_size": rng.choice([8, 37, 70, 200], n), "ece": rng.random(n), "brier_score": rng.random(n) ** 3,
    })


def test_zscore_and_weights(spark):
    f = pd.concat([metric_frame(), pd.DataFrame({"dataset": ["solo"], "prompt": ["p"], "model_size": [8], "ece": [0.2], "brier_score": [0.1]})])
    df = with_group_size(zscore(spark.createDataFrame(f), ["ece", "brier_score"]))
    got = df.orderBy("dataset", "ece").toPandas()
    want = f.sort_values(["dataset", "ece"]).assign(z=np.nan, w=0)
    for name in set(want.dataset):
        values = [v for d, v in zip(want.dataset, want.ece) if d == name]
        mean, n = sum(values) / len(values), len(values)
        spread = (sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5 if n > 1 else np.nan
        here = want.dataset == name
        want.loc[here, "z"] = [(v - mean) / spread for v in values]
        want.loc[here, "w"] = n
    np.testing.assert_allclose(got.ece_norm.astype(float), want.z, atol=1e-12)
    assert got.dataset_weight.tolist() == want.w.tolist()
    agg = weighted_mean(df, "ece", "dataset_weight", out="weighted_ece").toPandas().set_index("model_size")
    for size, part in want.groupby("model_size"):
        assert agg.weighted_ece[size] == pytest.approx(np.average(part.ece, weights=part.w))
    assert {r["dataset"]: r["n"] for r in group_sizes(df).collect()} == f.groupby("dataset").size().to_dict()


def test_constant_group_has_no_score(spark):
    df = spark.createDataFrame([("d", 0.5), ("d", 0.5)], "dataset string, ece double")
    assert [r["ece_norm"] for r in zscore(df, ["ece"]).collect()] == [None, None]


def test_missing_value_poisons_weighted_mean(spark):
    df = spark.createDataFrame([(8, 0.5, 1), (8, None, 1), (70, 0.25, 2)], "model_size int, ece double, w int")
    got = {r["model_size"]: r["weighted"] for r in weighted_mean(df, "ece", "w").collect()}
    assert got == {8: None, 70: 0.25}


def test_model_size_lookup(spark):
    df = spark.createDataFrame([("gpt-4o", 1), ("DeepSeek-V3", 2)], "model string, k int")
    got = {r["model"]: r["model_size"] for r in with_model_size(df, model_sizes(spark)).collect()}
    assert got == {"gpt-4o": 200, "DeepSeek-V3": 37}
    bad = spark.createDataFrame([("other", 1)], "model string, k int")
    with pytest.raises(Exception, match="no size for model other"):
        with_model_size(bad, model_sizes(spark)).collect()


def test_box_stats(spark):
    f = metric_frame(n=200)
    df = spark.createDataFrame(f)
    got = box_stats(df, "brier_score").toPandas().set_index("model_size")
    outliers = box_outliers(df, "brier_score").toPandas()
    for size, part in f.groupby("model_size"):
        x = part.brier_score
        q1, med, q3 = np.percentile(x, [25, 50, 75])
        reach = 1.5 * (q3 - q1)
        inside = x[(x >= q1 - reach) & (x <= q3 + reach)]
        row = got.loc[size]
        np.testing.assert_allclose(
            [row.q1, row["median"], row.q3, row.whisker_lo, row.whisker_hi],
            [q1, med, q3, inside.min(), inside.max()], atol=1e-14)
        assert row.n == len(x) and row.n_outliers == len(x) - len(inside)
        assert sorted(outliers[outliers.model_size == size].brier_score) == sorted(set(x) - set(inside))


def brute_lowess(x, y, frac=2 / 3, it=3):
    """Row by row: k nearest rows, tricube distances, bisquare residual weights."""
    n = len(x)
    k = max(1, int(frac * n + 1e-10))
    robust = np.ones(n)
    for step in range(it + 1):
        fit = np.empty(n)
        for i in range(n):
            d = np.abs(x - x[i])
            r = np.sort(d)[k - 1]
            u = np.where(d == 0, 0.0, d / r if r > 0 else np.inf)
            w = np.where(u >= 0.999, 0.0, np.where(u <= 0.001, 1.0, (1 - u ** 3) ** 3)) * robust
            w = w / w.sum()
            mx = (w * x).sum()
            var = max((w * (x - mx) ** 2).sum(), 1e-12)
            fit[i] = (w * (1 + (x[i] - mx) * (x - mx) / var) * y).sum()
        if step == it:
            return fit
        res = np.abs(y - fit)
        u = res / (6 * np.median(res))
        robust = np.where(u >= 0.999, 0.0, np.where(u <= 0.001, 1.0, (1 - u ** 2) ** 2))


def test_lowess(spark):
    rng = np.random.default_rng(2)
    f = pd.DataFrame({"model_size": rng.choice([8, 20, 37, 70, 120, 200], 80), "prompt": rng.choice(["p", "q"], 80)})
    f["ece"] = np.sin(f.model_size / 60) + rng.standard_t(2, 80) * 0.2
    got = lowess_trend(spark.createDataFrame(f), "model_size", "ece", ["prompt"]).toPandas()
    for prompt, part in f.groupby("prompt"):
        fit = brute_lowess(part.model_size.to_numpy(float), part.ece.to_numpy())
        want = dict(zip(part.model_size, fit))
        have = got[got.prompt == prompt]
        assert len(have) == len(want)
        for r in have.itertuples():
            assert r.fit == pytest.approx(want[r.model_size], abs=1e-8)


def test_row_index_and_head(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(13)
    keys = sorted(r["k"] for r in df.collect())
    got = {r["index"]: r["k"] for r in with_row_index(df, ["k"]).collect()}
    assert [got[i] for i in range(5000)] == keys
    assert sorted(r["k"] for r in head_n(df, ["k"], 10).collect()) == keys[:10]
    assert head_n(df, ["k"], None).count() == 5000


def test_both_joins_take_the_same_rows(spark):
    """Broadcast or shuffled: maps, repeated rows, missing keys and unknown groups."""
    rows = [("a", {"k": 1}, 0.9)] * 50 + [(None, {"k": 2}, 0.5), ("b", None, 0.1), ("c", {}, 0.2)]
    df = spark.createDataFrame(rows, "g string, m map<string,int>, p double")
    fitted = spark.createDataFrame([("a", 1.0, [1, 2]), (None, 2.0, None), ("b", 3.0, [])], "g string, v double, l array<int>")
    got = [
        sorted(map(str, join_parameters(df, fitted, ["g"], 100, limit).collect())) for limit in (1_000, 10)
    ]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_head_by_counting(spark, monkeypatch):
    from surecal.operators import rows

    monkeypatch.setattr(rows, "MERGED_ROWS", 20)
    monkeypatch.setattr(rows, "PROBES", 5)
    rng = np.random.default_rng(4)
    data = [(int(v) if v > 2 else None, str(i % 3), i) for i, v in enumerate(rng.integers(0, 400, 1500))]
    data += [(7, "x", 9000 + i) for i in range(700)]
    df = spark.createDataFrame(data, "a int, b string, c int").repartition(9)
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (21, 300, 800, 1499, 2200, 5000):
        got = [tuple(r) for r in head_n(df, ["a", "b"], n).collect()]
        assert len(set(got)) == min(n, len(data))
        assert sorted((str(r[:2]) for r in got)) == sorted(str(r[:2]) for r in ordered[:n])
    same = spark.createDataFrame([(1, i) for i in range(500)], "a int, i int")
    assert head_n(same, ["a"], 100).count() == 100
    assert head_n(same.limit(0), ["a"], 100).collect() == []


@pytest.mark.parametrize("iterations", [0, 2])
def test_trend_of_many_distinct_places(spark, iterations):
    rng = np.random.default_rng(8)
    xs = np.r_[rng.uniform(0, 10, 700), rng.exponential(1.0, 200)]
    ys = np.sin(xs) + rng.normal(size=len(xs)) * 0.1 + (rng.random(len(xs)) < 0.02) * 20
    rows = [("a", float(a), float(b)) for a, b in zip(xs, ys)] + [("b", float(i), float(2 * i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, x double, y double")

    def trend(**settings):
        found = lowess_trend(df, "x", "y", ["g"], frac=0.2, iterations=iterations, **settings).collect()
        return {(r.g, r.x): r.fit for r in found}

    direct, near = trend(), trend(cells=300, anchors=60)
    assert set(direct) == set(near) and len(direct) == len(rows)
    gap = np.array([abs(direct[k] - near[k]) for k in direct])
    # The curve itself spans 2; neighbourhoods are a fifth of the rows.
    assert gap.max() < 0.1 and gap.mean() < 0.01
    for i in range(5):
        assert near["b", float(i)] == pytest.approx(2.0 * i, abs=1e-6)


def test_trend_of_a_group_of_any_size(spark):
    df = spark.range(200_000).selectExpr("id / 20000.0d as x", "sin(id / 20000.0d) + (id % 7 - 3) * 0.01 as y")
    found = lowess_trend(df, "x", "y", frac=0.02, iterations=1, cells=1000, anchors=200)
    off = found.agg(F.max(F.abs(F.col("fit") - F.sin("x"))), F.count("fit")).first()
    assert off[0] < 0.01 and off[1] == 200_000
