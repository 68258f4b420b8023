import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surecal.functions.binning import Bins
from surecal.operators import bins
from surecal.operators.bins import bin_stats, equal_frequency_bin_stats
from surecal.operators.running import counted, exact_quantiles, running_totals

EDGE_CASES = [
    (0.0, "0.000-0.100"), (0.1, "0.000-0.100"), (0.2, "0.100-0.200"), (0.3, "0.200-0.300"),
    (0.6, "0.500-0.600"), (0.7, "0.600-0.700"), (1.0, "0.900-1.000"),
    (-0.01, None), (1.01, None), (float("nan"), None), (None, None),
]


def test_edges_are_right_closed(spark):
    df = spark.createDataFrame([(p,) for p, _ in EDGE_CASES], "p double")
    bins = Bins.of()
    from surecal.functions.probability import number

    got = [r[0] for r in df.select(bins.index_of(number("p"))).collect()]
    assert [None if i is None else bins.labels[i] for i in got] == [b for _, b in EDGE_CASES]


@pytest.mark.parametrize("edges", [[0.5], [[0, 1], [1, 2]], [0, 0, 1], [1, 0], [0, 0.0001, 0.0002, 1]])
def test_bad_edges(edges):
    with pytest.raises(ValueError):
        Bins.of(edges)


def test_missing_label_counts_only_in_mean_conf(spark):
    df = spark.createDataFrame([(0.05, 1), (0.06, None)], "y_prob double, y_true int")
    rows = bin_stats(df).collect()
    assert len(rows) == 10
    first = rows[0]
    assert (first["n"], first["mean_y"], first["std_y"]) == (1, 1.0, None)
    assert first["mean_conf"] == pytest.approx(0.055)
    assert rows[5]["n"] == 0 and rows[5]["mean_y"] is None


def described(rows):
    """Count of labels, mean and ddof-1 deviation of them, mean of all probabilities."""
    p, y = [r[0] for r in rows], [r[1] for r in rows]
    labels = [v for v in y if v == v]
    n = len(labels)
    mean = sum(labels) / n if n else math.nan
    std = math.sqrt(sum((v - mean) ** 2 for v in labels) / (n - 1)) if n > 1 else math.nan
    return {"n": n, "mean_y": mean, "std_y": std, "mean_conf": sum(p) / len(p) if len(p) else math.nan}


def in_bins(part, edges):
    """(p, y) of each bin (a, b], the first one holding its left edge."""
    out = [[] for _ in edges[1:]]
    for p, y in zip(part.p, part.y):
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < p <= b or (i == 0 and p == a):
                out[i].append((p, y))
    return out


def equal_frequency_edges(p, n_bins):
    """Distinct interpolated quantiles: order statistics at fractions of n - 1."""
    v, edges = sorted(p), []
    for j in range(n_bins + 1):
        at = (len(v) - 1) * (j / n_bins)
        low, high = v[math.floor(at + 1e-9)], v[min(len(v) - 1, math.ceil(at - 1e-9))]
        q = low + (high - low) * (at - math.floor(at + 1e-9))
        if not edges or q > edges[-1]:
            edges.append(q)
    return edges


def random_frame(seed, n=2000, decimals=None):
    rng = np.random.default_rng(seed)
    p = rng.beta(5, 1.5, n)
    if decimals:
        p = p.round(decimals)
    y = (rng.random(n) < p).astype(float)
    y[rng.random(n) < 0.02] = np.nan
    return pd.DataFrame({"p": p, "y": y, "g": rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1])})


@pytest.mark.parametrize("decimals", [None, 2, 1])
@pytest.mark.parametrize("partitions", [1, 7])
def test_fixed_bins_match_loops(spark, decimals, partitions):
    frame = random_frame(1, decimals=decimals)
    df = spark.createDataFrame(frame).repartition(partitions)
    edges = [0.0, 0.2, 0.5, 0.55, 0.9, 1.0]
    got = bin_stats(df, "y", "p", ["g"], edges).toPandas()
    for g, part in frame.groupby(frame.g.fillna("none")):
        have = got[got.g.fillna("none") == g].sort_values("bin_idx")
        want = [described(rows) for rows in in_bins(part, edges)]
        assert have["n"].tolist() == [w["n"] for w in want]
        for c in ["mean_y", "std_y", "mean_conf"]:
            np.testing.assert_allclose(have[c].astype(float), [w[c] for w in want], rtol=1e-9)


@pytest.mark.parametrize("decimals", [None, 2, 1])
@pytest.mark.parametrize("n_bins", [1, 4, 10, 37])
def test_equal_frequency_bins_match_loops(spark, decimals, n_bins):
    frame = random_frame(2, decimals=decimals)
    df = spark.createDataFrame(frame).repartition(5)
    got = equal_frequency_bin_stats(df, "y", "p", ["g"], n_bins).toPandas()
    for g, part in frame.groupby(frame.g.fillna("none")):
        have = got[got.g.fillna("none") == g].sort_values("bin")
        bins = in_bins(part, equal_frequency_edges(part.p, n_bins))
        full = [i for i, rows in enumerate(bins) if rows]
        assert have["bin"].tolist() == full
        want = [described(bins[i]) for i in full]
        assert have["n"].tolist() == [w["n"] for w in want]
        for c in ["mean_y", "std_y", "mean_conf"]:
            np.testing.assert_allclose(have[c].astype(float), [w[c] for w in want], rtol=1e-9, atol=1e-12)
        for c, end in [("start", min), ("end", max)]:
            assert have[c].tolist() == [end(p for p, _ in bins[i]) for i in full]
        np.testing.assert_allclose(have["width"], have["end"] - have["start"], atol=0)


# Values, bins asked for, and how many values each bin that comes out holds.
SMALL = [
    ([.1, .9, .9, .9, .9, 1.0], 4, {0: 5, 1: 1}),
    ([.5] * 5, 10, {}),
    ([.1, .2], 10, {0: 1, 9: 1}),
    ([.3], 3, {}),
    ([.1, .1, .1, .5], 10, {0: 3, 3: 1}),
    # Two thirds of 6 is a rounding error below 4: the edge lies just below 0.6.
    ([.1, .1, .1, .5, .6, .6, .9], 3, {0: 4, 1: 3}),
    ([0.0, 1e-300, 1e-10, 0.5, 1 - 1e-16, 1.0], 5, {0: 2, 1: 1, 2: 1, 3: 1, 4: 1}),
    ([-3.0, -1.0, 0.0, 2.0, 1e300], 4, {0: 2, 1: 1, 2: 1, 3: 1}),
]


@pytest.mark.parametrize("values,n_bins,want", SMALL)
def test_equal_frequency_bins_small(spark, values, n_bins, want):
    df = spark.createDataFrame([(v, 1) for v in values], "y_prob double, y_true int")
    assert {r["bin"]: r["n"] for r in equal_frequency_bin_stats(df, n_bins=n_bins).collect()} == want


def test_the_source_is_read_once(spark, tmp_path):
    spark.createDataFrame(random_frame(4)).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    stats = equal_frequency_bin_stats(source, "y", "p", ["g"])
    # What is left to run reads the written score table, not the source.
    assert not any("/t/" in f for f in stats.inputFiles())
    from surecal.operators.metrics import roc_auc

    ranked = roc_auc(source.where("y IS NOT NULL"), "y", "p", ["g"])
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("FileScan parquet") == 1 or final.count("ReusedExchange") >= 1


def test_exact_quantiles_match_numpy(spark):
    frame = random_frame(3, n=997)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame(frame)
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "p", probs, ["g"]).collect()}
    for g, q in got.items():
        part = frame.p[frame.g.isna()] if g is None else frame.p[frame.g == g]
        assert q == np.quantile(part, probs).tolist()


def test_a_hot_group_is_not_one_task(spark):
    """Windows over scores are partitioned by bucket; the group alone holds buckets only."""
    df = spark.range(0, 20000).select(F.rand(1).alias("v"), F.lit("hot").alias("g"))
    ranked = running_totals(counted(df, "v", ["g"]), "_v", ["n"])
    windows = re.findall(
        r"windowspecdefinition\(([^\[\]]*?)(?:, specified)",
        ranked._jdf.queryExecution().optimizedPlan().toString(),
    )
    over_scores = [w for w in windows if re.search(r"_v#\d+ ASC", w)]
    assert over_scores and all("_b0#" in w and "_b1#" in w for w in over_scores)
    assert ranked.count() == 20000
    assert ranked.agg(F.max(F.col("n_before") + F.col("n"))).first()[0] == 20000


def test_deviations_of_shifted_labels(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(size=600).round(2)
    y = 1e8 + rng.integers(0, 3, 600) + np.where(p > 0.5, 1e4, 0.0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "y_prob double, y_true double")
    for r in bins.equal_frequency_bin_stats(df, n_bins=4).collect():
        held = y[(p >= r.start) & (p <= r.end)]
        assert r.n == len(held) and r.std_y == pytest.approx(held.std(ddof=1), rel=1e-6)
        assert r.mean_y == pytest.approx(held.mean(), rel=1e-12)
    one = df.limit(1).unionByName(df.selectExpr("y_prob + 1", "cast(null as double)").toDF("y_prob", "y_true"))
    assert {r.std_y for r in bins.equal_frequency_bin_stats(one, n_bins=2).collect()} == {None}


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_approximate_edges_are_near_in_rank(spark, accuracy):
    rng = np.random.default_rng(6)
    values = {"a": rng.normal(size=4000), "b": np.r_[np.zeros(500), rng.uniform(size=100)], "c": np.array([2.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "g string, y_prob double").repartition(7)
    got = {r.g: r.edges for r in bins.approximate_edges(df, by=["g"], n_bins=8, accuracy=accuracy).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, edges in got.items():
        v = np.sort(values[g])
        assert edges[0] == v[0] and edges[-1] == v[-1] and edges == sorted(edges) and set(edges) <= set(v.tolist())
        for j, e in enumerate(edges):
            low, high = np.searchsorted(v, e, "left"), np.searchsorted(v, e, "right")
            slack = len(v) / accuracy + 1
            assert low - slack <= j * len(v) / 8 <= high + slack
    stats = bins.equal_frequency_bin_stats(df.withColumn("y_true", F.lit(1)), by=["g"], n_bins=8, accuracy=accuracy)
    assert {r.g: r.n for r in stats.groupBy("g").agg(F.sum("n").alias("n")).collect()} == {"a": 4000, "b": 600}
