import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surecal.operators.metrics import (
    accuracy,
    average_precision,
    brier_score,
    calculate_metrics,
    expected_calibration_error,
    negative_log_likelihood,
    roc_auc,
)

SIX = [(0.9, 1), (0.9, 0), (0.8, 1), (0.3, 0), (0.3, 1), (0.1, 0)]


def six(spark):
    return spark.createDataFrame(SIX, "y_prob double, y_true int")


def brute(p, y):
    """Definitions spelled out over pairs and thresholds."""
    p, y = np.asarray(p), np.asarray(y)
    pos, neg = p[y == 1], p[y == 0]
    auc = np.nan
    if len(pos) and len(neg):
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        chosen = p >= t
        recall = (y[chosen] == 1).sum() / max(1, (y == 1).sum())
        ap += (recall - last) * (y[chosen] == 1).mean()
        last = recall
    edges = np.linspace(0, 1, 11)
    k = np.searchsorted(edges, p, side="left")
    k = np.where(p == 0, 1, k)
    ok = (k > 0) & (k < 11)
    ece = sum(
        (ok & (k == b)).sum() * abs(p[ok & (k == b)].mean() - y[ok & (k == b)].mean())
        for b in range(1, 11) if (ok & (k == b)).any()
    ) / max(1, ok.sum())
    return {"roc_auc": auc, "average_precision": ap, "ece": ece,
            "brier_score": np.mean((p - y) ** 2), "accuracy": y.mean()}


def test_ranking_golden(spark):
    assert roc_auc(six(spark)).first()["roc_auc"] == pytest.approx(0.666667, abs=1e-6)
    ap = average_precision(six(spark)).first()["average_precision"]
    assert ap == pytest.approx(0.588889, abs=1e-6)


@pytest.mark.parametrize("decimals", [None, 2, 1])
@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_bundle_matches_definitions(spark, decimals, partitions):
    rng = np.random.default_rng(11)
    p = rng.beta(4, 1, 600)
    p = p.round(decimals) if decimals else p
    frame = pd.DataFrame({"y_prob": p, "y_true": (rng.random(600) < p ** 2).astype(int),
                          "g": rng.choice(list("ab") + [None], 600)})
    df = spark.createDataFrame(frame).repartition(partitions)
    got = calculate_metrics(df, by=["g"]).toPandas()
    assert len(got) == 3
    for row in got.itertuples():
        part = frame[frame.g.isna()] if row.g is None or row.g != row.g else frame[frame.g == row.g]
        want = brute(part.y_prob, part.y_true)
        for name, value in want.items():
            assert getattr(row, name) == pytest.approx(value, abs=1e-12), name
        one = calculate_metrics(df.where(F.col("g").eqNullSafe(part.g.iloc[0]))).first()
        for name in want:
            assert one[name] == pytest.approx(getattr(row, name), abs=1e-12)


def test_single_functions_agree_with_bundle(spark):
    df = six(spark)
    both = calculate_metrics(df).first()
    assert expected_calibration_error(df).first()["ece"] == pytest.approx(both["ece"], abs=1e-12)
    assert brier_score(df).first()["brier_score"] == pytest.approx(both["brier_score"], abs=1e-12)
    assert accuracy(df).first()["accuracy"] == both["accuracy"]
    assert roc_auc(df).first()["roc_auc"] == both["roc_auc"]
    assert average_precision(df).first()["average_precision"] == both["average_precision"]


def test_monotone_map_keeps_auc(spark):
    df = six(spark)
    moved = df.withColumn("y_prob", F.pow("y_prob", F.lit(3.0)) * 50 - 7)
    assert roc_auc(moved).first()["roc_auc"] == roc_auc(df).first()["roc_auc"]


DEGENERATE = {
    "one_class": ([(0.2, 1), (0.7, 1)], None, 1.0),
    "no_positive": ([(0.2, 0), (0.7, 0)], None, 0.0),
    "constant": ([(0.5, 1), (0.5, 0)], 0.5, 0.5),
    "one_row": ([(0.4, 1)], None, 1.0),
    "edges": ([(0.0, 0), (1.0, 1)], 1.0, 1.0),
}


@pytest.mark.parametrize("name", list(DEGENERATE))
def test_degenerate_groups(spark, name):
    rows, auc, ap = DEGENERATE[name]
    df = spark.createDataFrame([(name, *r) for r in rows], "g string, y_prob double, y_true int")
    got = calculate_metrics(df, by=["g"]).first()
    assert got["roc_auc"] == auc
    assert got["average_precision"] == ap
    assert 0.0 <= got["ece"] <= 1.0


def test_missing_and_out_of_range(spark):
    df = spark.createDataFrame(
        [(None, 1), (float("nan"), 0), (1.5, 1), (-0.5, 0)], "y_prob double, y_true int"
    )
    assert expected_calibration_error(df).first()["ece"] == 0.0
    assert calculate_metrics(df).first()["n"] == 2


def test_missing_labels_and_scores(spark):
    nan = float("nan")
    rows = [("r", 0.9, 1), ("r", 0.8, None), ("r", None, 1), ("r", nan, 0), ("r", 0.85, 0), ("r", 1.5, 1),
            ("none", None, 1), ("none", nan, 0), ("bare", 0.3, None), ("void", None, None)]
    df = spark.createDataFrame(rows, "g string, y_prob double, y_true int")
    both = {r.g: r for r in calculate_metrics(df, by=["g"]).collect()}
    assert {g: (r.n, r.n_rows) for g, r in both.items()} == {"r": (3, 6), "none": (0, 2), "bare": (0, 1), "void": (0, 1)}
    singles = {"ece": expected_calibration_error, "accuracy": accuracy, "brier_score": brier_score,
               "roc_auc": roc_auc, "average_precision": average_precision}
    for name, function in singles.items():
        kwargs = {"by": ["g"]}
        one = {r.g: r[name] for r in function(df, **kwargs).collect()}
        assert set(one) == set(both)
        for g, value in one.items():
            assert both[g][name] == (value if value is None else pytest.approx(value, abs=1e-12)), (name, g)
    assert both["r"].accuracy == pytest.approx(3 / 5) and both["none"].roc_auc is None
    # Bin 0.8-0.9 holds 0.9, 0.85 and (unlabelled) nothing more; 0.8 lies in the one below.
    assert both["r"].ece == pytest.approx(abs(0.875 - 0.5))


def test_other_labels_are_refused(spark):
    df = spark.createDataFrame([(0.5, 2)], "y_prob double, y_true int")
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        roc_auc(df).collect()


def test_nll(spark):
    p, y = np.array([r[0] for r in SIX]), np.array([r[1] for r in SIX])
    want = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert negative_log_likelihood(six(spark)).first()["nll"] == pytest.approx(want, abs=1e-12)
    z = np.log(p / (1 - p)) / np.exp(0.3)
    q = 1 / (1 + np.exp(-z))
    want = -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))
    got = negative_log_likelihood(six(spark), log_temperature=0.3).first()["nll"]
    assert got == pytest.approx(want, abs=1e-12)
