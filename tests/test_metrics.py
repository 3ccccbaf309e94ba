"""Metrics against brute force and published arithmetic goldens."""

import numpy as np
from pyspark.sql import functions as F

from parley.functions.fmt import fixed
from parley.operators import metrics as M
from parley.operators import thresholds as T


def _brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg])


def test_auc_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.random(400), 2)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    got = M.roc_auc(df, "y", "p").first().roc_auc
    assert abs(got - _brute_auc(y, p)) < 1e-9


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.8)], "y int, p double")
    assert M.roc_auc(df, "y", "p").first().roc_auc is None


def test_confusion_golden(spark):
    rows = [(0, 0)] * 150 + [(0, 1)] * 10 + [(1, 0)] * 20 + [(1, 1)] * 140
    df = spark.createDataFrame(rows, "y int, pred int")
    r = M.classification_metrics(df, "y", "pred").first()
    assert (r.true_negative, r.false_positive, r.false_negative, r.true_positive) == (150, 10, 20, 140)
    assert r.accuracy == 0.90625 and abs(r.precision - 0.933333333) < 1e-8 and r.recall == 0.875
    assert abs(r.f1 - 0.9032258) < 1e-7


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    r = M.classification_metrics(df, "y", "pred").first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0


def test_grid_index_exact(spark):
    vals = [0.29, 0.57, 0.58, 0.05, 0.049999, 0.95, 0.99, 0.0, 1.0, 0.3 - 1e-17]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r.g for r in df.select(T.grid_index("p").alias("g")).collect()]
    want = []
    for v in vals:
        ks = [k for k in range(5, 96) if k / 100.0 <= v]
        want.append(max(ks) if ks else 4)
    assert got == want


def test_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    p = rng.random(300)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    sw = {round(r.threshold, 2): r for r in T.sweep(df, "y", "p").collect()}
    for k in (5, 29, 50, 57, 95):
        t = k / 100.0
        pred = p >= t
        assert sw[round(t, 2)].true_positive == int(((y == 1) & pred).sum())
        assert sw[round(t, 2)].false_positive == int(((y == 0) & pred).sum())


def test_fixed_point_is_half_even_on_exact_value(spark):
    vals = [0.90625, 0.12345, 0.00015, 2.5e-05, 0.88852838759, 1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(fixed("x", 4).alias("s")).collect()]
    assert got == [f"{v:.4f}" for v in vals]


def test_risk_bands_cover_unit_interval(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 500)
    p = np.clip(y * 0.4 + rng.random(500) * 0.6, 0, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    bands = T.risk_bands(T.sweep(df, "y", "p")).orderBy("probability_min").collect()
    assert [b.risk_band for b in bands] == ["Low", "Medium", "High"]
    assert bands[0].probability_min == 0.0 and bands[2].probability_max_exclusive == 1.01
    assert bands[0].probability_max_exclusive == bands[1].probability_min
    assert bands[1].probability_max_exclusive == bands[2].probability_min
    assigned = T.assign_band(df, T.risk_bands(T.sweep(df, "y", "p")), "p")
    assert assigned.where(F.col("risk_band").isNull()).count() == 0
