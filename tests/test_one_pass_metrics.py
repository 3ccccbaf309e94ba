"""Fold metrics read their source once; running sums find their buckets whatever the number and place of bounds."""

import numpy as np
from pyspark.sql import functions as F

from parley.operators import metrics as M
from parley.operators.ordered import running_sums


def test_fold_metrics_read_their_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(i):
        seen.add(1)
        return None if i == 39 else (i * 7 % 20) / 20

    rows = spark.range(40).select((F.col("id") % 2).cast("int").alias("fold"), F.when(F.col("id") != 38, (F.col("id") % 3 == 0).cast("int")).alias("y"), F.udf(score, "double")("id").alias("p"))
    got = {r.fold: r for r in M.fold_metrics(rows, "y", "p", ["fold"]).collect()}
    assert seen.value == 40
    for fold in (0, 1):
        own = [(None if i == 38 else int(i % 3 == 0), None if i == 39 else (i * 7 % 20) / 20) for i in range(fold, 40, 2)]
        full = [(y, p) for y, p in own if y is not None and p is not None]
        assert abs(got[fold].accuracy - sum(y == (p >= 0.5) for y, p in full) / len(full)) < 1e-12
        assert abs(got[fold].brier_score - sum((p - y) ** 2 for y, p in full) / len(own)) < 1e-12
        known = [(y, -1.0 if p is None else p) for y, p in own if y is not None]  # a missing score is below all others
        pairs = [(p > q) + (p == q) / 2 for y, p in known if y for z, q in known if not z]
        assert abs(got[fold].roc_auc - sum(pairs) / len(pairs)) < 1e-12


def test_running_sums_of_any_number_of_buckets(spark):
    values = np.unique(np.round(np.random.default_rng(4).normal(0, 1, 300), 2))
    df = spark.createDataFrame([(g, float(v), i + 1) for g in ("a", "b") for i, v in enumerate(values[: 5 if g == "b" else None])], "g string, v double, n long")
    for n in (2, 7, 64):
        for descending in (False, True):
            got = {(r.g, r.v): r.cum_n for r in running_sums(df, ["g"], "v", ["n"], n_buckets=n, descending=descending).collect()}
            for g, last in (("a", len(values)), ("b", 5)):
                sums = np.cumsum(np.arange(1, last + 1)[::-1 if descending else 1])[::-1 if descending else 1]
                assert [got[g, float(v)] for v in values[:last]] == list(sums)
