"""Joins of many rows with a few rows of a group: the small side is broadcast, so that a group's rows never meet in one task."""

import contextlib

import pytest
from pyspark.sql import functions as F

from parley.operators import thresholds as T
from parley.operators import tree as TR


@pytest.fixture
def unhinted(spark):
    """Nothing is broadcast for its size, as with tables whose size Spark can't tell."""
    with contextlib.ExitStack() as undo:
        for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
            undo.callback(spark.conf.set, key, spark.conf.get(key))
            spark.conf.set(key, value)
        yield spark


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_node_are_not_gathered(unhinted):
    rows = unhinted.createDataFrame([("r", "n", float(i % 7), int(i % 7 > 2), 1) for i in range(70)], "run string, node string, a double, y int, cnt long")
    stats = rows.groupBy("run", "node").agg(F.sum("cnt").alias("n_node"), F.sum("y").alias("c1_node")).select(
        "*", F.lit(1.0).alias("cw0"), F.lit(1.0).alias("cw1"), F.lit("gini").alias("criterion"), F.lit(1).alias("msl")
    )
    best = TR.best_splits(rows, stats, ["a"], n_buckets=4)
    joins = [line for line in _plan(best).split("\n") if "SortMergeJoin" in line]
    assert all("bk#" in line for line in joins), joins  # only totals of buckets are met by key
    assert [(r.threshold, r.n_left, r.n_right) for r in best.collect()] == [(2.5, 30, 40)]


def test_scores_of_a_model_are_not_gathered(unhinted):
    scores = unhinted.createDataFrame([("m", i, i / 10) for i in range(10)] + [(None, 10, 0.5), ("other", 11, 0.5)], "model string, id int, p double")
    bands = unhinted.createDataFrame([("m", "Low", 0.0, 0.4), ("m", "High", 0.4, 1.01)], "model string, risk_band string, probability_min double, probability_max_exclusive double")
    placed = T.assign_band(scores, bands, "p", ["model"])
    assert "SortMergeJoin" not in _plan(placed)
    assert {r.id: r.risk_band for r in placed.collect()} == {**{i: "Low" if i < 4 else "High" for i in range(10)}, 10: None, 11: None}
