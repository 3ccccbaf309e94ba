"""Counts beyond 64-bit products, folds in place, sinks and presence checks."""

import json
import os
import tempfile
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from parley.operators import features as feat
from parley.operators import metrics as M
from parley.operators import quality as Q
from parley.operators import split as S
from parley.plans import q_metrics as QM
from parley.sources import sinks, splits
from parley.sources import tables as src

from .conftest import SF001, SF01


def test_auc_of_four_billion_rows_each(spark):
    n = 4_000_000_000
    counts = [("m", 0.1, 0, n // 2), ("m", 0.5, n // 2, n // 2), ("m", 0.9, n // 2, 0)]
    got = M.auc_of_counts(spark.createDataFrame(counts, "model string, p double, n_pos long, n_neg long"), "p", ["model"]).first()
    want = Fraction(n // 2) * (n // 2 + Fraction(n // 2, 2)) + Fraction(n // 2) * n
    assert got.n_pos == n and got.n_neg == n and got.roc_auc == float(want / (Fraction(n) * n))


def test_quotas_of_a_hundred_billion_rows(spark):
    counts = spark.createDataFrame([(0, 70_000_000_001), (1, 29_999_999_999)], "y int, n_c long")
    got = {r.y: r.quota for r in S.quotas_of(counts, "y").collect()}
    assert got == {0: 14_000_000_000, 1: 6_000_000_000} and sum(got.values()) == 20_000_000_000


def test_every_line_item_has_one_fold(spark):
    rows = QM.fold_scores(spark, SF01)
    li = src.table(spark, SF01, "lineitem").count()
    assert rows.count() == 2 * li and rows.select("id").distinct().count() == li
    sizes = [r.n for r in rows.where("model = 'quantity'").groupBy("y", "fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) < li
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()


def test_table_sinks_read_back(spark):
    path = tempfile.mkdtemp(prefix="parley-sinks-")
    raw = src.decorated_threads(spark, SF001)
    feats, turns = feat.thread_features(raw), feat.parse_turns(raw)
    sinks.write_table(feats, f"{path}/features")
    back = src.read_features(spark, f"{path}/features")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, feats.select(*back.columns).collect()))
    sinks.write_table(turns, f"{path}/turns", "parquet")
    assert sorted(map(tuple, spark.read.parquet(f"{path}/turns").collect()), key=repr) == sorted(map(tuple, turns.collect()), key=repr)
    metrics = M.confusion(feats.withColumn("pred", F.lit(1)), "thread_label", "pred")
    sinks.write_table(metrics, f"{path}/metrics")
    assert spark.read.csv(f"{path}/metrics", header=True, inferSchema=True).first() == metrics.first()
    sinks.write_table(feats.drop("turn_count"), f"{path}/short")
    with pytest.raises(ValueError):
        src.read_features(spark, f"{path}/short")


def test_document_sinks(spark):
    path = tempfile.mkdtemp(prefix="parley-docs-")
    chosen = spark.createDataFrame([("Decision Tree", '{"criterion": "gini", "max_depth": null}', 0.5)], "model string, best_params string, best_f1 double")
    sinks.write_selected_params(chosen, f"{path}/selected")
    long = splits.read_selected_params(spark, f"{path}/selected")
    full = {(r.model, r.param): r.value for r in splits.hyperparams_with_defaults(long).collect()}
    assert full["Decision Tree", "criterion"] == "gini" and full["Decision Tree", "min_samples_leaf"] == "1"
    from parley.operators.profile_json import dataset_profile

    raw = src.decorated_threads(spark, SF001)
    files = {"raw_data": f"{SF001}/conversations.parquet", "other": f"{SF001}/none.parquet"}
    sinks.write_profile(dataset_profile(raw, feat.parse_turns(raw), feat.thread_features(raw), files), f"{path}/profile")
    name = next(f for f in os.listdir(f"{path}/profile") if f.startswith("part-"))
    with open(f"{path}/profile/{name}") as f:
        doc = json.load(f)
    assert doc["input_files"]["raw_data"]["exists"] and doc["input_files"]["raw_data"]["size_bytes"] == os.path.getsize(files["raw_data"])
    assert doc["input_files"]["other"]["exists"] is False and doc["row_counts"]["raw_rows"] == 20


def test_explicit_null_parameter_stays(spark):
    given = spark.createDataFrame([("Decision Tree", "criterion", None)], "model string, param string, value string")
    full = {(r.model, r.param): r.value for r in splits.hyperparams_with_defaults(given).collect()}
    assert full["Decision Tree", "criterion"] is None and full["Logistic Regression", "C"] == "1.0"


def test_presence_checks(spark):
    results = Q.presence_checks(spark, f"{SF001}/conversations.parquet", f"{SF001}/none.parquet")
    assert [(r.check, r.status) for r in results.orderBy("check_order").collect()] == [("Parsed CSV exists", "PASS"), ("Feature CSV exists", "FAIL")]
    with pytest.raises(Exception):
        Q.raise_on_failure(results)
