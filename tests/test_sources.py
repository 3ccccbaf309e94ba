"""Sources and sinks: raw dialogue CSV (quoted newlines, optional type, positional ids), split documents,
selected-parameter documents with defaults."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from parley.operators import features as feat
from parley.sources import splits as SP
from parley.sources import tables as src

from .conftest import SF001


def test_raw_csv_roundtrip_gives_same_features(spark):
    raw = src.decorated_threads(spark, SF001).orderBy("orig_index")
    pdf = raw.select("dialogue", "label").toPandas()
    pdf.loc[0, "dialogue"] = 'caller: say "hi"\nreceiver: ok'  # doubled quotes and a newline inside a field
    folder = tempfile.mkdtemp(prefix="parley-csv-")
    path = os.path.join(folder, "raw.csv")
    pdf.to_csv(path, index=False)
    back = src.read_raw_dialogues(spark, path)
    assert back.count() == len(pdf)
    assert back.where(F.col("type").isNotNull()).count() == 0  # optional column absent -> NULL
    first = back.where("orig_index = 0").first()
    assert first.dialogue == 'caller: say "hi"\nreceiver: ok'
    got = feat.thread_features(back).where("orig_index = 0").first()
    assert got.turn_count == 2
    ids = sorted(r.orig_index for r in back.select("orig_index").collect())
    assert ids == list(range(len(pdf)))


def test_split_json_roundtrip_and_legacy_reader(spark):
    from parley.operators import split as S
    from parley.session import ensure_checkpoint_dir

    feats = feat.thread_features(src.decorated_threads(spark, SF001))
    split = S.stratified_split(feats)
    path = ensure_checkpoint_dir(spark).rstrip("/") + "/test-split"
    SP.write_split_json(split, path)
    back = SP.read_split_json(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, split.collect()))
    summary = spark.read.json(f"{path}/summary").first()
    assert summary.total_rows == 20 and summary.train_size + summary.test_size_rows == 20

    legacy = os.path.join(tempfile.mkdtemp(prefix="parley-split-"), "split_indices.json")
    with open(legacy, "w") as fh:
        json.dump({"seed": 42, "train_original_indices": [0, 2, 3], "test_original_indices": [1]}, fh, indent=4)
    rel = {(r.orig_index, r.part) for r in SP.read_legacy_split(spark, legacy).collect()}
    assert rel == {(0, "train"), (2, "train"), (3, "train"), (1, "test")}


def test_selected_params_with_defaults(spark):
    doc = {
        "selection_metric": "f1",
        "selected_models": {
            "Logistic Regression": {"best_params": {"model__C": 0.1, "model__class_weight": None, "model__l1_ratio": 1.0}},
            "Decision Tree": {"best_params": {"criterion": "entropy", "max_depth": 5}},
        },
    }
    path = os.path.join(tempfile.mkdtemp(prefix="parley-params-"), "selected.json")
    with open(path, "w") as fh:
        json.dump(doc, fh)
    long = SP.read_selected_params(spark, path)
    full = {(r.model, r.param): r.value for r in SP.hyperparams_with_defaults(long).collect()}
    assert full[("Logistic Regression", "C")] == "0.1"
    assert full[("Logistic Regression", "l1_ratio")] == "1.0"
    assert full[("Decision Tree", "criterion")] == "entropy"
    assert full[("Decision Tree", "min_samples_leaf")] == "1"  # default filled in
    empty = spark.createDataFrame([], "model string, param string, value string")
    defaults = {(r.model, r.param): r.value for r in SP.hyperparams_with_defaults(empty).collect()}
    assert defaults[("Logistic Regression", "C")] == "1.0" and defaults[("Decision Tree", "criterion")] == "gini"
