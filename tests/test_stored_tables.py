"""Bucketed tables join without an exchange; the file-by-file profile equals a full pass and reads only new files."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import features as feat
from parley.operators import profile as P
from parley.operators import profile_parts as PP
from parley.operators import split as S
from parley.sources import buckets as B
from parley.sources import tables as src

from .conftest import SF001


def test_split_joins_of_bucketed_tables_have_no_exchange(spark):
    feats = feat.thread_features(src.decorated_threads(spark, SF001))
    split = S.stratified_split(feats)
    folder = tempfile.mkdtemp(prefix="parley-buckets-")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        f = B.write_bucketed(feats, "parley_features", f"{folder}/f", buckets=4)
        s = B.write_bucketed(split, "parley_split", f"{folder}/s", buckets=4)
        assert B.colocated(spark, "parley_features", "parley_split")
        for made, plain in ((S.select_part(f, s, "train"), S.select_part(feats, split, "train")), (S.heldout(f, s), S.heldout(feats, split))):
            assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(repr, made.select(*feats.columns).collect())) == sorted(map(repr, plain.select(*feats.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS parley_features")
        spark.sql("DROP TABLE IF EXISTS parley_split")


@pytest.mark.parametrize("rows,n", [(0, 1), (1, 1), (10, 1), (11, 2), (25, 4), (80, 8)])
def test_bucket_counts_are_powers_of_two(rows, n):
    assert B.bucket_count(rows, 10) == n


def test_profile_by_files_equals_a_full_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    folder, store = tempfile.mkdtemp(prefix="parley-parts-"), tempfile.mkdtemp(prefix="parley-states-") + "/states"
    rows = [(float(rng.normal(1e6, 3)), None if i % 7 == 0 else int(rng.integers(0, 9)), [None, "a", "b"][i % 3]) for i in range(400)]

    def write(name, of):
        spark.createDataFrame(of, "x double, y int, label string").coalesce(1).write.parquet(f"{folder}/{name}")

    read = []
    states = PP.states
    monkeypatch.setattr(PP, "states", lambda df, *a: read.append(df.inputFiles()) or states(df, *a))
    glob = f"{folder}/*/*.parquet"

    def check(all_rows):
        parts = PP.update(spark, glob, store, ["x", "y"], ["label"])
        got = {r["column"]: r for r in PP.merged(parts).collect()}
        full = spark.createDataFrame(all_rows, "x double, y int, label string")
        for r in full.select(*[F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in ("x", "y")]).collect():
            for c in ("x", "y"):
                assert got[c]["rows"] == len(all_rows) and got[c]["count"] == r[c]["count"] and got[c]["nulls"] == len(all_rows) - r[c]["count"]
                assert all(np.isclose(got[c][k], r[c][k], rtol=1e-9) for k in ("mean", "std", "min", "max"))
        want = {r["label"] or "": r["n"] for r in P.label_distribution(full, "label", "x").collect()}
        assert {r["label"]: r["n"] for r in PP.label_counts(parts, "label").collect()} == want

    write("one", rows[:150])
    write("two", rows[150:151])
    check(rows[:151])
    check(rows[:151])  # nothing new: nothing read
    write("three", rows[151:])
    check(rows)
    assert [len(r) for r in read] == [2, 1]
    for name in os.listdir(f"{folder}/two"):
        os.remove(f"{folder}/two/{name}")  # a file of this test's own
    check(rows[:150] + rows[151:])
    assert len(read) == 2
