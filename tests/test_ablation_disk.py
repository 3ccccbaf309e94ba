"""The ablation holds the scores of one model and feature set at a time, and ranks travel without their hashes."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from parley.operators import split as S
from parley.plans import q_fixed
from parley.session import ensure_checkpoint_dir

ROWS = 20_000


def _bytes(top):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def test_scores_of_all_items_are_never_kept_together(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, i % 97, i % 13, 1, float(rng.randint(1, 50)), 900 + rng.random() * 9e4, rng.randint(0, 10) / 100, rng.randint(0, 8) / 100, rng.choice("ANR")) for i in range(ROWS)]
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = ensure_checkpoint_dir(spark).removeprefix("file:")
    before, seen, cut = _bytes(kept), [], q_fixed.cut_lineage

    def watched(df):
        out = cut(df)
        seen.append(_bytes(kept) - before)
        return out

    monkeypatch.setattr(q_fixed, "cut_lineage", watched)
    drops = q_fixed.q_largest_f1_drop(spark, str(tmp_path)).collect()
    assert sorted(r.model for r in drops) == ["model_a", "model_b"]
    assert max(seen) < ROWS * 60  # the rows and one item's scores; ten of them take 130 bytes a row and more
    assert _bytes(kept) - before < ROWS * 10  # and none of them stays


def test_ranks_travel_without_their_hashes(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("orig_index"), (F.col("id") % 2).alias("thread_label"), F.rand(1).alias("x"))
    folds = S.with_folds(rows, 5)
    plan = folds._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = next(i for i, line in enumerate(plan) if "REPARTITION_BY_COL" in line)
    source = next(i for i, line in enumerate(plan) if i > dealt and "Range" in line)
    assert not any("md5" in line for line in plan[dealt + 1 : source] if "Filter" not in line)
    want = {}
    for y in (0, 1):
        ids = sorted((str(i) for i in range(y, 500, 2)), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
        want |= {i: n % 5 for n, i in enumerate(ids)}
    assert {r.orig_index: r.fold for r in folds.collect()} == want
