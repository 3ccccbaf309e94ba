"""Split and fold invariants; the bucketed rank equals a plain per-class row_number."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.operators import split as S
from parley.operators.ordered import global_rank
from parley.session import cut_lineage


def _data(spark, n=997):
    return spark.range(n).select(F.col("id").alias("orig_index"), (F.col("id") % 3 == 0).cast("int").alias("thread_label"))


def test_bucketed_rank_equals_global_row_number(spark):
    d = _data(spark)
    r = S.stratified_rank(d, "orig_index", "thread_label", 42, digits=2)
    w = Window.partitionBy("thread_label").orderBy(S.shuffle_key("orig_index", 42), "orig_index")
    ref = d.withColumn("ref", F.row_number().over(w))
    j = r.join(ref, ["orig_index", "thread_label"])
    assert j.where(F.col("rank") != F.col("ref")).count() == 0


def test_split_sizes_and_leakage(spark):
    d = _data(spark)
    sp = S.stratified_split(d)
    counts = {(r.part, r.thread_label): r.n for r in S.split_summary(sp).collect()}
    n_test = counts[("test", 0)] + counts[("test", 1)]
    assert n_test == 200  # ceil(0.2 * 997)
    assert abs(counts[("test", 1)] - 0.2 * 333) < 1 and abs(counts[("test", 0)] - 0.2 * 664) < 1
    assert S.leakage(sp).count() == 0


def test_fold_sizes_differ_by_at_most_one(spark):
    f = S.stratified_folds(_data(spark), 5)
    sizes = f.groupBy("thread_label", "fold").count().groupBy("thread_label").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r.d <= 1 for r in sizes.collect())


def test_nested_folds_exclude_outer_fold(spark):
    f = S.stratified_folds(_data(spark, 200), 5)
    n = S.nested_folds(f)
    j = n.join(f, "orig_index").where(F.col("fold") == F.col("outer_fold"))
    assert j.count() == 0
    assert n.count() == 4 * 200


@pytest.mark.parametrize("limit", [S.ONE_TASK_CLASSES, 0])
def test_a_million_classes(spark, monkeypatch, limit):
    """As many classes as rows or nearly: no class table is broadcast by force, quotas add up, folds differ by one at most."""
    monkeypatch.setattr(S, "ONE_TASK_CLASSES", limit)
    n = 1_000_000 if limit else 20_000
    df = spark.range(n + n // 2).select(F.col("id").alias("orig_index"), (F.col("id") % n).alias("thread_label"))
    split = cut_lineage(S.stratified_split(df))
    assert split.where("part = 'test'").count() == -(-(n + n // 2) * 2 // 10)
    quotas = split.groupBy("thread_label").agg(F.count_if(F.col("part") == "test").alias("q"), F.count("*").alias("n"))
    assert quotas.where("q > ceil(n * 0.2) or q < floor(n * 0.2)").isEmpty()
    folds = S.with_folds(df).groupBy("thread_label").agg(F.count_distinct("fold").alias("f"), F.count("*").alias("n"))
    assert folds.where("f != n").isEmpty()


def test_global_rank_is_a_row_number(spark):
    df = spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("g"))
    got = global_rank(df.repartition(7), [F.col("g").desc(), F.col("id").asc()], "place").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [r["id"] for r in df.orderBy(F.col("g").desc(), "id").collect()]
    assert sorted(r["place"] for r in got) == list(range(1, 3001))
