"""The Merkle manifest against a tree built in plain code."""

import random

import pytest
from pyspark.sql import functions as F

from parley.llm import merkle, queries

from ..conftest import SF001
from . import plain

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query(spark):
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert ordered(queries.op11_merkle_manifest(spark, SF001).collect()) == ordered(plain.merkle(rows))


@pytest.mark.parametrize("depth", [2, 7])
def test_any_number_of_rows_and_levels(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rng = random.Random(depth)
    sizes = [1, 2, 3, 4, 9, 10, 28, 82, 100]
    rows = [(rng.randrange(10**6), f"s{n}" if n > 1 else None, "en", 1, f"a\n{rng.random()}") for n in sizes for _ in range(n)]
    rng.shuffle(rows)
    made = merkle.audit(spark.createDataFrame(rows, COLUMNS).repartition(5))
    assert ordered(made.collect()) == ordered(plain.merkle(rows))


def test_lone_leaf_and_lone_source(spark):
    rows = [(1, "s", None, None, "a\nb")]
    assert ordered(merkle.audit(spark.createDataFrame(rows, COLUMNS)).collect()) == ordered(plain.merkle(rows))
    rows = [(i, "s", None, None, "x") for i in range(5)]
    assert ordered(merkle.audit(spark.createDataFrame(rows, COLUMNS)).collect()) == ordered(plain.merkle(rows))


def test_awkward(spark):
    docs = plain.awkward(spark)
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in docs.collect()]
    assert ordered(merkle.audit(docs).collect()) == ordered(plain.merkle(rows))
    assert merkle.audit(plain.awkward(spark, [])).count() == 0


def test_foreign_columns_pass_and_proofs_lead_to_the_root(spark):
    names = ["node__", "group__", "place__", "size__", "leaf", "proof", "none__", "block__", "top__", "d0", "c0__", "own0__"]
    rows = [(i, "s" if i % 3 else None, "en", 1, f"t{i}", *[f"{n}{i}" for n in names]) for i in range(50)]
    docs = spark.createDataFrame(rows, [*COLUMNS.replace(" bigint", "").replace(" string", "").split(", "), *names])
    made = merkle.manifest(docs)
    for r in made.withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).collect():
        assert r["again"] == r["root"]
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names if n not in merkle.OUTPUTS)


def test_a_hot_source_is_spread_over_blocks(spark):
    """No window partition holds more than ARITY ** DEPTH rows of a source."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("x").alias("text"))
    made = merkle.manifest(docs)
    places = [r["place"] for r in made.select("place").collect()]
    assert sorted(places) == list(range(5000))
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()  # read from stored blocks
