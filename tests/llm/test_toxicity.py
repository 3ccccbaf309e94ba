"""Weak supervision for toxicity: held-out accuracy, the label model against a planted one, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import queries, toxicity

from ..conftest import SF01
from . import plain


SF1 = "/root/testdata/sf0.1"


def test_query_on_held_out_documents(spark):
    scored = {r["doc_id"]: r for r in queries.op12_label_model(spark, SF1).collect()}
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    held = [(label[i], r) for i, r in scored.items() if r["held_out"] and i in label]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in scored.values())
    yes, no = [r for t, r in held if t], [r for t, r in held if not t]
    assert len(yes) > 100 and len(no) > 1000
    assert sum(r["predicted"] for r in yes) >= 0.9 * len(yes)
    assert sum(r["predicted"] for r in no) <= 0.03 * len(no)


def test_labels_of_held_out_rows_are_not_read(spark):
    scored = {r["doc_id"]: r for r in queries.op12_label_model(spark, SF01).collect()}
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, turned).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in scored.items())


def test_lexicons_are_learned_for_unknown_languages(spark):
    """Words that only toxic texts hold are found, with endings never seen, in texts not learned from."""
    rng = np.random.default_rng(5)
    common = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(common, 60))
        toxic = i % 6 == 0
        if toxic:
            words[5:5] = [f"qarsto{e}" for e in rng.choice(list("abcdefghijklm"), 4)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, known).collect()}
    held = [(t, got[i]) for i, t in labels if got[i]["held_out"]]
    assert sum((r["score"] >= 0.7) == bool(t) for t, r in held) >= 0.98 * len(held)
    assert any("learned_start" in r["votes"] for t, r in held if t)


def planted(n=40_000, seed=2):
    """Votes with known accuracies; voter 1 mostly copies voter 0."""
    rng = np.random.default_rng(seed)
    v = len(toxicity.VOTERS)
    y = (rng.random(n) < 0.1).astype(int)
    fires = np.where(y[:, None] == 1, 0.7, 0.02) * np.ones((1, v))
    x = (rng.random((n, v)) < fires).astype(int)
    copy = rng.random(n) < 0.9
    x[:, 1] = np.where(copy, x[:, 0], x[:, 1])
    label = np.where(rng.random(n) < 0.2, np.where(rng.random(n) < 0.97, y, 1 - y), -1)
    return x, y, label


def test_label_model_finds_accuracies_and_correlations():
    x, y, label = planted()
    rows, at, n = np.unique(np.hstack([x, label[:, None]]), axis=0, return_inverse=True, return_counts=True)
    model = toxicity.LabelModel(rows[:, :-1], rows[:, -1], n)
    assert model.steps < toxicity.EM_STEPS
    assert abs(model.prior[1] - 0.1) < 0.01
    assert model.parents[1] == 0 or model.parents[0] == 1
    v = len(toxicity.VOTERS)
    for i in range(2, v):
        assert abs(model.table[i, 1, :, 1].mean() - 0.7) < 0.1 and model.table[i, 0, 0, 1] < 0.05
    post = model.posterior(x, np.full(len(x), -1))
    assert ((post > 0.5) == (y == 1)).mean() > 0.995


def test_posterior_equals_enumeration():
    x, y, label = planted(4000, 3)
    model = toxicity.LabelModel(x, label, np.ones(len(x)))
    assert sum(p >= 0 for p in model.parents) == len(model.parents) - 1
    for row, known in zip(x[:50], label[:50]):
        both = []
        for c in (0, 1):
            p = model.prior[c]
            for i, up in enumerate(model.parents):
                p *= model.table[i, c, row[up] if up >= 0 else 0, row[i]]
            both.append(p * (1 if known < 0 else model.accuracy[c] if known == c else 1 - model.accuracy[c]))
        assert model.posterior(row[None], np.array([known]))[0] == pytest.approx(both[1] / sum(both), rel=1e-9)


def test_voters():
    voters = toxicity.Voters({"zork": 2.0, "blargen": 2.0, "blarg*": 3.0})
    votes = lambda t: {v for v, x in zip(toxicity.VOTERS, voters.features(t)) if x}
    assert votes(None) == votes("") == votes("1234 !!") == votes("A plain sentence.") == set()
    assert {"lexicon_person", "addressed"} <= votes("You IDIOT!")
    assert "spelled" in votes("what an 1d10t1c id1ot") and "spelled" in votes("m*ron it is") and "stretched" in votes("stuuuupid")
    assert {"learned_word", "learned_words", "two_hits"} <= votes("zork blargen")
    assert {"learned_start"} == votes("blargest " + "a plain word " * 50) - {"learned_word"}
    assert "shouting" in votes("THIS IS ALL VERY LOUD TEXT THAT GOES ON AND ON")
    assert "lexicon_person" in votes("plain " * 100_000 + "idiot")


def test_awkward(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (8, None), (None, 1), (6, 7)], "doc_id long, toxic int")
    made = toxicity.score(plain.awkward(spark), labels).collect()
    assert len(made) == len(plain.AWKWARD) and all(0 <= r["score"] <= 1 for r in made)
    assert {r["mark"] for r in made} == {"y"} and {r["fp"] for r in made} == {"x"}
    assert toxicity.score(plain.awkward(spark, []), labels).count() == 0
    none = toxicity.score(plain.awkward(spark), labels.where("false"))
    assert none.count() == len(plain.AWKWARD)
    only = spark.createDataFrame([(10, "x")], "doc_id long, text string").where(toxicity.held_out())
    assert toxicity.score(only, labels).count() == only.count()
