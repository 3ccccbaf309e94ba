"""Spelling variants against all pairs of words, on test data and on awkward rows."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import queries, variants

from ..conftest import SF01
from . import plain


def table(rows):
    found = [tuple(r) for r in rows]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    want = plain.spelling(docs)
    assert sum(v[0] is not None for v in want.values()) > 50
    assert table(queries.op13_partenum_variants(spark, SF01).collect()) == want


@settings(max_examples=400, deadline=None)
@given(st.text("abcdeé", min_size=1, max_size=9), st.data())
def test_near_words_meet_at_one_signature(word, data):
    at, kind = data.draw(st.integers(0, len(word))), data.draw(st.sampled_from("ird"))
    letter = data.draw(st.sampled_from("abcdeéz"))
    other = word[:at] + (letter if kind != "d" else "") + word[at + (kind != "i") :]
    a, b = variants.signatures(word), variants.signatures(other)
    meet = [k for k, s in a for m, t in b if k == m and (s, t) in ((0, 1), (1, 0), (2, 2))]
    if other != word and abs(len(word) - len(other)) <= 1:
        assert len(meet) == 1 or sorted(word) == sorted(other)


def test_forms_chains_and_ties(spark):
    rows = []

    def add(word, n):
        rows.extend((len(rows), word) for _ in range(n))

    add("castles", 5), add("castlef", 30), add("castlefg", 200), add("castlefgh", 1100)  # a chain
    add("mottled", 5), add("mottler", 25), add("mottles", 25)  # a tie: the smaller one
    add("éclairs", 6), add("eclairs", 40), add("Éclairs", 40), add("paddlé", 5)
    add("lonely", 4), add("short", 50), add("aabbcc", 7), add("ccbbaa", 90)  # too rare, too short, an anagram
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    made = table(variants.variants(docs).collect())
    want = plain.spelling(rows)
    assert made == want
    assert made["castles"][1] == "castlefgh" and made["mottled"][0] == "mottler" and made["aabbcc"][3] == 0


def test_one_letter_words_and_hot_signatures(spark):
    rng = random.Random(4)
    many = {"".join(rng.choice("ab") for _ in range(9)) for _ in range(400)}
    rows = [(i, " ".join(sorted(many) * 5 + ["z" * k for k in range(6, 60)] * 5)) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert table(variants.variants(docs).collect()) == plain.spelling(rows)


def test_awkward(spark):
    rows = [*plain.AWKWARD, *[(None, "Variants variants variant")] * 6, (20, "x" * 300_000), (21, "été" * 4 + " " + "÷×ÿ" * 4)]
    made = table(variants.variants(plain.awkward(spark, rows)).collect())
    assert made == plain.spelling(rows)
    assert variants.variants(plain.awkward(spark, [])).count() == 0


def test_no_join_is_broadcast(spark, monkeypatch):
    plans, kept = [], variants.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(variants, "stored", seen)
    rows = [(i, word) for i, word in enumerate(["castles"] * 5 + ["castlef"] * 30 + ["castlefg"] * 200)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")  # every table here is taken for a small one
    try:
        made = variants.variants(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert table(made.collect()) == plain.spelling(rows)
        plans.append(made._jdf.queryExecution().executedPlan().toString())  # as run
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
