"""Per-message functions against hand-computed literals (redaction order, turn splitting, money, requests)."""

import pytest
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions.turns import split_turns

REDACTION = [
    ("ssn 123-45-6789", "ssn [REDACTED_SSN]"),
    ("pay $500000 now", "pay $[REDACTED_PHONE] now"),
    ("pay $1,500.50 now", "pay [REDACTED_AMOUNT] now"),
    ("+1 555-123-4567", "+[REDACTED_PHONE]"),
    ("(555) 123-4567", "([REDACTED_PHONE]"),
    ("ip 152.143.123.131", "ip [REDACTED_PHONE]"),
    ("mail a.b@c.co.uk", "mail [REDACTED_EMAIL]"),
    ("5 dollars and 5 dollars", "[REDACTED_AMOUNT] and [REDACTED_AMOUNT]"),
    ("$1,2345 dollars", "[REDACTED_AMOUNT]5 dollars"),
    ("call 555 1234 5678 9999", "call [REDACTED_PHONE]"),
    ("SSN 123456789 or 123 45 6789", "SSN [REDACTED_PHONE] or 123 45 6789"),
    ("é5551234", "é5551234"),
    ("٥٥٥١٢٣٤", "[REDACTED_PHONE]"),
]


def test_redaction_literals(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(REDACTION)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", X.redact_pii("t").alias("r")).collect()}
    for i, (_, want) in enumerate(REDACTION):
        assert got[i] == want, REDACTION[i]


TURNS = [
    ("caller: hi receiver: yo", [("caller", "hi"), ("receiver", "yo")]),
    ("hello Caller:a\nRECEIVER: b ", [("unknown", "hello"), ("caller", "a"), ("receiver", "b")]),
    ("caller: receiver: x", [("caller", ""), ("receiver", "x")]),
    ("the xcaller: said", [("unknown", "the x"), ("caller", "said")]),
    ("no markers", [("unknown", "no markers")]),
    (None, [("unknown", "nan")]),
    ("   ", [("unknown", "   ")]),
    (" caller:　hi ", [("caller", "hi")]),
]


def test_turn_splitting(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(TURNS)], "i int, d string")
    got = {r.i: [(t.speaker_role, t.message_text) for t in r.t] for r in df.select("i", split_turns("d").alias("t")).collect()}
    for i, (_, want) in enumerate(TURNS):
        assert got[i] == want, TURNS[i]


@pytest.mark.parametrize(
    "text,score",
    [("send $20", 1), ("payment", 2), ("bank account", 2), ("coffee feedback", 2), ("20 dollars", 1), ("nothing", 0)],
)
def test_money_terms_on_redacted_text(spark, text, score):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.money_terms(X.redact_pii("t"))).first()[0] == score


def test_money_terms_raw_vs_redacted(spark):
    df = spark.createDataFrame([("$500000",)], "t string")
    assert df.select(X.money_terms("t")).first()[0] == 1
    assert df.select(X.money_terms(X.redact_pii("t"))).first()[0] == 0


@pytest.mark.parametrize(
    "text,want",
    [("city center", True), ("Why?", True), ("ok.", False), ("PLEASE wait", True), ("displeased", False), ("can you", True),
     ("  is it?  ", True)],
)
def test_request(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.is_request("t")).first()[0] is want


def test_ids(spark):
    df = spark.createDataFrame([(7, 3), (1234567, 12)], "o long, k int")
    rows = df.select(X.thread_id("o").alias("t")).select("t", X.message_id("t", F.lit(3)).alias("m")).collect()
    assert rows[0].t == "thread_000007" and rows[0].m == "thread_000007_msg_003"
    assert rows[1].t == "thread_1234567"
