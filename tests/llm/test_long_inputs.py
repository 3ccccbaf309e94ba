"""Long candidates and many matches in one text: native spans and entropies stay near linear."""

import collections
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from parley.llm import pii, secrets
from parley.llm import spans as S

from . import plain

KEY = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


def one(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    df.count()
    return df


def highest(value, window=20):
    out = 0.0
    for i in range(len(value) - window + 1):
        n = collections.Counter(value[i : i + window])
        out = max(out, -sum(c / window * math.log2(c / window) for c in n.values()))
    return out


@pytest.mark.parametrize("alphabet", [KEY, "0123456789abcdef", "ab", "x"])
def test_entropy_equals_plain_counts(spark, alphabet):
    rng = random.Random(len(alphabet))
    values = ["".join(rng.choices(alphabet, k=n)) for n in (20, 21, 39, 40, 41, 100, 500)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.entropy(F.col("v")).alias("e")).collect()
    assert all(abs(r["e"] - highest(r["v"])) < 1e-9 for r in rows)


def test_long_candidates_take_linear_time(spark):
    took, rng = {}, random.Random(1)
    for n in (1_000, 10_000, 100_000):
        df = one(spark, "".join(rng.choices(KEY, k=n)))
        start = time.perf_counter()
        e = df.select(secrets.entropy(F.col("text")).alias("e")).first()["e"]
        took[n] = time.perf_counter() - start
        assert e > 3.5
    assert took[100_000] < 2 + 30 * took[10_000] and took[100_000] < 10


def test_many_matches_equal_plain_spans(spark):
    rng = random.Random(2)
    words = ["12", "a@b.de", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "+49 30 1234567", "é", "🙂", "token=abcdefgh1", "0123456789abcdef" * 2, "AKIA" + "Z9" * 8]
    for n in (0, 1, 2, 3, 7, 100, 6000):
        text = " x ".join(rng.choices(words, k=n))
        start = time.perf_counter()
        got = pii.digests(pii.detect(one(spark, text))).first()
        assert tuple(got)[1:6] == plain.base_spans(text, plain.PII)
        got = secrets.digests(secrets.detect(one(spark, text))).first()
        assert tuple(got)[1:5] == plain.base_spans(text, plain.SECRETS)
        assert time.perf_counter() - start < 60


def test_replacement_and_overlaps_equal_plain(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 60, 300):
        text = "".join(rng.choices("ab🙂é ", k=2 * n + 5))
        spans = [(a, r, min(len(text), a + rng.randint(1, 4)), f"k{r}", "", "") for a, r in ((rng.randrange(len(text)), rng.randrange(3)) for _ in range(n))]
        others = [(a, 0, min(len(text), a + rng.randint(1, 3)), "o", "", "") for a in sorted(rng.sample(range(len(text)), min(n, len(text))))]
        df = spark.createDataFrame([(text, spans, others)], f"text string, spans {S.NONE}, others {S.NONE}").cache()
        row = df.select(
            S.replaced(F.col("text"), F.col("spans"), lambda k: F.concat(F.lit("["), k, F.lit("]"))).alias("out"),
            S.apart(F.col("spans"), F.col("others")).alias("apart"),
        ).first()
        at, want = 0, ""
        for a, _, e, kind, _, _ in sorted(spans):
            if a >= at:
                want += text[at:a] + f"[{kind}]"
            at = max(at, e)
        assert row["out"] == want + text[at:]
        assert [tuple(r) for r in row["apart"]] == [s for s in spans if not any(s[0] < o[2] and o[0] < s[2] for o in others)]


def test_text_before_a_span(spark):
    made = pii.candidates(one(spark, "call me: +49 30 1234567, or mail a@b.de c@d.de")).first()["pii_base"]
    assert made[0]["before"] == "call me: " and made[1]["before"].endswith("or mail ") and made[2]["before"] == "a@b.de "
