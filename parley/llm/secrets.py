"""Secrets by sliding-window entropy (operator 7), in DataFrame functions alone.

Three base kinds (assign, access, hex) follow fixed patterns and always stay. Further
candidates are strings of 20 or more key characters with a digit that overlap no base span.
A window of 20 characters slides over a candidate. The window's character counts are kept as
it moves: one count goes down, one up, and the sum of c * log2(c) changes by these two, which
gives the window's Shannon entropy. A candidate is a secret if its highest entropy reaches
the threshold of its character class (hexadecimal, letters and digits, all key characters)
and the allow-list doesn't know it.

Cases: null text has no span; empty text has none; an empty table gives an empty table; each
row is its own, so equal rows get equal spans and null ids need no rule. A long candidate
costs time in proportion to its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import aside

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
#: kind -> pattern. Same matches as the stated base patterns, without those too short.
BASE = {"assign": _ASSIGN, "access": r"AKIA[A-Z0-9]{12,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+"}
LEAST = 8
WINDOW = 20
#: Places after `+` that key characters take; bits of a count; counts in one number.
KEYS, BITS, PACKED = 80, 6, 10
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"
#: Least entropy of a window, in bits, by character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.5, "key": 3.7}
#: Strings that look random but are no secrets: uuids, web paths, alphabets, examples and placeholders, long numbers.
ALLOWED = (
    r"\A[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z|(?i)example|placeholder|changeme|xxxxx|abcdefgh|01234567"
    r"|\A(?:[a-z]+[/_-])+[a-z0-9]*\z|\A[0-9_/+-]+\z"
)


def entropy(value: Column) -> Column:
    """Highest Shannon entropy (bits) of a window over a string of WINDOW key characters or more.

    The counts of a window are PACKED to a number, BITS each, by the character's place after `+`.
    """
    part = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    shift = lambda by, x: F.call_function("shiftleft", F.lit(x).cast("bigint"), (by % PACKED) * BITS)
    held = lambda counts, x: F.call_function("shiftright", F.get(counts, F.floor(x / PACKED).cast("int")), (x % PACKED) * BITS).bitwiseAND(F.lit(2**BITS - 1))
    changed = lambda counts, x, by: F.transform(counts, lambda c, k: F.when(k == F.floor(x / PACKED), c + shift(x, by)).otherwise(c))
    state = lambda counts, total, low: F.struct(counts.alias("counts"), total.alias("total"), low.alias("low"))

    def enter(s, x):
        n = held(s["counts"], x).cast("int")
        return state(changed(s["counts"], x, 1), s["total"] + F.get(part, n + 1) - F.get(part, n), s["low"])

    def move(s, step):
        less, more = held(s["counts"], step["gone"]).cast("int"), held(s["counts"], step["new"]).cast("int")
        total = s["total"] + F.get(part, less - 1) - F.get(part, less) + F.get(part, more + 1) - F.get(part, more)
        counts = changed(changed(s["counts"], step["gone"], -1), step["new"], 1)
        return F.when(step["gone"] == step["new"], s).otherwise(state(counts, total, F.least(s["low"], total)))

    def over(codes):
        rest = F.size(codes) - WINDOW
        steps = F.zip_with(F.slice(codes, 1, rest), F.slice(codes, WINDOW + 1, rest), lambda a, b: F.struct(a.alias("gone"), b.alias("new")))
        empty = state(F.array(*[F.lit(0).cast("bigint")] * (KEYS // PACKED + 1)), F.lit(0.0), F.lit(0.0))
        full = F.aggregate(F.slice(codes, 1, WINDOW), empty, enter, lambda s: state(s["counts"], s["total"], s["total"]))
        return F.aggregate(steps, full, move, lambda s: s["low"])

    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - ord("+"))
    return F.lit(math.log2(WINDOW)) - S.let(codes, over) / WINDOW


def _class_threshold(value: Column) -> Column:
    return (
        F.when(value.rlike(r"\A[0-9a-fA-F]+\z"), THRESHOLDS["hex"]).when(value.rlike(r"\A[0-9A-Za-z]+\z"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["key"])
    )


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `secret_base` (base spans) and `secret_spans` (these and high-entropy strings), sorted."""
    return aside(docs, [text_col], ("secret_base", "secret_spans"), lambda df: _detect(df, text_col))


def _detect(docs: DataFrame, text_col: str) -> DataFrame:
    df = docs.withColumn("t__", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text, patterns = F.col("t__"), BASE | {"entropy": CANDIDATE}
    for kind, p in patterns.items():
        df = df.withColumn(f"s__{kind}", F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    df = df.withColumn("s__key", F.regexp_extract_all(text, F.lit(_ASSIGN), F.lit(1)))
    for rank, (kind, p) in enumerate(patterns.items()):
        ok = (lambda v: ~v.rlike(ALLOWED)) if kind == "entropy" else None
        df = df.withColumn(f"s__{kind}", S.located(text, p, F.col(f"s__{kind}"), kind, rank, ok))
    df = df.withColumn("s__assign", F.filter("s__assign", lambda s, i: F.length(F.get(F.col("s__key"), i)) >= LEAST))
    df = df.withColumn("secret_base", F.sort_array(F.concat("s__assign", "s__access", "s__hex")))
    extra = F.filter(
        S.apart(F.col("s__entropy"), F.col("secret_base")),
        lambda s: entropy(s["value"]) >= _class_threshold(s["value"]),
    )
    df = df.withColumn("secret_spans", F.sort_array(F.concat("secret_base", extra)))
    return df.drop("t__", "s__key", *[f"s__{k}" for k in patterns])


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", *[S.count(F.col("secret_base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(S.listed(F.col("secret_base")).cast("binary"), 256).alias("base_sha256"), S.listed(F.col("secret_spans")).alias("spans"),
    )
