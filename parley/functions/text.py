"""Per-message scalar functions as JVM-side Column expressions (no Python UDF).

All take and return ``Column``s, so they run inside whole-stage codegen and work
unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_to_text(c) -> Column:
    """``str(x)`` of a pandas cell: a missing value becomes the text ``nan``."""
    return F.coalesce(_col(c), F.lit(P.NULL_TEXT))


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes all Unicode whitespace (Spark's 1-arg trim drops only spaces)."""
    return F.trim(_col(c), F.lit(P.PY_WHITESPACE))


def redact_email(c) -> Column:
    return F.regexp_replace(_col(c), P.java(P.EMAIL_PATTERN), P.EMAIL_PLACEHOLDER)


def redact_phone(c) -> Column:
    return F.regexp_replace(_col(c), P.java(P.PHONE_PATTERN), P.PHONE_PLACEHOLDER)


def redact_ssn(c) -> Column:
    return F.regexp_replace(_col(c), P.java(P.SSN_PATTERN), P.SSN_PLACEHOLDER)


def redact_amount(c) -> Column:
    return F.regexp_replace(_col(c), P.java(P.AMOUNT_PATTERN, ignore_case=True), P.AMOUNT_PLACEHOLDER)


def redact_pii(c) -> Column:
    """Email -> phone -> SSN -> amount, in that order (each sees the previous output)."""
    return redact_amount(redact_ssn(redact_phone(redact_email(null_to_text(c)))))


def count_matches(c, pattern: str, ignore_case: bool = False) -> Column:
    """Number of non-overlapping matches (``len(re.findall)``)."""
    return F.regexp_count(_col(c), F.lit(P.java(pattern, ignore_case))).cast("bigint")


def url_count(c) -> Column:
    return count_matches(c, P.URL_PATTERN, ignore_case=True)


def substring_count(c, needle: str) -> Column:
    """``str.count(needle)``: non-overlapping, not word-bounded."""
    t = _col(c)
    return ((F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("bigint")


def keyword_count(c, keywords: Sequence[str] = tuple(P.MONEY_KEYWORDS)) -> Column:
    lower = F.lower(null_to_text(c))
    total = F.lit(0).cast("bigint")
    for kw in keywords:
        total = total + substring_count(lower, kw)
    return total


def money_terms(c, keywords: Sequence[str] = tuple(P.MONEY_KEYWORDS)) -> Column:
    """Money score: substring hits of every keyword on lower-case text plus amount-pattern hits."""
    t = null_to_text(c)
    return keyword_count(t, keywords) + count_matches(t, P.AMOUNT_PATTERN, ignore_case=True)


def is_request(c, keywords: Sequence[str] = tuple(P.REQUEST_KEYWORDS)) -> Column:
    """Ends with '?', contains any request keyword, or has a polite request phrase (on lower+strip text)."""
    t = py_strip(F.lower(null_to_text(c)))
    cond = t.endswith("?")
    for kw in keywords:
        cond = cond | t.contains(kw)
    return cond | t.rlike(P.java(P.REQUEST_PHRASE_PATTERN))


def safe_ratio(num, den) -> Column:
    """``a / max(1, b)`` as DOUBLE."""
    return _col(num).cast("double") / F.greatest(F.lit(1), _col(den)).cast("double")


def thread_id(orig_index) -> Column:
    return F.format_string("thread_%06d", _col(orig_index))


def message_id(thread, turn_index) -> Column:
    return F.format_string("%s_msg_%03d", _col(thread), _col(turn_index))
