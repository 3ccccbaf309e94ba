"""Thread parsing and the four structural features.

Array form: one row per dialogue in, one row per thread out; every step is a
narrow projection (no shuffle), so it scales with the scan. The turn table is the
same redacted array, exploded. The redacted array is materialised in its own
projection so the regex chain runs once per turn, not once per consumer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.turns import redact_turns, split_turns
from ..sources.tables import optional_column, require_columns

TURN_COLUMNS = ["thread_id", "message_id", "turn_index", "speaker_role", "message_text", "thread_label", "type"]
FEATURE_COLUMNS = [
    "thread_id",
    "orig_index",
    "thread_label",
    "type",
    "turn_count",
    "aggregate_num_urls",
    "aggregate_money_terms",
    "ratio_request_messages",
]


def redacted_threads(raw: DataFrame) -> DataFrame:
    """(thread_id, orig_index, thread_label, type, turns ARRAY<STRUCT>) with redacted text."""
    require_columns(raw, {"dialogue", "label", "orig_index"})
    parsed = raw.select(
        X.thread_id("orig_index").alias("thread_id"),
        F.col("orig_index").cast("bigint").alias("orig_index"),
        F.col("label").cast("int").alias("thread_label"),
        optional_column(raw, "type").alias("type"),
        split_turns("dialogue").alias("raw_turns"),
    )
    return parsed.select(
        "thread_id", "orig_index", "thread_label", "type", redact_turns("raw_turns").alias("turns")
    )


def parse_turns(raw: DataFrame) -> DataFrame:
    """Turn table: one row per (thread, turn), redacted text."""
    t = redacted_threads(raw).select(
        "thread_id", "thread_label", "type", F.posexplode("turns").alias("turn_index", "turn")
    )
    return t.select(
        "thread_id",
        X.message_id("thread_id", "turn_index").alias("message_id"),
        F.col("turn_index").cast("int").alias("turn_index"),
        F.col("turn.speaker_role").alias("speaker_role"),
        F.col("turn.message_text").alias("message_text"),
        "thread_label",
        "type",
    )


def _sum_over(arr, fn):
    return F.aggregate(F.transform(arr, fn), F.lit(0).cast("bigint"), lambda a, b: a + b)


def thread_features(raw: DataFrame) -> DataFrame:
    """The four features, computed on redacted text, without exploding or shuffling."""
    r = redacted_threads(raw)
    texts = F.transform("turns", lambda t: t["message_text"])
    r = r.select("thread_id", "orig_index", "thread_label", "type", texts.alias("texts"))
    n = F.size("texts").cast("bigint")
    requests = _sum_over("texts", lambda m: X.is_request(m).cast("bigint"))
    return r.select(
        "thread_id",
        "orig_index",
        "thread_label",
        "type",
        n.alias("turn_count"),
        _sum_over("texts", lambda m: X.url_count(m)).alias("aggregate_num_urls"),
        _sum_over("texts", lambda m: X.money_terms(m)).alias("aggregate_money_terms"),
        X.safe_ratio(requests, n).alias("ratio_request_messages"),
    )


def thread_features_from_turns(turns: DataFrame) -> DataFrame:
    """Same features from a turn table (explode form): partial aggregation per thread, so a
    thread with a huge number of turns is pre-aggregated map-side before the shuffle."""
    per_turn = turns.select(
        "thread_id",
        "thread_label",
        "type",
        X.url_count("message_text").alias("u"),
        X.money_terms("message_text").alias("m"),
        X.is_request("message_text").cast("bigint").alias("q"),
    )
    agg = per_turn.groupBy("thread_id", "thread_label", "type").agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.sum("u").alias("aggregate_num_urls"),
        F.sum("m").alias("aggregate_money_terms"),
        F.sum("q").alias("requests"),
    )
    return agg.select(
        "thread_id",
        "thread_label",
        "type",
        "turn_count",
        "aggregate_num_urls",
        "aggregate_money_terms",
        X.safe_ratio("requests", "turn_count").alias("ratio_request_messages"),
    )


def redact_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Whole-text redaction of a document table (narrow)."""
    docs = docs.select(id_col, text_col)
    red = docs.select(F.col(id_col), F.col(text_col).alias("_t"), X.redact_pii(text_col).alias("redacted_text"))
    return red.select(id_col, "redacted_text", (F.col("_t") != F.col("redacted_text")).alias("changed"))


def pii_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Matches per PII kind along the redaction chain (each kind counted on the text the chain gives it)."""
    from ..functions import patterns as P

    s0 = docs.select(F.col(id_col), X.null_to_text(text_col).alias("t0"))
    s1 = s0.select(id_col, "t0", X.redact_email("t0").alias("t1"))
    s2 = s1.select(id_col, "t0", "t1", X.redact_phone("t1").alias("t2"))
    s3 = s2.select(id_col, "t0", "t1", "t2", X.redact_ssn("t2").alias("t3"))
    return s3.select(
        id_col,
        X.count_matches("t0", P.EMAIL_PATTERN).alias("n_email"),
        X.count_matches("t1", P.PHONE_PATTERN).alias("n_phone"),
        X.count_matches("t2", P.SSN_PATTERN).alias("n_ssn"),
        X.count_matches("t3", P.AMOUNT_PATTERN, ignore_case=True).alias("n_amount"),
    )
