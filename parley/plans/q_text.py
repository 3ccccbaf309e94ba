"""Queries: scans, turns, redaction, per-message functions, thread features (A, H, D1-D4, E1)."""

from __future__ import annotations

from pyspark.sql import functions as F  # noqa: F401

from ..functions import patterns as P
from ..functions import text as X
from ..operators import features as feat
from ..sources import tables as src
from . import oracle_sql as O
from .registry import features, register, threads

# --------------------------------------------------------------------------------------------
# A. scans
# --------------------------------------------------------------------------------------------
@register("scan_threads", O.with_features("SELECT orig_index, dialogue, type, label FROM threads"))
def q_scan_threads(spark, sf_dir):
    return threads(spark, sf_dir).select("orig_index", "dialogue", "type", "label")


# --------------------------------------------------------------------------------------------
# H / D1-D4 / E1: turns, redaction, features
# --------------------------------------------------------------------------------------------
@register(
    "parse_turns",
    O.with_turns(
        "SELECT thread_id, printf('%s_msg_%03d', thread_id, turn_index) AS message_id, turn_index, "
        "speaker_role, message_text, thread_label, type FROM turns"
    ),
)
def q_parse_turns(spark, sf_dir):
    return feat.parse_turns(threads(spark, sf_dir))


@register(
    "thread_features",
    O.with_features(
        "SELECT thread_id, orig_index, thread_label, type, turn_count, aggregate_num_urls, "
        "aggregate_money_terms, ratio_request_messages FROM features"
    ),
)
def q_thread_features(spark, sf_dir):
    return features(spark, sf_dir)


def _docs(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", "text")


@register(
    "redact_documents",
    f"SELECT doc_id, {O.redact('text')} AS redacted_text, {O.redact('text')} <> text AS changed FROM documents",
)
def q_redact_documents(spark, sf_dir):
    return feat.redact_documents(_docs(spark, sf_dir))


def _single_redaction(name: str, fn, pattern: str, placeholder: str, ci: bool):
    opt = "'gi'" if ci else "'g'"
    sql = (
        f"SELECT doc_id, regexp_replace(text, {O._q(pattern)}, {O._q(placeholder)}, {opt}) AS redacted_text "
        f"FROM documents"
    )

    @register(name, sql)
    def q(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", fn("text").alias("redacted_text"))

    return q


_single_redaction("redact_email", X.redact_email, P.EMAIL_PATTERN, P.EMAIL_PLACEHOLDER, False)
_single_redaction("redact_phone", X.redact_phone, P.PHONE_PATTERN, P.PHONE_PLACEHOLDER, False)
_single_redaction("redact_ssn", X.redact_ssn, P.SSN_PATTERN, P.SSN_PLACEHOLDER, False)
_single_redaction("redact_amount", X.redact_amount, P.AMOUNT_PATTERN, P.AMOUNT_PLACEHOLDER, True)


def _pii_sql() -> str:
    t1 = f"regexp_replace(text, {O._q(P.EMAIL_PATTERN)}, {O._q(P.EMAIL_PLACEHOLDER)}, 'g')"
    t2 = f"regexp_replace({t1}, {O._q(P.PHONE_PATTERN)}, {O._q(P.PHONE_PLACEHOLDER)}, 'g')"
    t3 = f"regexp_replace({t2}, {O._q(P.SSN_PATTERN)}, {O._q(P.SSN_PLACEHOLDER)}, 'g')"
    return (
        f"SELECT doc_id, {O.n_matches('text', P.EMAIL_PATTERN)} AS n_email, {O.n_matches(t1, P.PHONE_PATTERN)} AS n_phone, "
        f"{O.n_matches(t2, P.SSN_PATTERN)} AS n_ssn, {O.n_matches(t3, P.AMOUNT_PATTERN, True)} AS n_amount FROM documents"
    )


@register("pii_counts", _pii_sql())
def q_pii_counts(spark, sf_dir):
    return feat.pii_counts(_docs(spark, sf_dir))


@register(
    "url_counts",
    O.with_turns(
        f"SELECT thread_id, turn_index, {O.n_matches('message_text', P.URL_PATTERN, True)} AS num_urls FROM turns"
    ),
)
def q_url_counts(spark, sf_dir):
    t = feat.parse_turns(threads(spark, sf_dir))
    return t.select("thread_id", "turn_index", X.url_count("message_text").alias("num_urls"))


@register(
    "money_terms",
    O.with_turns(
        f"SELECT thread_id, turn_index, {O.money_terms('message_text')} AS money_terms FROM turns"
    ),
)
def q_money_terms(spark, sf_dir):
    t = feat.parse_turns(threads(spark, sf_dir))
    return t.select("thread_id", "turn_index", X.money_terms("message_text").alias("money_terms"))


@register(
    "request_messages",
    O.with_turns(f"SELECT thread_id, turn_index, {O.is_request('message_text')} AS is_request FROM turns"),
)
def q_request_messages(spark, sf_dir):
    t = feat.parse_turns(threads(spark, sf_dir))
    return t.select("thread_id", "turn_index", X.is_request("message_text").alias("is_request"))


@register(
    "thread_features_from_turns",
    O.with_features("SELECT thread_id, thread_label, type, turn_count, aggregate_num_urls, aggregate_money_terms, ratio_request_messages FROM features"),
)
def q_thread_features_from_turns(spark, sf_dir):
    """Features from a turn table, aggregated partially before the shuffle."""
    return feat.thread_features_from_turns(feat.parse_turns(threads(spark, sf_dir)))


def _folder(spark, name):
    import uuid

    from ..session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("csv_threads", f"WITH {O.DECORATED_THREADS}\nSELECT dialogue, type, label, orig_index FROM threads")
def q_csv_threads(spark, sf_dir):
    """Raw dialogues written as CSV (quotes, newlines) and read by the raw reader."""
    from ..sources import sinks

    path = _folder(spark, "threads-csv")
    sinks.write_table(threads(spark, sf_dir).select("dialogue", "type", "label", "orig_index"), path)
    return src.read_raw_dialogues(spark, path, id_column="orig_index")


@register(
    "feature_table_roundtrip",
    O.with_features("SELECT thread_id, orig_index, thread_label, turn_count, aggregate_num_urls, aggregate_money_terms, ratio_request_messages FROM features"),
)
def q_feature_table_roundtrip(spark, sf_dir):
    """The feature table through its CSV sink and the load-or-fail reader."""
    from ..sources import sinks

    path = _folder(spark, "features-csv")
    sinks.write_table(features(spark, sf_dir), path)
    return src.read_features(spark, path)
