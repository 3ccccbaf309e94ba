"""Feature pipeline invariants and the reference's nine data-contract checks, on the decorated threads."""

import pytest
from pyspark.sql import functions as F

from parley.operators import features as feat
from parley.operators import quality as qual
from parley.sources import tables as src

from .conftest import SF01

FEATS = ["turn_count", "aggregate_num_urls", "aggregate_money_terms", "ratio_request_messages"]


@pytest.fixture(scope="module")
def raw(spark):
    return src.decorated_threads(spark, SF01).cache()


@pytest.fixture(scope="module")
def feats(raw):
    return feat.thread_features(raw).cache()


def test_contract_columns_and_rows(raw, feats):
    assert feats.columns == feat.FEATURE_COLUMNS
    assert feats.count() == raw.count() == 100


def test_contract_ranges(feats):
    bad = feats.agg(
        F.count_if(F.col("turn_count") <= 0), F.count_if(F.col("aggregate_num_urls") < 0),
        F.count_if(F.col("aggregate_money_terms") < 0), F.count_if(~F.col("ratio_request_messages").between(0, 1)),
        F.count_if(F.col("thread_label").isNull()), F.count_if(~F.col("thread_label").isin(0, 1)),
    ).first()
    assert tuple(bad) == (0,) * 6


def test_contract_no_missing_numeric(feats):
    assert feats.agg(*[F.count_if(F.col(c).isNull()) for c in FEATS]).first() == tuple([0] * 4)


def test_contract_unique_ids(feats):
    assert feats.select("thread_id").distinct().count() == feats.count()


def test_turn_rows_equal_turn_count_sum(raw, feats):
    turns = feat.parse_turns(raw)
    assert turns.count() == feats.agg(F.sum("turn_count")).first()[0]


def test_array_and_explode_forms_agree(raw, feats):
    alt = feat.thread_features_from_turns(feat.parse_turns(raw))
    a = {r.thread_id: tuple(r[c] for c in FEATS) for r in feats.collect()}
    b = {r.thread_id: tuple(r[c] for c in FEATS) for r in alt.collect()}
    assert a == b


def test_redaction_leaves_no_email_or_ssn(raw):
    turns = feat.parse_turns(raw)
    assert turns.where(F.col("message_text").rlike(r"@example\.com|\d{3}-\d{2}-\d{4}")).count() == 0


def test_validation_all_pass(raw, feats):
    res = qual.failed_checks(qual.validate_turns(feat.parse_turns(raw)), qual.validate_features(feats))
    assert res.count() == 0
    qual.raise_on_failure(qual.validate_features(feats))


def test_validation_detects_bad_rows(spark):
    bad = spark.createDataFrame(
        [("t1", 1, 1, None, 0, -1, 2, 1.5)],
        "thread_id string, orig_index long, thread_label int, type string, turn_count long, "
        "aggregate_num_urls long, aggregate_money_terms long, ratio_request_messages double",
    )
    res = {r.check: (r.status, r.detail) for r in qual.validate_features(bad).collect()}
    assert res["turn_count greater than 0"] == ("FAIL", "Invalid turn_count rows: 1")
    assert res["aggregate_num_urls non-negative"][0] == "FAIL"
    assert res["ratio_request_messages between 0 and 1"][0] == "FAIL"
    with pytest.raises(ValueError):
        qual.raise_on_failure(qual.validate_features(bad))


def test_missing_dialogue_column_raises(spark):
    with pytest.raises(ValueError):
        feat.thread_features(spark.createDataFrame([(1,)], "label int"))


# Per-label feature means measured independently for the decorated threads (FIXTURES.md section 3).
FIXTURE_MEANS = {
    "sf0.01": {0: (4.900, 0.180, 1.080, 0.189), 1: (5.820, 0.980, 5.440, 0.301)},
    "sf0.1": {0: (5.070, 0.252, 1.284, 0.172), 1: (4.954, 0.830, 4.554, 0.271)},
}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_feature_means_match_fixture(spark, sf):
    f = feat.thread_features(src.decorated_threads(spark, f"/root/testdata/{sf}"))
    got = {r.thread_label: tuple(r[1:]) for r in f.groupBy("thread_label").agg(*[F.avg(c) for c in FEATS]).collect()}
    for label, want in FIXTURE_MEANS[sf].items():
        for g, w in zip(got[label], want):
            assert abs(g - w) < 5e-4, (sf, label, got[label], want)
