"""Queries: data-quality suite (J, B4-B6, B9, G3) and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import STRUCTURAL_FEATURES
from ..operators import profile as prof
from ..operators import quality as qual
from ..sources import tables as src
from . import oracle_sql as O
from ..operators.metrics import rounded
from .registry import features, register, threads, turns

FEATS = STRUCTURAL_FEATURES


def _rows_sql(source: str, rows) -> str:
    """rows: (order, name, status_sql, detail_sql)."""
    parts = [
        f"SELECT {i} AS check_order, '{name}' AS \"check\", {status} AS status, {detail} AS detail FROM {source}"
        for i, name, status, detail in rows
    ]
    return "\nUNION ALL ".join(parts)


def _pf(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'PASS' ELSE 'FAIL' END"


TURN_CHECKS_SQL = (
    "va AS (SELECT count(*) AS n, count(*) FILTER (WHERE thread_label IS NULL) AS nl, "
    "count(*) FILTER (WHERE turn_index < 0) AS bi FROM turns)"
)
TURN_ROWS = [
    (0, "Parsed data required columns", "'PASS'", "'All required columns exist.'"),
    (1, "Parsed data row count", _pf("n > 0"), "'Parsed rows: ' || n"),
    (2, "Parsed data missing labels", _pf("nl = 0"), "'Missing labels: ' || nl"),
    (3, "Parsed data valid turn_index", _pf("bi = 0"), "'Invalid turn_index rows: ' || bi"),
]
FEATURE_CHECKS_SQL = (
    "vb AS (SELECT count(*) AS n, count(*) FILTER (WHERE thread_label IS NULL) AS nl, "
    "count(*) FILTER (WHERE turn_count IS NULL) + count(*) FILTER (WHERE aggregate_num_urls IS NULL) + "
    "count(*) FILTER (WHERE aggregate_money_terms IS NULL) + count(*) FILTER (WHERE ratio_request_messages IS NULL) AS nn, "
    "count(*) FILTER (WHERE turn_count <= 0) AS b1, count(*) FILTER (WHERE aggregate_num_urls < 0) AS b2, "
    "count(*) FILTER (WHERE aggregate_money_terms < 0) AS b3, "
    "count(*) FILTER (WHERE ratio_request_messages < 0 OR ratio_request_messages > 1) AS b4 FROM features)"
)
FEATURE_ROWS = [
    (0, "Feature data required columns", "'PASS'", "'All required columns exist.'"),
    (1, "Feature data row count", _pf("n > 0"), "'Feature rows: ' || n"),
    (2, "Feature data missing labels", _pf("nl = 0"), "'Missing labels: ' || nl"),
    (3, "Feature data missing numeric values", _pf("nn = 0"), "'Missing numeric feature values: ' || nn"),
    (4, "turn_count greater than 0", _pf("b1 = 0"), "'Invalid turn_count rows: ' || b1"),
    (5, "aggregate_num_urls non-negative", _pf("b2 = 0"), "'Invalid URL count rows: ' || b2"),
    (6, "aggregate_money_terms non-negative", _pf("b3 = 0"), "'Invalid money term count rows: ' || b3"),
    (7, "ratio_request_messages between 0 and 1", _pf("b4 = 0"), "'Invalid ratio rows: ' || b4"),
]


@register("validate_turns")
def q_validate_turns(spark, sf_dir):
    return qual.validate_turns(turns(spark, sf_dir))


@register("validate_features")
def q_validate_features(spark, sf_dir):
    return qual.validate_features(features(spark, sf_dir))


@register("failed_checks")
def q_failed_checks(spark, sf_dir):
    """Both suites over tables with planted faults: every seventh thread is out of range or lacks its label."""
    raw = threads(spark, sf_dir)
    from ..operators import features as feat

    hit = F.substring("thread_id", 8, 20).cast("bigint") % 7 == 0  # thread_000123
    turns = feat.parse_turns(raw).withColumn("turn_index", F.when(hit, -1).otherwise(F.col("turn_index")))
    feats = feat.thread_features(raw)
    feats = feats.withColumn("thread_label", F.when(~hit, F.col("thread_label"))).withColumn("turn_count", F.when(hit, F.lit(0).cast("bigint")).otherwise(F.col("turn_count")))
    return qual.failed_checks(qual.validate_turns(turns), qual.validate_features(feats)).select("check", "status", "detail")


def _with(ctes: str, select: str) -> str:
    return f"WITH {O.FEATURES},\n{ctes}\n{select}"


from .registry import ORACLE  # noqa: E402

ORACLE["validate_turns"] = _with(TURN_CHECKS_SQL, _rows_sql("va", TURN_ROWS))
ORACLE["validate_features"] = _with(FEATURE_CHECKS_SQL, _rows_sql("vb", FEATURE_ROWS))
ORACLE["failed_checks"] = _with(
    "bad_t AS (SELECT count(*) AS n FROM turns WHERE orig_index % 7 = 0), bad_f AS (SELECT count(*) AS n FROM features WHERE orig_index % 7 = 0)",
    """SELECT 'Parsed data valid turn_index' AS "check", 'FAIL' AS status, 'Invalid turn_index rows: ' || n AS detail FROM bad_t WHERE n > 0
UNION ALL SELECT 'Feature data missing labels', 'FAIL', 'Missing labels: ' || n FROM bad_f WHERE n > 0
UNION ALL SELECT 'turn_count greater than 0', 'FAIL', 'Invalid turn_count rows: ' || n FROM bad_f WHERE n > 0""",
)

@register(
    "label_distribution",
    O.with_features(
        "SELECT 'thread' AS level, thread_label AS label, count(*) AS n FROM features GROUP BY thread_label "
        "UNION ALL SELECT 'turn' AS level, thread_label AS label, count(*) AS n FROM turns GROUP BY thread_label "
        "UNION ALL SELECT 'raw' AS level, label, count(*) AS n FROM threads GROUP BY label"
    ),
)
def q_label_distribution(spark, sf_dir):
    raw = threads(spark, sf_dir)
    from ..operators import features as feat

    return (
        prof.label_distribution(feat.thread_features(raw), "thread_label", "thread")
        .unionByName(prof.label_distribution(feat.parse_turns(raw), "thread_label", "turn"))
        .unionByName(prof.label_distribution(raw, "label", "raw"))
    )


def _describe_sql() -> str:
    lf = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM features" for c in FEATS)
    return O.with_features(
        f"SELECT feature, CAST(count(value) AS DOUBLE) AS count, round(avg(value), 10) AS mean, "
        f"round(stddev_samp(value), 10) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 10) AS p25, "
        f"round(quantile_cont(value, 0.5), 10) AS p50, round(quantile_cont(value, 0.75), 10) AS p75, max(value) AS max "
        f"FROM ({lf}) lf GROUP BY feature"
    )


@register("feature_describe", _describe_sql())
def q_feature_describe(spark, sf_dir):
    return rounded(prof.describe(features(spark, sf_dir), FEATS))


_CONV_COLS = ["conv_id", "turn", "role", "text"]


@register(
    "null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null FROM conversations"
        for c in _CONV_COLS
    ),
)
def q_null_counts(spark, sf_dir):
    return prof.null_counts(src.table(spark, sf_dir, "conversations"))


@register(
    "row_counts",
    O.with_features(
        "SELECT (SELECT count(*) FROM threads) AS raw_rows, (SELECT count(*) FROM turns) AS parsed_turn_rows, "
        "(SELECT count(*) FROM features) AS thread_feature_rows"
    ),
)
def q_row_counts(spark, sf_dir):
    raw = threads(spark, sf_dir)
    from ..operators import features as feat

    return prof.row_counts(raw, feat.parse_turns(raw), feat.thread_features(raw))


@register(
    "head_threads",
    O.with_features("SELECT orig_index, label, dialogue FROM threads ORDER BY orig_index LIMIT 5"),
)
def q_head_threads(spark, sf_dir):
    """The first five threads: their ids are found first, so that no other dialogue is assembled (the semi-join goes below the grouping)."""
    first = src.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("orig_index")).distinct().orderBy("orig_index").limit(5)
    return threads(spark, sf_dir).join(first, "orig_index", "left_semi").orderBy("orig_index").limit(5).select("orig_index", "label", "dialogue")


@register(
    "label_domain_check",
    O.with_features(
        "SELECT count(*) FILTER (WHERE thread_label IS NOT NULL AND thread_label NOT IN (0, 1)) AS n_outside, "
        "count(DISTINCT thread_label) AS n_distinct, "
        "count(*) FILTER (WHERE thread_label IS NOT NULL AND thread_label NOT IN (0, 1)) = 0 AS is_binary FROM features"
    ),
)
def q_label_domain_check(spark, sf_dir):
    return qual.label_domain(features(spark, sf_dir))


@register(
    "feature_projection",
    O.with_features(f"SELECT orig_index, {', '.join(FEATS)}, CAST(thread_label AS INTEGER) AS thread_label FROM features"),
)
def q_feature_projection(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select("orig_index", *FEATS, F.col("thread_label").cast("int").alias("thread_label"))


def feature_set_table():
    """(feature_set, removed_feature, features) for the full set and each leave-one-out set."""
    sets = [("full_feature_set", "None", list(FEATS))]
    for c in FEATS:
        sets.append((f"without_{c}", c, [x for x in FEATS if x != c]))
    return sets


def _feature_sets_sql() -> str:
    parts = []
    for name, removed, cols in feature_set_table():
        for c in cols:
            parts.append(
                f"SELECT '{name}' AS feature_set, '{removed}' AS removed_feature, '{', '.join(cols)}' AS features_used, "
                f"{len(cols)} AS n_features, orig_index, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM features"
            )
    return O.with_features(" UNION ALL ".join(parts))


@register("feature_sets", _feature_sets_sql())
def q_feature_sets(spark, sf_dir):
    f = features(spark, sf_dir)
    sets = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature_set"),
                F.lit(removed).alias("removed_feature"),
                F.array_join(F.array(*[F.lit(c) for c in cols]), ", ").alias("features_used"),
                F.lit(len(cols)).alias("n_features"),
                F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]).alias("cols"),
            )
            for name, removed, cols in feature_set_table()
        ]
    )
    x = f.select("orig_index", F.explode(sets).alias("s")).select("orig_index", "s.*")
    return x.select(
        "feature_set", "removed_feature", "features_used", "n_features", "orig_index", F.explode("cols").alias("c")
    ).select("feature_set", "removed_feature", "features_used", "n_features", "orig_index", "c.feature", "c.value")


PRESENCE_FILES = ["conversations", "documents", "lineitem"]


@register("input_presence")
def q_input_presence(spark, sf_dir):
    """Three tables and one path that isn't there."""
    base = sf_dir.rstrip("/")
    return src.input_presence(spark, [*[f"{base}/{n}.parquet" for n in PRESENCE_FILES], f"{base}/no_such_table.parquet"])


@register("presence_checks")
def q_presence_checks(spark, sf_dir):
    base = sf_dir.rstrip("/")
    return qual.presence_checks(spark, f"{base}/conversations.parquet", f"{base}/no_such_table.parquet")


@register("dataset_profile")
def q_dataset_profile(spark, sf_dir):
    from ..operators.profile_json import dataset_profile

    raw = threads(spark, sf_dir)
    from ..operators import features as feat

    files = {"raw_data": f"{sf_dir.rstrip('/')}/conversations.parquet"}
    return dataset_profile(raw, feat.parse_turns(raw), feat.thread_features(raw), files)
