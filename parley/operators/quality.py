"""Data-quality suite: one aggregate pass per table, then ``stack`` to (check, status, detail).

A NULL predicate is not "invalid" (``count_if`` counts only TRUE), matching the
reference where ``NaN < 0`` is false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import FEATURE_COLUMNS, TURN_COLUMNS

NUMERIC_FEATURES = ["turn_count", "aggregate_num_urls", "aggregate_money_terms", "ratio_request_messages"]


def missing_columns(spark: SparkSession, df: DataFrame, required) -> DataFrame:
    """Required column names absent from ``df`` (set difference as a relation)."""
    req = spark.createDataFrame([(c,) for c in sorted(required)], "column_name string")
    have = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    return req.exceptAll(have).distinct()


def _columns_check(df: DataFrame, required, name: str):
    missing = sorted(set(required) - set(df.columns))
    detail = ("Missing columns: {" + ", ".join(f"'{m}'" for m in missing) + "}") if missing else "All required columns exist."
    return (name, not missing, detail)


def _results(agg_row: DataFrame, plan_rows, checks) -> DataFrame:
    """checks: list of (order, name, fail_count_col, detail_fmt, passed_expr or None)."""
    parts = []
    for i, (name, passed, detail) in enumerate(plan_rows):
        parts.append(
            F.struct(
                F.lit(i).alias("check_order"),
                F.lit(name).alias("check"),
                F.lit("PASS" if passed else "FAIL").alias("status"),
                F.lit(detail).alias("detail"),
            )
        )
    base = len(plan_rows)
    for j, (name, value, fmt, passed) in enumerate(checks):
        parts.append(
            F.struct(
                F.lit(base + j).alias("check_order"),
                F.lit(name).alias("check"),
                F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
                F.format_string(fmt, value).alias("detail"),
            )
        )
    return agg_row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def validate_turns(turns: DataFrame) -> DataFrame:
    plan = [_columns_check(turns, TURN_COLUMNS, "Parsed data required columns")]
    aggs = [F.count(F.lit(1)).alias("n")]
    if "thread_label" in turns.columns:
        aggs.append(F.count_if(F.col("thread_label").isNull()).alias("null_labels"))
    if "turn_index" in turns.columns:
        aggs.append(F.count_if(F.col("turn_index") < 0).alias("bad_index"))
    a = turns.agg(*aggs)
    checks = [("Parsed data row count", F.col("n"), "Parsed rows: %d", F.col("n") > 0)]
    if "thread_label" in turns.columns:
        checks.append(("Parsed data missing labels", F.col("null_labels"), "Missing labels: %d", F.col("null_labels") == 0))
    if "turn_index" in turns.columns:
        checks.append(
            ("Parsed data valid turn_index", F.col("bad_index"), "Invalid turn_index rows: %d", F.col("bad_index") == 0)
        )
    return _results(a, plan, checks)


def validate_features(feats: DataFrame) -> DataFrame:
    plan = [_columns_check(feats, FEATURE_COLUMNS, "Feature data required columns")]
    cols = set(feats.columns)
    numeric = [c for c in NUMERIC_FEATURES if c in cols]
    aggs = [F.count(F.lit(1)).alias("n")]
    if "thread_label" in cols:
        aggs.append(F.count_if(F.col("thread_label").isNull()).alias("null_labels"))
    null_numeric = F.lit(0).cast("bigint")
    for c in numeric:
        null_numeric = null_numeric + F.count_if(F.col(c).isNull())
    aggs.append(null_numeric.alias("null_numeric"))
    rules = {
        "turn_count": ("turn_count greater than 0", F.col("turn_count") <= 0, "Invalid turn_count rows: %d"),
        "aggregate_num_urls": ("aggregate_num_urls non-negative", F.col("aggregate_num_urls") < 0, "Invalid URL count rows: %d"),
        "aggregate_money_terms": (
            "aggregate_money_terms non-negative",
            F.col("aggregate_money_terms") < 0,
            "Invalid money term count rows: %d",
        ),
        "ratio_request_messages": (
            "ratio_request_messages between 0 and 1",
            (F.col("ratio_request_messages") < 0) | (F.col("ratio_request_messages") > 1),
            "Invalid ratio rows: %d",
        ),
    }
    for c, (_, bad, _) in rules.items():
        if c in cols:
            aggs.append(F.count_if(bad).alias(f"bad_{c}"))
    a = feats.agg(*aggs)
    checks = [("Feature data row count", F.col("n"), "Feature rows: %d", F.col("n") > 0)]
    if "thread_label" in cols:
        checks.append(("Feature data missing labels", F.col("null_labels"), "Missing labels: %d", F.col("null_labels") == 0))
    checks.append(
        (
            "Feature data missing numeric values",
            F.col("null_numeric"),
            "Missing numeric feature values: %d",
            F.col("null_numeric") == 0,
        )
    )
    for c, (name, _, fmt) in rules.items():
        if c in cols:
            checks.append((name, F.col(f"bad_{c}"), fmt, F.col(f"bad_{c}") == 0))
    return _results(a, plan, checks)


# ---- fixed values (names of the presence checks) ----
PARSED_EXISTS, FEATURES_EXIST = "Parsed CSV exists", "Feature CSV exists"


def presence_checks(spark: SparkSession, parsed_path: str, features_path: str) -> DataFrame:
    """(check_order, check, status, detail) for the two processed inputs; ``raise_on_failure`` then stops."""
    from ..sources.tables import input_presence

    names = F.create_map(F.lit(parsed_path), F.lit(PARSED_EXISTS), F.lit(features_path), F.lit(FEATURES_EXIST))
    order = F.create_map(F.lit(parsed_path), F.lit(0), F.lit(features_path), F.lit(1))
    return input_presence(spark, [parsed_path, features_path]).select(
        order[F.col("path")].alias("check_order"), names[F.col("path")].alias("check"),
        F.when(F.col("exists"), "PASS").otherwise("FAIL").alias("status"), F.col("path").alias("detail"),
    )


def failed_checks(*results: DataFrame) -> DataFrame:
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.where(F.col("status") == "FAIL")


def raise_on_failure(results: DataFrame) -> None:
    """Driver guard like the reference's final ValueError; only a count crosses to the driver."""
    n = results.where(F.col("status") == "FAIL").count()
    if n:
        raise ValueError(f"Validation failed. Failed checks: {n}")


def label_domain(df: DataFrame, label: str = "thread_label") -> DataFrame:
    """Labels outside {0, 1} (NULL excluded, as a set of unique non-null values would)."""
    return df.agg(
        F.count_if(F.col(label).isNotNull() & ~F.col(label).isin(0, 1)).alias("n_outside"),
        F.count_distinct(F.col(label)).alias("n_distinct"),
    ).select("n_outside", "n_distinct", (F.col("n_outside") == 0).alias("is_binary"))
