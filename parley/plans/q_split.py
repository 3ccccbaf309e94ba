"""Queries: split pre-check, stratified split, folds, nested folds, train/held-out selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split as S
from . import oracle_sql as O
from .registry import features, register


def split_of(spark, sf_dir):
    return S.stratified_split(features(spark, sf_dir))


def train_of(spark, sf_dir):
    f = features(spark, sf_dir)
    return S.select_part(f, S.stratified_split(f), "train")


def folds_of(spark, sf_dir):
    return S.stratified_folds(train_of(spark, sf_dir))


SPLIT_SQL = """,
cls AS (SELECT thread_label, count(*) AS n_c FROM features GROUP BY thread_label),
tot AS (SELECT sum(n_c) AS n, CAST(ceil(0.2 * sum(n_c)) AS BIGINT) AS n_test FROM cls),
q0 AS (SELECT c.thread_label, (t.n_test * c.n_c) // t.n AS base, (t.n_test * c.n_c) % t.n AS rem, t.n_test FROM cls c JOIN tot t ON true),
q1 AS (SELECT thread_label, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, thread_label) <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q0),
rk AS (SELECT orig_index, thread_label, row_number() OVER (PARTITION BY thread_label ORDER BY md5('42:' || CAST(orig_index AS VARCHAR)), orig_index) AS rnk FROM features),
split AS (SELECT rk.orig_index, rk.thread_label, CASE WHEN rnk <= quota THEN 'test' ELSE 'train' END AS part FROM rk JOIN q1 USING (thread_label)),
train AS (SELECT * FROM features WHERE orig_index IN (SELECT orig_index FROM split WHERE part = 'train')),
folds AS (SELECT orig_index, thread_label, CAST((row_number() OVER (PARTITION BY thread_label ORDER BY md5('42:' || CAST(orig_index AS VARCHAR)), orig_index) - 1) % 5 AS INTEGER) AS fold FROM train)"""


def with_split(select: str) -> str:
    return f"WITH {O.FEATURES}{SPLIT_SQL}\n{select}"


@register(
    "split_precheck",
    O.with_features(
        "SELECT count(*) AS n_rows, count(*) FILTER (WHERE thread_label IS NULL) AS n_null_labels, "
        "count(DISTINCT thread_label) AS n_classes, (count(*) > 0 AND count(*) FILTER (WHERE thread_label IS NULL) = 0 "
        "AND count(DISTINCT thread_label) >= 2) AS can_split FROM features"
    ),
)
def q_split_precheck(spark, sf_dir):
    return S.split_precheck(features(spark, sf_dir))


@register("stratified_split", with_split("SELECT orig_index, thread_label, part FROM split"))
def q_stratified_split(spark, sf_dir):
    return split_of(spark, sf_dir)


@register("stratified_folds", with_split("SELECT orig_index, thread_label, fold FROM folds"))
def q_stratified_folds(spark, sf_dir):
    return folds_of(spark, sf_dir)


NESTED_SQL = """,
pairs AS (SELECT f.orig_index, f.thread_label, CAST(o.range AS INTEGER) AS outer_fold FROM folds f JOIN range(0, 5) o ON f.fold <> o.range)
SELECT orig_index, thread_label, outer_fold,
       CAST((row_number() OVER (PARTITION BY outer_fold, thread_label
             ORDER BY md5(CAST(42 + outer_fold + 1 AS VARCHAR) || ':' || CAST(orig_index AS VARCHAR)), orig_index) - 1) % 3 AS INTEGER) AS inner_fold
FROM pairs"""


@register("nested_folds", f"WITH {O.FEATURES}{SPLIT_SQL}{NESTED_SQL}")
def q_nested_folds(spark, sf_dir):
    return S.nested_folds(folds_of(spark, sf_dir))


@register("train_rows", with_split("SELECT * FROM train"))
def q_train_rows(spark, sf_dir):
    return train_of(spark, sf_dir)


@register(
    "heldout_rows",
    with_split("SELECT * FROM features WHERE orig_index NOT IN (SELECT orig_index FROM split WHERE part = 'train')"),
)
def q_heldout_rows(spark, sf_dir):
    f = features(spark, sf_dir)
    return S.heldout(f, S.stratified_split(f))


@register(
    "split_leakage",
    with_split(
        "SELECT orig_index FROM split WHERE part = 'train' INTERSECT SELECT orig_index FROM split WHERE part = 'test'"
    ),
)
def q_split_leakage(spark, sf_dir):
    return S.leakage(split_of(spark, sf_dir))


@register(
    "split_summary",
    with_split("SELECT part, thread_label, count(*) AS n FROM split GROUP BY part, thread_label"),
)
def q_split_summary(spark, sf_dir):
    return S.split_summary(split_of(spark, sf_dir))


@register("split_roundtrip", with_split("SELECT orig_index, thread_label, part FROM split"))
def q_split_roundtrip(spark, sf_dir):
    """Split written as JSON lines (partitioned by part) under the shared checkpoint folder and read back."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.splits import read_split_json, write_split_json

    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/split-{uuid.uuid4().hex}"
    write_split_json(split_of(spark, sf_dir), path)
    return read_split_json(spark, path)


@register("split_payload")
def q_split_payload(spark, sf_dir):
    from ..sources.splits import split_payload_summary

    return split_payload_summary(split_of(spark, sf_dir))
