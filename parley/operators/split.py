"""Reproducible stratified split, K-fold and nested K-fold as columns (never driver id lists).

Order within a class is ``md5('<seed>:<id>')`` then id: deterministic, seedable, and
identical in any SQL engine. Ranks are computed without a per-class global sort:
rows are bucketed by the first hex digits of the hash, bucket sizes are counted
(at most classes x 16^digits rows, and no more than there are rows), joined back with
their running offsets, and ``row_number`` runs inside (class, bucket) groups. The result
equals ``row_number() over (partition by label order by hash, id)``. Classes may be as many
as rows: beyond ONE_TASK_CLASSES the quotas' ranking of classes is distributed too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import SEED
from ..session import cut_lineage
from .ordered import global_rank

BUCKET_HEX_DIGITS = 4  # 65,536 buckets per class
ONE_TASK_CLASSES = 100_000  # classes that one window ranks at most


def shuffle_key(id_col: str, seed) -> Column:
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed_c.cast("string"), F.lit(":"), F.col(id_col).cast("string")))


def stratified_rank(df: DataFrame, id_col: str, label: str, seed=SEED, strata=(), digits: int = BUCKET_HEX_DIGITS) -> DataFrame:
    """Adds ``rank`` (1-based) within (strata..., label) ordered by (md5(seed:id), id).

    ``seed`` may be a Column (e.g. depends on a stratum such as the outer fold). Rows are dealt by
    bucket before they get hash and bucket as columns: these are computed again, not shuffled.
    """
    keys = [*strata, label]
    key = shuffle_key(id_col, seed)
    bucket = F.substring(key, 1, digits)
    sizes = df.withColumn("_b", bucket).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*keys, "_b").orderBy("_h", id_col)
    dealt = df.repartition(*[F.col(k) for k in keys], bucket)
    h = dealt.withColumn("_h", key).withColumn("_b", F.substring("_h", 1, digits))
    ranked = h.join(offsets, [*keys, "_b"]).withColumn("rank", F.col("_off") + F.row_number().over(w))
    return ranked.drop("_h", "_b", "_off")


def class_quotas(df: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """Test rows per class: n_test = ceil(test_size * n), split by largest remainder (ties: smaller label)."""
    return quotas_of(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c")), label, test_size)


def quotas_of(counts: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """The same from class counts (label, n_c); products go through DECIMAL, so any BIGINT count is exact."""
    counts = cut_lineage(counts)  # one row per class
    classes, n = counts.agg(F.count(F.lit(1)), F.sum("n_c")).first()
    n_test = F.ceil(F.lit(test_size) * F.lit(n or 0)).cast("bigint")
    product = "(CAST(n_test AS DECIMAL(19,0)) * CAST(n_c AS DECIMAL(19,0)))"
    q = counts.select(label, "n_c", F.lit(n).cast("bigint").alias("n"), n_test.alias("n_test")).select(
        label,
        "n_test",
        F.expr(f"{product} div CAST(n AS DECIMAL(19,0))").alias("base"),
        F.expr(f"CAST({product} % CAST(n AS DECIMAL(19,0)) AS BIGINT)").alias("rem"),
    )
    left = q.agg(F.max("n_test") - F.sum("base")).first()[0] or 0
    if classes <= ONE_TASK_CLASSES:
        q = q.withColumn("pri", F.row_number().over(Window.orderBy(F.col("rem").desc(), F.col(label))))
    else:
        q = global_rank(q, [F.col("rem").desc(), F.col(label).asc()], "pri")
    q = q.withColumn("left", F.lit(left))
    return q.select(label, (F.col("base") + F.when(F.col("pri") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def stratified_split(df: DataFrame, id_col: str = "orig_index", label: str = "thread_label", test_size: float = 0.2, seed=SEED) -> DataFrame:
    """(id, label, part) with part in {'train','test'}. The quota table has one row per class."""
    return with_part(df.select(id_col, label), id_col, label, test_size, seed)


def with_part(df: DataFrame, id_col: str = "orig_index", label: str = "thread_label", test_size: float = 0.2, seed=SEED) -> DataFrame:
    """df with ``part``, ranked in place: all columns stay with their row, so no join back by id."""
    ranked = stratified_rank(df, id_col, label, seed)
    j = ranked.join(class_quotas(df.select(label), label, test_size), label)
    return j.select(*df.columns, F.when(F.col("rank") <= F.col("quota"), "test").otherwise("train").alias("part"))


def with_folds(df: DataFrame, k: int = 5, id_col: str = "orig_index", label: str = "thread_label", seed=SEED) -> DataFrame:
    """df with ``fold`` in 0..k-1, ranked in place: all columns stay with their row, so no join back by id."""
    ranked = stratified_rank(df, id_col, label, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


def stratified_folds(df: DataFrame, k: int = 5, id_col: str = "orig_index", label: str = "thread_label", seed=SEED) -> DataFrame:
    """(id, label, fold) with fold in 0..k-1; per-class fold sizes differ by at most one."""
    return with_folds(df.select(id_col, label), k, id_col, label, seed)


def nested_folds(
    folds: DataFrame, k_outer: int = 5, k_inner: int = 3, id_col: str = "orig_index", label: str = "thread_label", seed=SEED
) -> DataFrame:
    """For each outer fold f, the rows outside f get an inner fold with seed ``seed + f + 1``.

    Output (id, label, outer_fold, inner_fold); each row appears k_outer-1 times
    (a generator, no join).
    """
    pairs = folds.select(id_col, label, "fold", F.explode(F.sequence(F.lit(0), F.lit(k_outer - 1))).alias("outer_fold"))
    pairs = pairs.where(F.col("fold") != F.col("outer_fold"))
    ranked = stratified_rank(
        pairs.select(id_col, label, "outer_fold"),
        id_col,
        label,
        seed=(F.lit(seed) + F.col("outer_fold") + 1),
        strata=("outer_fold",),
    )
    return ranked.select(id_col, label, "outer_fold", ((F.col("rank") - 1) % k_inner).cast("int").alias("inner_fold"))


def select_part(feats: DataFrame, split: DataFrame, part: str, id_col: str = "orig_index") -> DataFrame:
    """Rows of one part by id (semi-join; never by position)."""
    return feats.join(split.where(F.col("part") == part).select(id_col), id_col, "left_semi")


def heldout(feats: DataFrame, split: DataFrame, id_col: str = "orig_index") -> DataFrame:
    """Complement of the training rows (anti-join)."""
    return feats.join(split.where(F.col("part") == "train").select(id_col), id_col, "left_anti")


def leakage(split: DataFrame, id_col: str = "orig_index") -> DataFrame:
    """Ids in both train and test: must be empty."""
    return split.where(F.col("part") == "train").select(id_col).intersect(split.where(F.col("part") == "test").select(id_col))


def split_summary(split: DataFrame, label: str = "thread_label") -> DataFrame:
    return split.groupBy("part", label).agg(F.count(F.lit(1)).alias("n"))


def split_precheck(df: DataFrame, label: str = "thread_label") -> DataFrame:
    """One pass: rows, null labels, distinct classes, and whether a stratified split is possible."""
    a = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label).isNull()).alias("n_null_labels"),
        F.count_distinct(label).alias("n_classes"),
    )
    return a.select(
        "*", ((F.col("n_rows") > 0) & (F.col("n_null_labels") == 0) & (F.col("n_classes") >= 2)).alias("can_split")
    )
