"""Exact distributed classification metrics, grouped by any keys (model, fold, run, ...).

Counts are ``count_if`` in one hash aggregate (map-side partial). Zero divisions give
0 (the reference's ``zero_division=0``); a one-class group has NULL AUC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import bucketed

DIGITS = 10


def rnd(c: Column) -> Column:
    """For the last projection of a query only; operators don't round."""
    return F.round(c, DIGITS)


def rounded(df: DataFrame) -> DataFrame:
    """All double columns rounded, for the last projection of a query."""
    return df.select(*[rnd(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def zdiv(a, b) -> Column:
    """a / b, or 0 when b is 0 (``try_divide`` keeps ANSI mode from raising)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binarize(p, t) -> Column:
    """Threshold rule ``p >= t`` as 0/1."""
    pc = F.col(p) if isinstance(p, str) else p
    tc = t if isinstance(t, Column) else F.lit(t)
    return (pc >= tc).cast("int")


def predict_label(p) -> Column:
    """Class prediction of a fitted classifier: 1 only when P(1) > 0.5 (ties go to class 0)."""
    pc = F.col(p) if isinstance(p, str) else p
    return (pc > F.lit(0.5)).cast("int")


def confusion(df: DataFrame, y: str, pred: str, keys=()) -> DataFrame:
    yc, pc = F.col(y), F.col(pred)
    return df.groupBy(*keys).agg(
        F.count_if((yc == 0) & (pc == 0)).alias("true_negative"),
        F.count_if((yc == 0) & (pc == 1)).alias("false_positive"),
        F.count_if((yc == 1) & (pc == 0)).alias("false_negative"),
        F.count_if((yc == 1) & (pc == 1)).alias("true_positive"),
    )


def metric_pairs(tn="true_negative", fp="false_positive", fn="false_negative", tp="true_positive"):
    tn, fp, fn, tp = (F.col(c) for c in (tn, fp, fn, tp))
    return [
        ("accuracy", zdiv(tp + tn, tp + tn + fp + fn)),
        ("precision", zdiv(tp, tp + fp)),
        ("recall", zdiv(tp, tp + fn)),
        ("f1", zdiv(2 * tp, 2 * tp + fp + fn)),
    ]


def metric_columns(**kw):
    return [c.alias(n) for n, c in metric_pairs(**kw)]


def classification_metrics(df: DataFrame, y: str, pred: str, keys=()) -> DataFrame:
    c = confusion(df, y, pred, keys)
    return c.select(*keys, "true_negative", "false_positive", "false_negative", "true_positive", *metric_columns())


def roc_auc(df: DataFrame, y: str, score: str, keys=(), weight: str | None = None) -> DataFrame:
    """Tie-aware ROC AUC (Mann-Whitney): sum over scores of n_pos * (neg_below + n_neg / 2) / (P * N).

    Scores are compacted to (keys, score, n_pos, n_neg) first; the running count of
    negatives uses the bucketed prefix sum, so no group is sorted in one task.
    """
    keys = list(keys)
    wc = F.col(weight) if weight else F.lit(1)
    compact = df.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(y) == 1, wc).otherwise(0)).cast("bigint").alias("n_pos"),
        F.sum(F.when(F.col(y) == 0, wc).otherwise(0)).cast("bigint").alias("n_neg"),
    )
    compact = cut_lineage(compact)  # small (distinct scores); read twice below, the source only once
    return auc_of_counts(compact, score, keys)


def auc_of_counts(compact: DataFrame, score: str, keys=()) -> DataFrame:
    """AUC from (keys, score, n_pos, n_neg), one row per score. Twice the number of ordered pairs is
    summed as DECIMAL(38,0): exact, whatever the order and however large the counts. Pairs inside a
    bucket of scores are counted there; those with lower buckets from the buckets' sums."""
    keys = list(keys)

    def times(a, b):
        return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)")

    inside = Window.partitionBy(*keys, "_bk").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = bucketed(compact.select(*keys, score, "n_pos", "n_neg"), keys, score).withColumn("_cum", F.sum("n_neg").over(inside))
    rows = cum.select(*keys, "_bk", "n_pos", "n_neg", times(F.col("n_pos"), 2 * F.col("_cum") - F.col("n_neg")).alias("u2"))
    buckets = rows.groupBy(*keys, "_bk").agg(F.sum("u2").alias("u2"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    lower = F.sum("n_neg").over(Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1))
    part = buckets.withColumn("_lower", F.coalesce(lower, F.lit(0)))
    part = part.select(*keys, "n_pos", "n_neg", (F.col("u2") + times(F.col("n_pos"), 2 * F.col("_lower"))).cast("decimal(38,0)").alias("u2"))
    agg = part.groupBy(*keys).agg(F.sum("u2").cast("double").alias("u2"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    both = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return agg.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u2") / 2.0 / both).alias("roc_auc"))


def brier(df: DataFrame, y: str, p: str, keys=()) -> DataFrame:
    d = F.col(p) - F.col(y)
    return df.groupBy(*keys).agg(F.avg(d * d).alias("brier_score"))


def fold_metrics(df: DataFrame, y: str, p: str, keys, threshold: float = 0.5, rule: str = ">=", weight: str | None = None, with_brier: bool = True, keep=cut_lineage) -> DataFrame:
    """accuracy/precision/recall/f1 at a threshold + AUC + Brier (unless it isn't wanted) per group.

    Scores are compacted once; their counts, kept by ``keep``, give all metrics, so the source is read once.
    ``weight`` holds row multiplicities when rows were compacted (integer counts)."""
    wc = F.col(weight) if weight else F.lit(1)
    scored = df.select(*keys, F.col(y).alias("_y"), F.col(p).alias("_p"), wc.cast("bigint").alias("_w"))
    d = F.col("_p") - F.col("_y")

    def cnt(cond, n="_w"):
        return F.sum(F.when(cond, F.col(n)).otherwise(0)).cast("bigint")

    squares = [F.sum(F.col("_w") * d * d).alias("_sq"), F.sum("_w").alias("_n")] if with_brier else []
    counts = scored.groupBy(*keys, "_p").agg(cnt(F.col("_y") == 1).alias("n_pos"), cnt(F.col("_y") == 0).alias("n_neg"), *squares)
    counts = keep(counts)
    pred = binarize("_p", threshold) if rule == ">=" else (F.col("_p") > F.lit(threshold)).cast("int")
    base = counts.withColumn("_pred", pred).groupBy(*keys).agg(
        cnt(F.col("_pred") == 0, "n_neg").alias("true_negative"),
        cnt(F.col("_pred") == 1, "n_neg").alias("false_positive"),
        cnt(F.col("_pred") == 0, "n_pos").alias("false_negative"),
        cnt(F.col("_pred") == 1, "n_pos").alias("true_positive"),
        *([(F.sum("_sq") / F.sum("_n")).alias("brier_score")] if with_brier else []),
    )
    auc = auc_of_counts(counts.select(*keys, "_p", "n_pos", "n_neg"), "_p", keys).select(*keys, "roc_auc")
    return base.join(auc, list(keys)).select(
        *keys, *[c.alias(n) for n, c in metric_pairs()], "roc_auc", *(["brier_score"] if with_brier else [])
    )


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages (long form)."""
    c = confusion(df, y, pred)
    tn, fp, fn, tp = (F.col(x) for x in ("true_negative", "false_positive", "false_negative", "true_positive"))
    classes = F.array(
        F.struct(F.lit("0").alias("label"), zdiv(tn, tn + fn).alias("precision"), zdiv(tn, tn + fp).alias("recall"),
                 zdiv(2 * tn, 2 * tn + fn + fp).alias("f1_score"), (tn + fp).cast("double").alias("support")),
        F.struct(F.lit("1").alias("label"), zdiv(tp, tp + fp).alias("precision"), zdiv(tp, tp + fn).alias("recall"),
                 zdiv(2 * tp, 2 * tp + fp + fn).alias("f1_score"), (tp + fn).cast("double").alias("support")),
    )
    per = c.select(F.explode(classes).alias("r")).select("r.*")
    macro = per.agg(
        F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1_score").alias("f1_score"), F.sum("support").alias("support"),
    )
    weighted = per.agg(
        F.lit("weighted avg").alias("label"),
        zdiv(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("precision"),
        zdiv(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("recall"),
        zdiv(F.sum(F.col("f1_score") * F.col("support")), F.sum("support")).alias("f1_score"),
        F.sum("support").alias("support"),
    )
    acc = c.select(
        F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
        zdiv(tp + tn, tp + tn + fp + fn).alias("f1_score"), (tp + tn + fp + fn).cast("double").alias("support"),
    )
    out = per.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("label", "precision", "recall", "f1_score", "support")


METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def summarize(df: DataFrame, keys, metrics=METRICS, sample_std: bool = False) -> DataFrame:
    """Mean and std per group; population std (CV/grid tables) or sample std (calibration/ablation)."""
    std = F.stddev_samp if sample_std else F.stddev_pop
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), std(m).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*aggs)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """``balanced`` weights n / (k * n_c), one row per class (k = number of classes)."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.withColumn("_j", F.lit(1)).join(F.broadcast(tot.withColumn("_j", F.lit(1))), "_j").select(y, "n_c", (F.col("n").cast("double") / (F.col("k") * F.col("n_c"))).alias("class_weight"))


def standardization_stats(df: DataFrame, cols) -> DataFrame:
    """One row: mean and population std per feature (a zero std scales by 1, like StandardScaler)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.agg(*aggs)


def standardize(df: DataFrame, cols, stats: DataFrame | None = None, keep=()) -> DataFrame:
    """(x - mean) / std with statistics from ``stats`` (e.g. the training rows); one-row broadcast."""
    stats = stats if stats is not None else standardization_stats(df, cols)
    j = df.withColumn("_j", F.lit(1)).join(F.broadcast(stats.withColumn("_j", F.lit(1))), "_j")
    out = [F.col(k) for k in keep]
    for c in cols:
        sd = F.col(f"{c}__std")
        out.append(((F.col(c) - F.col(f"{c}__mean")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)).alias(c))
    return j.select(*out)
