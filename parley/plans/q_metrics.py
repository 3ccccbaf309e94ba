"""Queries: metrics, sweeps, thresholds, bands, fold summaries, selection.

Workload on ``lineitem``: y = (l_returnflag = 'R'); two fixed scorers
'quantity' (p = l_quantity / 50) and 'discount' (p = 1 - 10 * l_discount);
stratified 5-fold assignment by md5 order as in ``split``; 'raw' and 'sqrt'
calibration variants (p and sqrt(p)).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fmt import mean_std_text
from ..operators import metrics as M
from ..operators import split as S
from ..operators import thresholds as T
from ..sources import tables as src
from .registry import register

MODELS = ["quantity", "discount"]  # model order = tie order (first wins)


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # order and line number alone are no key of the test table


def lineitem_rows(spark, sf_dir, cols):
    """(id, y, cols): one row per line item, with an id that is unique."""
    li = src.table(spark, sf_dir, "lineitem").select(*KEY, "l_returnflag", *cols)
    return li.select(F.concat_ws(":", *KEY).alias("id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), *cols)


def lineitem_labels(spark, sf_dir):
    return lineitem_rows(spark, sf_dir, ["l_quantity", "l_discount"])


def scorers(rows):
    """Both scorers' rows: a generator over the rows, no join."""
    arr = F.array(
        F.struct(F.lit("quantity").alias("model"), (F.col("l_quantity") / 50.0).alias("p")),
        F.struct(F.lit("discount").alias("model"), (F.lit(1.0) - F.col("l_discount") * 10.0).alias("p")),
    )
    kept = [c for c in rows.columns if c in ("id", "y", "fold")]
    return rows.select(*kept, F.explode(arr).alias("s")).select(*kept, "s.model", "s.p")


def scores(spark, sf_dir):
    """(id, y, model, p) for both scorers."""
    return scorers(lineitem_labels(spark, sf_dir))


def fold_scores(spark, sf_dir):
    """(id, y, fold, model, p): rows get their fold where they stand, then both scores."""
    return scorers(S.with_folds(lineitem_labels(spark, sf_dir), 5, id_col="id", label="y"))


def calib_scores(spark, sf_dir):
    fs = fold_scores(spark, sf_dir)
    arr = F.array(
        F.struct(F.lit("raw").alias("calibration_method"), F.col("p").alias("q")),
        F.struct(F.lit("sqrt").alias("calibration_method"), F.sqrt("p").alias("q")),
    )
    return fs.select("id", "y", "model", "fold", F.explode(arr).alias("c")).select(
        "id", "y", "model", "fold", "c.calibration_method", F.col("c.q").alias("p")
    )


def cv_fold_metrics(spark, sf_dir):
    return M.fold_metrics(fold_scores(spark, sf_dir), "y", "p", ["model", "fold"])


def cv_summary(spark, sf_dir):
    return M.summarize(cv_fold_metrics(spark, sf_dir), ["model"])


def calibration_summary(spark, sf_dir):
    fm = M.fold_metrics(calib_scores(spark, sf_dir), "y", "p", ["model", "calibration_method", "fold"])
    return M.summarize(fm, ["model", "calibration_method"], M.METRICS + ["brier_score"], sample_std=True)


# ------------------------------------------------------------------------------------------------
# SQL side
# ------------------------------------------------------------------------------------------------
R = 10
ID_SQL = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
FOLD_SQL = "CAST((row_number() OVER (PARTITION BY l_returnflag = 'R' ORDER BY md5('42:' || " + ID_SQL + "), " + ID_SQL + ") - 1) % 5 AS INTEGER) AS fold"
LI = f"""li AS (SELECT {ID_SQL} AS id, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity, l_discount FROM lineitem),
sc AS (SELECT id, y, 'quantity' AS model, l_quantity / 50.0 AS p FROM li
       UNION ALL SELECT id, y, 'discount' AS model, 1.0 - l_discount * 10.0 AS p FROM li),
fo AS (SELECT {ID_SQL} AS id, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity, l_discount, {FOLD_SQL} FROM lineitem),
fs AS (SELECT id, y, fold, 'quantity' AS model, l_quantity / 50.0 AS p FROM fo
       UNION ALL SELECT id, y, fold, 'discount' AS model, 1.0 - l_discount * 10.0 AS p FROM fo),
cs AS (SELECT id, y, model, fold, 'raw' AS calibration_method, p FROM fs
       UNION ALL SELECT id, y, model, fold, 'sqrt' AS calibration_method, sqrt(p) AS p FROM fs)"""


def conf_sql(keys: str, src_: str, pred: str) -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return (
        f"SELECT {k}count(*) FILTER (WHERE y = 0 AND {pred} = 0) AS true_negative, "
        f"count(*) FILTER (WHERE y = 0 AND {pred} = 1) AS false_positive, "
        f"count(*) FILTER (WHERE y = 1 AND {pred} = 0) AS false_negative, "
        f"count(*) FILTER (WHERE y = 1 AND {pred} = 1) AS true_positive FROM {src_}{g}"
    )


def zdiv(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


MET = {
    "accuracy": zdiv("true_positive + true_negative", "true_positive + true_negative + false_positive + false_negative"),
    "precision": zdiv("true_positive", "true_positive + false_positive"),
    "recall": zdiv("true_positive", "true_positive + false_negative"),
    "f1": zdiv("2 * true_positive", "2 * true_positive + false_positive + false_negative"),
}


def auc_sql(keys: str, src_: str) -> str:
    return f"""(SELECT {keys}, CAST(sum(n_pos) AS BIGINT) AS n_pos, CAST(sum(n_neg) AS BIGINT) AS n_neg,
  CASE WHEN sum(n_pos) > 0 AND sum(n_neg) > 0 THEN sum(n_pos * (coalesce(below, 0) + n_neg / 2.0)) / (CAST(sum(n_pos) AS DOUBLE) * sum(n_neg)) END AS roc_auc
FROM (SELECT {keys}, n_pos, n_neg, sum(n_neg) OVER (PARTITION BY {keys} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM (SELECT {keys}, p, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM {src_} GROUP BY {keys}, p) c) w
GROUP BY {keys})"""


def fold_metrics_sql(keys: str, src_: str) -> str:
    keyl = [k.strip() for k in keys.split(",")]
    using = ", ".join(keyl)
    mets = ", ".join(f"{v} AS {k}" for k, v in MET.items())
    return f"""(SELECT b.*, a.roc_auc FROM
 (SELECT {keys}, {mets}, brier_raw AS brier_score FROM
   (SELECT {keys}, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS true_negative, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS false_positive,
           count(*) FILTER (WHERE y = 1 AND p < 0.5) AS false_negative, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS true_positive,
           avg((p - y) * (p - y)) AS brier_raw FROM {src_} GROUP BY {keys}) c) b
 JOIN {auc_sql(keys, src_)} a USING ({using}))"""


def summary_sql(keys: str, src_: str, metrics, std: str) -> str:
    cols = ", ".join(f"avg({m}) AS {m}_mean, {std}({m}) AS {m}_std" for m in metrics)
    return f"SELECT {keys}, {cols} FROM {src_} GROUP BY {keys}"


def rounded_sql(cols, src_: str) -> str:
    """SELECT of cols from src_, those with a point rounded: 'a' stays, '.a' is rounded."""
    return "SELECT " + ", ".join(f"round({c[1:]}, {R}) AS {c[1:]}" if c[0] == "." else c for c in cols) + f" FROM {src_}"


def W(select: str, extra: str = "") -> str:
    return f"WITH {LI}{extra}\n{select}"


METRICS5 = ["accuracy", "precision", "recall", "f1", "roc_auc"]
CV_SUMMARY_SQL = summary_sql("model", fold_metrics_sql("model, fold", "fs"), METRICS5, "stddev_pop")
CAL_SUMMARY_SQL = summary_sql(
    "model, calibration_method", fold_metrics_sql("model, calibration_method, fold", "cs"), METRICS5 + ["brier_score"], "stddev_samp"
)
MEANS = [f".{m}_{s}" for m in METRICS5 for s in ("mean", "std")]
CAL_MEANS = MEANS + [".brier_score_mean", ".brier_score_std"]


SWEEP_SQL = f""",
per AS (SELECT model, p, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM sc GROUP BY model, p),
sw0 AS (SELECT model, CAST(g.range AS INTEGER) AS g, sum(n_pos) AS P, sum(n_neg) AS N,
          coalesce(sum(n_pos) FILTER (WHERE p >= g.range / 100.0), 0) AS tp, coalesce(sum(n_neg) FILTER (WHERE p >= g.range / 100.0), 0) AS fp
        FROM per JOIN range(5, 96) g ON true GROUP BY ALL),
sw AS (SELECT model, g / 100.0 AS threshold, CAST(tp AS BIGINT) AS true_positive, CAST(fp AS BIGINT) AS false_positive,
         CAST(P - tp AS BIGINT) AS false_negative, CAST(N - fp AS BIGINT) AS true_negative, CAST(tp + fp AS BIGINT) AS n_predicted_positive,
         {zdiv('tp', 'tp + fp')} AS precision, {zdiv('tp', 'P')} AS recall, {zdiv('2 * tp', 'tp + P + fp')} AS f1 FROM sw0),
bf AS (SELECT model, threshold, precision, recall, f1, 'best F1 fallback' AS basis FROM
        (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rn FROM sw) WHERE rn = 1),
pc AS (SELECT model, threshold, precision, recall, f1, 'precision >= 0.9' AS basis FROM
        (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, recall DESC, threshold) AS rn FROM sw
         WHERE n_predicted_positive > 0 AND precision >= 0.9) WHERE rn = 1),
rc AS (SELECT model, threshold, precision, recall, f1, 'recall >= 0.9' AS basis FROM
        (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, precision DESC, threshold) AS rn FROM sw
         WHERE recall >= 0.9) WHERE rn = 1),
tp_sel AS (SELECT * FROM pc UNION ALL SELECT * FROM bf WHERE model NOT IN (SELECT model FROM pc)),
tr_sel AS (SELECT * FROM rc UNION ALL SELECT * FROM bf WHERE model NOT IN (SELECT model FROM rc)),
bj AS (SELECT m.model, CASE WHEN m.threshold >= h.threshold THEN 0.33 ELSE m.threshold END AS m,
              CASE WHEN m.threshold >= h.threshold THEN 0.66 ELSE h.threshold END AS h,
              CASE WHEN m.threshold >= h.threshold THEN '{T.FALLBACK_BASIS}'
                   ELSE 'medium threshold based on ' || m.basis || '; high threshold based on ' || h.basis END AS threshold_basis
       FROM tr_sel m JOIN tp_sel h USING (model)),
bands AS (SELECT model, 'Low' AS risk_band, 0.0 AS probability_min, m AS probability_max_exclusive, '{T.BAND_ACTIONS["Low"]}' AS recommended_action, threshold_basis FROM bj
          UNION ALL SELECT model, 'Medium', m, h, '{T.BAND_ACTIONS["Medium"]}', threshold_basis FROM bj
          UNION ALL SELECT model, 'High', h, 1.01, '{T.BAND_ACTIONS["High"]}', threshold_basis FROM bj)"""


@register("binarize", W("SELECT id, model, p, CAST(p >= 0.5 AS INTEGER) AS pred FROM sc"))
def q_binarize(spark, sf_dir):
    return scores(spark, sf_dir).select("id", "model", "p", M.binarize("p", 0.5).alias("pred"))


@register("confusion_matrix", W(conf_sql("model", "(SELECT *, CAST(p >= 0.5 AS INTEGER) AS pred FROM sc) t", "pred")))
def q_confusion_matrix(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("pred", M.binarize("p", 0.5))
    return M.confusion(s, "y", "pred", ["model"])


@register(
    "classification_metrics",
    W(
        "SELECT *, "
        + ", ".join(f"{v} AS {k}" for k, v in MET.items())
        + " FROM ("
        + conf_sql("model", "(SELECT *, CAST(p >= 0.5 AS INTEGER) AS pred FROM sc) t", "pred")
        + ") c"
    ),
)
def q_classification_metrics(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("pred", M.binarize("p", 0.5))
    return M.classification_metrics(s, "y", "pred", ["model"])


@register("roc_auc", W(rounded_sql(["model", "n_pos", "n_neg", ".roc_auc"], f"{auc_sql('model', 'sc')} a")))
def q_roc_auc(spark, sf_dir):
    return M.rounded(M.roc_auc(scores(spark, sf_dir), "y", "p", ["model"]))


@register("brier_score", W(f"SELECT model, round(avg((p - y) * (p - y)), {R}) AS brier_score FROM sc GROUP BY model"))
def q_brier_score(spark, sf_dir):
    return M.rounded(M.brier(scores(spark, sf_dir), "y", "p", ["model"]))


def _report_sql() -> str:
    c = conf_sql("", "(SELECT *, CAST(p > 0.5 AS INTEGER) AS pred FROM sc WHERE model = 'quantity') t", "pred")
    per = f"""per AS (SELECT '0' AS label, {zdiv('true_negative', 'true_negative + false_negative')} AS precision,
              {zdiv('true_negative', 'true_negative + false_positive')} AS recall,
              {zdiv('2 * true_negative', '2 * true_negative + false_negative + false_positive')} AS f1_score,
              CAST(true_negative + false_positive AS DOUBLE) AS support FROM c
       UNION ALL SELECT '1', {MET['precision']}, {MET['recall']}, {MET['f1']}, CAST(true_positive + false_negative AS DOUBLE) FROM c),
allr AS (SELECT * FROM per
       UNION ALL SELECT 'accuracy', NULL, NULL, {MET['accuracy']}, CAST(true_positive + true_negative + false_positive + false_negative AS DOUBLE) FROM c
       UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM per
       UNION ALL SELECT 'weighted avg', {zdiv('sum(precision * support)', 'sum(support)')}, {zdiv('sum(recall * support)', 'sum(support)')},
                 {zdiv('sum(f1_score * support)', 'sum(support)')}, sum(support) FROM per)"""
    return W(
        f"SELECT label, round(precision, {R}) AS precision, round(recall, {R}) AS recall, round(f1_score, {R}) AS f1_score, support FROM allr",
        f",\nc AS ({c}),\n{per}",
    )


@register("classification_report", _report_sql())
def q_classification_report(spark, sf_dir):
    s = scores(spark, sf_dir).where(F.col("model") == "quantity").withColumn("pred", M.predict_label("p"))
    return M.rounded(M.classification_report(s, "y", "pred"))


@register("cv_fold_metrics", W(rounded_sql(["model", "fold", *[f".{m}" for m in METRICS5], ".brier_score"], f"{fold_metrics_sql('model, fold', 'fs')} m")))
def q_cv_fold_metrics(spark, sf_dir):
    return M.rounded(cv_fold_metrics(spark, sf_dir))


@register("cv_summary", W(rounded_sql(["model", *MEANS], f"({CV_SUMMARY_SQL}) s")))
def q_cv_summary(spark, sf_dir):
    return M.rounded(cv_summary(spark, sf_dir))


@register("calibration_summary", W(rounded_sql(["model", "calibration_method", *CAL_MEANS], f"({CAL_SUMMARY_SQL}) s")))
def q_calibration_summary(spark, sf_dir):
    return M.rounded(calibration_summary(spark, sf_dir))


@register(
    "cv_summary_formatted",
    W(
        "SELECT model, "
        + ", ".join(f"printf('%.4f (+/- %.4f)', {m}_mean, {m}_std) AS {m}" for m in METRICS5)
        + f" FROM ({CV_SUMMARY_SQL}) s"
    ),
)
def q_cv_summary_formatted(spark, sf_dir):
    s = cv_summary(spark, sf_dir)
    return s.select("model", *[mean_std_text(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m) for m in METRICS5])


@register(
    "best_model",
    W(
        "SELECT metric, model, round(score, 10) AS score FROM (SELECT metric, model, score, row_number() OVER (PARTITION BY metric ORDER BY score DESC, "
        "CASE model WHEN 'quantity' THEN 0 ELSE 1 END) AS rn FROM (SELECT 'f1' AS metric, model, f1_mean AS score FROM s "
        "UNION ALL SELECT 'roc_auc', model, roc_auc_mean FROM s) u) r WHERE rn = 1",
        f",\ns AS ({CV_SUMMARY_SQL})",
    ),
)
def q_best_model(spark, sf_dir):
    from ..operators.selection import best_per_metric

    return M.rounded(best_per_metric(cv_summary(spark, sf_dir), ["f1", "roc_auc"], MODELS))


@register(
    "select_calibration",
    W(rounded_sql(["model", "calibration_method", *CAL_MEANS], f"(SELECT * FROM ({CAL_SUMMARY_SQL}) s ORDER BY brier_score_mean, f1_mean DESC LIMIT 1) b")),
)
def q_select_calibration(spark, sf_dir):
    return M.rounded(calibration_summary(spark, sf_dir).orderBy(F.col("brier_score_mean"), F.col("f1_mean").desc()).limit(1))


@register(
    "class_weights",
    W("SELECT y, n_c, CAST(sum(n_c) OVER () AS DOUBLE) / (count(*) OVER () * n_c) AS class_weight FROM (SELECT y, count(*) AS n_c FROM li GROUP BY y) c"),
)
def q_class_weights(spark, sf_dir):
    return M.class_weights(lineitem_labels(spark, sf_dir), "y")


STD_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "standardize_features",
    "WITH st AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}__mean, stddev_pop({c}) AS {c}__std" for c in STD_COLS)
    + f") SELECT {ID_SQL} AS id, "
    + ", ".join(f"round(({c} - {c}__mean) / CASE WHEN {c}__std = 0 THEN 1.0 ELSE {c}__std END, {R}) AS {c}" for c in STD_COLS)
    + " FROM lineitem JOIN (SELECT " + ", ".join(f"avg({c}) AS {c}__mean, stddev_pop({c}) AS {c}__std" for c in STD_COLS)
    + " FROM lineitem) st ON true",
)
def q_standardize_features(spark, sf_dir):
    li = lineitem_rows(spark, sf_dir, STD_COLS)
    z = M.standardize(li, STD_COLS, keep=["id"])
    return z.select("id", *[M.rnd(F.col(c)).alias(c) for c in STD_COLS])


@register(
    "threshold_grid",
    W(
        "SELECT threshold, n_predicted_positive FROM sw WHERE model = 'quantity'",
        SWEEP_SQL,
    ),
)
def q_threshold_grid(spark, sf_dir):
    sw = T.sweep(scores(spark, sf_dir).where(F.col("model") == "quantity"), "y", "p")
    return sw.select("threshold", "n_predicted_positive")


@register("threshold_sweep", W("SELECT * FROM sw", SWEEP_SQL))
def q_threshold_sweep(spark, sf_dir):
    return T.sweep(scores(spark, sf_dir), "y", "p", ["model"])


@register("threshold_precision", W("SELECT * FROM tp_sel", SWEEP_SQL))
def q_threshold_precision(spark, sf_dir):
    return T.for_precision(T.sweep(scores(spark, sf_dir), "y", "p", ["model"]), 0.9, ["model"])


@register("threshold_recall", W("SELECT * FROM tr_sel", SWEEP_SQL))
def q_threshold_recall(spark, sf_dir):
    return T.for_recall(T.sweep(scores(spark, sf_dir), "y", "p", ["model"]), 0.9, ["model"])


@register("threshold_best_f1", W("SELECT * FROM bf", SWEEP_SQL))
def q_threshold_best_f1(spark, sf_dir):
    return T.best_f1(T.sweep(scores(spark, sf_dir), "y", "p", ["model"]), ["model"])


@register("risk_bands", W("SELECT * FROM bands", SWEEP_SQL))
def q_risk_bands(spark, sf_dir):
    return T.risk_bands(T.sweep(scores(spark, sf_dir), "y", "p", ["model"]), ["model"])


@register(
    "assign_risk_band",
    W(
        "SELECT sc.id, sc.y, sc.model, sc.p, bands.risk_band FROM sc LEFT JOIN bands ON sc.model = bands.model "
        "AND sc.p >= bands.probability_min AND sc.p < bands.probability_max_exclusive",
        SWEEP_SQL,
    ),
)
def q_assign_risk_band(spark, sf_dir):
    s = scores(spark, sf_dir)
    bands = T.risk_bands(T.sweep(s, "y", "p", ["model"]), ["model"])
    return T.assign_band(s, bands, "p", ["model"])
