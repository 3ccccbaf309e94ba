"""Queries with SQL oracles for the model-side operators: exact best split, isotonic fit and
apply, fixed models (example tree rules and coefficients, Platt parameters),
fixed-model ablation with drops, grid rank, union by name (I5, I11, I20, C4, F6, E5, G1)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import STRUCTURAL_FEATURES
from ..operators import calibrate as CAL
from ..operators import metrics as M
from ..operators import modelling as MD
from ..operators import split as S
from ..operators import thresholds as T
from ..operators import tree as TR
from ..operators import tree_text as TT
from ..session import cut_lineage, discard, release, stored
from ..sources import tables as src
from . import oracle_sql as O
from . import q_metrics as QM
from .registry import features, register

SPLIT_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _best_split(spark, sf_dir, criterion):
    li = src.table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("run"), F.col("l_linestatus").alias("node"), *SPLIT_FEATS,
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    rows = li.select("run", "node", *SPLIT_FEATS, "y", F.lit(1).cast("bigint").alias("cnt"))
    stats = rows.groupBy("run", "node").agg(F.sum("cnt").alias("n_node"), F.sum(F.when(F.col("y") == 1, F.col("cnt")).otherwise(0)).alias("c1_node"))
    stats = cut_lineage(stats.select("*", F.lit(1.0).alias("cw0"), F.lit(1.0).alias("cw1"), F.lit(criterion).alias("criterion"), F.lit(1).alias("msl")))
    largest = stats.agg(F.max("n_node")).first()[0] or 0
    best = TR.best_splits(rows, stats, SPLIT_FEATS, n_buckets=-(-largest // TR.ROWS_PER_BUCKET))
    return best.select(
        "node",
        F.element_at(F.array(*[F.lit(c) for c in SPLIT_FEATS]), F.col("feature_index") + 1).alias("feature"),
        "threshold", "n_left", "n_right", M.rnd(F.col("score")).alias("score"),
    )


def _imp_sql(w0: str, w1: str, criterion: str) -> str:
    n = f"({w0} + {w1})"
    p0 = f"CASE WHEN {n} > 0 THEN {w0} / {n} ELSE 0.0 END"
    p1 = f"CASE WHEN {n} > 0 THEN {w1} / {n} ELSE 0.0 END"
    if criterion == "gini":
        return f"(1.0 - ({p0}) * ({p0}) - ({p1}) * ({p1}))"

    def xlog(p):
        return f"(CASE WHEN ({p}) > 0 THEN ({p}) * log2({p}) ELSE 0.0 END)"

    return f"(-({xlog(p0)} + {xlog(p1)}))"


def _best_split_sql(criterion: str) -> str:
    lf = " UNION ALL ".join(f"SELECT node, {i} AS f, CAST({c} AS DOUBLE) AS v, y FROM b" for i, c in enumerate(SPLIT_FEATS))
    names = "[" + ", ".join(f"'{c}'" for c in SPLIT_FEATS) + "]"
    lw0, lw1, rw0, rw1 = "lw0", "lw1", "(t.w0 - lw0)", "(t.w1 - lw1)"
    score = f"(({lw0} + {lw1}) * {_imp_sql(lw0, lw1, criterion)} + ({rw0} + {rw1}) * {_imp_sql(rw0, rw1, criterion)})"
    return f"""WITH b AS (SELECT l_linestatus AS node, CAST(l_returnflag = 'R' AS INTEGER) AS y, {', '.join(SPLIT_FEATS)} FROM lineitem),
tot AS (SELECT node, count(*) AS n, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS w0, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS w1 FROM b GROUP BY node),
lf AS ({lf}),
per AS (SELECT node, f, v, count(*) AS n, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS w0, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS w1 FROM lf GROUP BY node, f, v),
cum AS (SELECT node, f, v, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS next_v,
               sum(n) OVER wc AS ln, sum(w0) OVER wc AS lw0, sum(w1) OVER wc AS lw1
        FROM per WINDOW wc AS (PARTITION BY node, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cand AS (SELECT c.node, c.f, CASE WHEN (v + next_v) / 2.0 = next_v THEN v ELSE (v + next_v) / 2.0 END AS threshold,
                CAST(ln AS BIGINT) AS n_left, CAST(t.n - ln AS BIGINT) AS n_right, {score} AS score
         FROM cum c JOIN tot t USING (node) WHERE next_v IS NOT NULL AND ln >= 1 AND t.n - ln >= 1)
SELECT node, {names}[f + 1] AS feature, threshold, n_left, n_right, round(score, 10) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score, f, threshold) AS rn FROM cand) r WHERE rn = 1"""


@register("best_split_gini", _best_split_sql("gini"))
def q_best_split_gini(spark, sf_dir):
    return _best_split(spark, sf_dir, "gini")


@register("best_split_entropy", _best_split_sql("entropy"))
def q_best_split_entropy(spark, sf_dir):
    return _best_split(spark, sf_dir, "entropy")


# ---------------------------------------------------------------------- isotonic
def _iso_input(spark, sf_dir):
    s = QM.scores(spark, sf_dir).where(F.col("model") == "quantity")
    return s.select(F.lit("quantity").alias("run"), F.col("p").alias("score"), "y", "id")


ISO_SQL_CTE = f"""WITH li AS (SELECT {QM.ID_SQL} AS id, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity / 50.0 AS x FROM lineitem),
d AS (SELECT x, CAST(sum(y) AS DOUBLE) AS sy, CAST(count(*) AS DOUBLE) AS w, row_number() OVER (ORDER BY x) AS i FROM li GROUP BY x),
c AS (SELECT i, x, sum(sy) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw, sum(sy) OVER (ORDER BY i) - sy AS cs0, sum(w) OVER (ORDER BY i) - w AS cw0 FROM d),
mm AS (SELECT p.i, p.x, max(mn) AS fitted FROM c p JOIN (
         SELECT a.i AS ai, q.i AS qi, min((b.cs - a.cs0) / (b.cw - a.cw0)) AS mn
         FROM c a JOIN c q ON a.i <= q.i JOIN c b ON b.i >= q.i GROUP BY a.i, q.i) t ON t.qi = p.i GROUP BY p.i, p.x),
keep AS (SELECT x, fitted, lag(fitted) OVER (ORDER BY i) AS pf, lead(fitted) OVER (ORDER BY i) AS nf FROM mm)"""


@register(
    "isotonic_fit",
    ISO_SQL_CTE + "\nSELECT x, round(fitted, 10) AS fitted FROM keep WHERE pf IS NULL OR nf IS NULL OR fitted <> pf OR fitted <> nf",
)
def q_isotonic_fit(spark, sf_dir):
    fit = CAL.fit_isotonic(_iso_input(spark, sf_dir))
    return fit.select("x", M.rnd(F.col("fitted")).alias("fitted"))


@register("apply_isotonic", ISO_SQL_CTE + "\nSELECT li.id, round(mm.fitted, 10) AS p_cal FROM li JOIN mm USING (x)")
def q_apply_isotonic(spark, sf_dir):
    inp = _iso_input(spark, sf_dir)
    model = CAL.fit_isotonic(inp)
    return CAL.apply_isotonic(inp, model).select("id", M.rnd(F.col("p_cal")).alias("p_cal"))


@register(
    "isotonic_calibrate",
    ISO_SQL_CTE
    + f""",
kn AS (SELECT x AS x0, fitted AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(fitted) OVER (ORDER BY x) AS y1 FROM keep
       WHERE pf IS NULL OR nf IS NULL OR fitted <> pf OR fitted <> nf),
ot AS (SELECT {QM.ID_SQL} AS id, 1.0 - l_discount * 10.0 AS score FROM lineitem)
SELECT id, score, round(CASE WHEN x0 IS NULL THEN (SELECT y0 FROM kn ORDER BY x0 LIMIT 1) WHEN x1 IS NULL THEN y0
       ELSE y0 + (score - x0) * (y1 - y0) / (x1 - x0) END, 10) AS p_cal
FROM ot ASOF LEFT JOIN kn ON ot.score >= kn.x0""",
)
def q_isotonic_calibrate(spark, sf_dir):
    """Isotonic map fitted on the 'quantity' scores, applied to the 'discount' scores (interpolation path)."""
    model = CAL.fit_isotonic(_iso_input(spark, sf_dir))
    other = QM.scores(spark, sf_dir).where(F.col("model") == "discount").select(
        F.lit("quantity").alias("run"), "id", F.col("p").alias("score")
    )
    return CAL.apply_isotonic(other, model).select("id", "score", M.rnd(F.col("p_cal")).alias("p_cal"))


@register("platt_calibrate")
def q_platt_calibrate(spark, sf_dir):
    """Platt parameters (p = sigmoid(a * score + b)) fitted per scorer on all lineitem rows."""
    s = QM.scores(spark, sf_dir).select(F.col("model").alias("run"), F.col("p").alias("score"), "y")
    return CAL.fit_platt(s)


# ---- fixed values (Platt parameters of the apply_platt check) ----
PLATT_A, PLATT_B = 4.0, -2.0


@register(
    "apply_platt",
    QM.W(f"SELECT id, model, round(1.0 / (1.0 + exp(-({PLATT_A} * p + {PLATT_B}))), 10) AS p_cal FROM sc"),
)
def q_apply_platt(spark, sf_dir):
    s = QM.scores(spark, sf_dir).select(F.col("model").alias("run"), "id", F.col("p").alias("score"))
    prm = spark.createDataFrame([(m, PLATT_A, PLATT_B) for m in QM.MODELS], "run string, a double, b double")
    out = CAL.apply_platt(s, prm)
    return out.select("id", F.col("run").alias("model"), M.rnd(F.col("p_cal")).alias("p_cal"))


# ---------------------------------------------------------------------- fixed models on thread features
# ---- fixed values (example coefficients on standardised features) ----
EXAMPLE_COEFFICIENTS = {"turn_count": 0.75, "aggregate_money_terms": 1.5, "ratio_request_messages": -0.5, "aggregate_num_urls": 0.125}

EXAMPLE_RULES = """\
|--- aggregate_money_terms <= 3.5000
|   |--- turn_count <= 6.5000
|   |   |--- class: 0
|   |--- turn_count >  6.5000
|   |   |--- ratio_request_messages <= 0.5000
|   |   |   |--- class: 0
|   |   |--- ratio_request_messages >  0.5000
|   |   |   |--- class: 1
|--- aggregate_money_terms >  3.5000
|   |--- class: 1
"""


def _linear_sql() -> str:
    feats = STRUCTURAL_FEATURES
    stats = ", ".join(f"avg({c}) AS {c}__m, stddev_pop({c}) AS {c}__s" for c in feats)
    terms = " + ".join(
        f"{EXAMPLE_COEFFICIENTS[c]!r} * (({c} - {c}__m) / CASE WHEN {c}__s = 0 THEN 1.0 ELSE {c}__s END)" for c in feats
    )
    return O.with_features(
        f"SELECT orig_index, round(dec, 10) AS decision, round(1.0 / (1.0 + exp(-dec)), 10) AS p FROM "
        f"(SELECT orig_index, 0.0 + {terms} AS dec FROM features JOIN (SELECT {stats} FROM features) st ON true) z"
    )


@register("linear_score", _linear_sql())
def q_linear_score(spark, sf_dir):
    from ..operators import linear as LIN

    f = features(spark, sf_dir)
    feats = STRUCTURAL_FEATURES
    st = M.standardization_stats(f, feats)
    model = st.select(
        F.lit("example").alias("run"),
        F.array(*[F.lit(EXAMPLE_COEFFICIENTS[c]) for c in feats]).alias("coefficients"),
        F.lit(0.0).alias("intercept"),
        F.array(*[F.col(f"{c}__mean") for c in feats]).alias("means"),
        F.array(*[F.col(f"{c}__std") for c in feats]).alias("stds"),
    )
    s = LIN.score(f.select(F.lit("example").alias("run"), "orig_index", *feats), model, feats)
    return s.select("orig_index", M.rnd(F.col("decision")).alias("decision"), M.rnd(F.col("p1")).alias("p"))


@register(
    "apply_tree_rules",
    O.with_features(
        "SELECT orig_index, thread_label, CAST(aggregate_money_terms > 3.5 OR (turn_count > 6.5 AND ratio_request_messages > 0.5) AS INTEGER) AS predicted FROM features"
    ),
)
def q_apply_tree_rules(spark, sf_dir):
    rule = TT.rules_column(TT.parse_rules(EXAMPLE_RULES))
    return features(spark, sf_dir).select("orig_index", "thread_label", rule.alias("predicted"))


# ---------------------------------------------------------------------- fixed-model ablation on lineitem
# ---- fixed values (two linear scorers of the ablation check) ----
ABL_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ABL_MODELS = {
    "model_a": (-1.5, [1.0, 0.5, -0.5, 0.25]),
    "model_b": (-1.0, [0.5, 1.0, 0.25, -0.25]),
}


def _abl_items():
    """(model, feature_set, decision on standardised features) of each model and feature set."""
    items = []
    for mname, (b0, coef) in ABL_MODELS.items():
        for sname, _, cols in MD.feature_sets(ABL_FEATS):
            dec = F.lit(b0)
            for c, w in zip(ABL_FEATS, coef):
                if c in cols:
                    dec = dec + F.lit(w) * F.col(c)
            items.append((mname, sname, dec))
    return items


def _free(spark):
    """Drops the shuffle files of the last step too: the listener bus keeps its plan until another query, here one without a shuffle, has ended."""
    spark.range(0, 1, 1, 1).collect()
    release(spark)


def _item_metrics(z, dec):
    """Fold metrics of one decision, checkpointed: a row for each fold. The counts of its scores go at once."""
    held = []

    def keep(df):
        held.append(stored(df))
        _free(z.sparkSession)
        return held[-1]

    p = F.rint(F.lit(1e12) / (F.lit(1.0) + F.exp(-dec))) / F.lit(1e12)
    out = cut_lineage(M.fold_metrics(z.select("y", "fold", p.alias("p")), "y", "p", ["fold"], threshold=0.5, rule=">", with_brier=False, keep=keep))
    for df in held:
        discard(df)
    _free(z.sparkSession)
    return out


def ablation_fixed(spark, sf_dir):
    """Rows get their fold once and are stored; then one model and feature set after the other is scored and
    sorted, so that the disk holds the scores of one, not of all ten."""
    folded = stored(S.with_folds(QM.lineitem_rows(spark, sf_dir, ABL_FEATS), 5, id_col="id", label="y").select("y", "fold", *ABL_FEATS))
    _free(spark)
    stats = cut_lineage(M.standardization_stats(src.table(spark, sf_dir, "lineitem"), ABL_FEATS))
    z = M.standardize(folded, ABL_FEATS, keep=["y", "fold"], stats=stats)
    parts = [_item_metrics(z, dec).select(F.lit(m).alias("model"), F.lit(s).alias("feature_set"), "*") for m, s, dec in _abl_items()]
    discard(folded)
    summ = M.summarize(functools.reduce(DataFrame.unionByName, parts), ["model", "feature_set"], M.METRICS, sample_std=True)
    return MD.add_drops(summ)


def _abl_sql() -> str:
    stats = ", ".join(f"avg({c}) AS {c}__m, stddev_pop({c}) AS {c}__s" for c in ABL_FEATS)
    zc = ", ".join(f"({c} - {c}__m) / CASE WHEN {c}__s = 0 THEN 1.0 ELSE {c}__s END AS {c}" for c in ABL_FEATS)
    parts = []
    for mname, (b0, coef) in ABL_MODELS.items():
        for left_out in [None, *ABL_FEATS]:
            sname = f"without_{left_out}" if left_out else "full_feature_set"
            dec = f"{b0!r}" + "".join(f" + {w!r} * {c}" for c, w in zip(ABL_FEATS, coef) if c != left_out)
            parts.append(f"SELECT id, y, fold, '{mname}' AS model, '{sname}' AS feature_set, round(1.0 / (1.0 + exp(-({dec}))), 12) AS p FROM z")
    fm = QM.fold_metrics_sql("model, feature_set, fold", "abl").replace("p < 0.5", "p <= 0.5").replace("p >= 0.5", "p > 0.5")
    summ = QM.summary_sql("model, feature_set", fm, QM.METRICS5, "stddev_samp")
    drops = ", ".join(
        f"coalesce(f.{m}_mean - s.{m}_mean, 0.0) AS {m}_mean_drop_from_full" for m in QM.METRICS5
    )
    return QM.W(
        f"SELECT s.*, {drops} FROM summ s LEFT JOIN (SELECT * FROM summ WHERE feature_set = 'full_feature_set') f USING (model)",
        f""",
li2 AS (SELECT {QM.ID_SQL} AS id, CAST(l_returnflag = 'R' AS INTEGER) AS y, {QM.FOLD_SQL}, {', '.join(ABL_FEATS)} FROM lineitem),
z AS (SELECT id, y, fold, {zc} FROM li2 JOIN (SELECT {stats} FROM lineitem) st ON true),
abl AS ({' UNION ALL '.join(parts)}),
summ AS ({summ})""",
    )


ABL_SQL = _abl_sql()
ABL_COLS = ["model", "feature_set", *QM.MEANS, *[f".{m}_mean_drop_from_full" for m in QM.METRICS5]]


def _abl_rounded(sql: str) -> str:
    head, select = sql.split("\nSELECT", 1)
    return head + "\n" + QM.rounded_sql(ABL_COLS, f"(SELECT{select}) last")


@register("ablation_drops", _abl_rounded(ABL_SQL))
def q_ablation_drops(spark, sf_dir):
    return M.rounded(ablation_fixed(spark, sf_dir))


@register(
    "largest_f1_drop",
    _abl_rounded(ABL_SQL.replace(
        "SELECT s.*, ", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1_mean_drop_from_full DESC, feature_set) AS rn FROM (SELECT s.*, ", 1
    ) + " WHERE s.feature_set <> 'full_feature_set') x) y WHERE rn = 1"),
)
def q_largest_f1_drop(spark, sf_dir):
    return M.rounded(MD.largest_drop(ablation_fixed(spark, sf_dir)))


# ---------------------------------------------------------------------- rank / union
@register(
    "grid_rank",
    QM.W(
        "SELECT model, threshold, f1, CAST(rank() OVER (PARTITION BY model ORDER BY f1 DESC) AS INTEGER) AS rank_f1, "
        "row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) = 1 AS is_best FROM sw",
        QM.SWEEP_SQL,
    ),
)
def q_grid_rank(spark, sf_dir):
    sw = T.sweep(QM.scores(spark, sf_dir), "y", "p", ["model"])
    w = Window.partitionBy("model").orderBy(F.col("f1").desc())
    return sw.select(
        "model", "threshold", "f1", F.rank().over(w).alias("rank_f1"),
        (F.row_number().over(Window.partitionBy("model").orderBy(F.col("f1").desc(), F.col("threshold"))) == 1).alias("is_best"),
    )


@register(
    "grid_results_union",
    QM.W(
        "SELECT * FROM (" + QM.conf_sql("model", "(SELECT *, CAST(p >= 0.5 AS INTEGER) AS pred FROM sc) t", "pred")
        + ") a UNION ALL BY NAME SELECT model, n_pos, n_neg, round(roc_auc, 10) AS roc_auc FROM " + QM.auc_sql("model", "sc") + " b"
    ),
)
def q_grid_results_union(spark, sf_dir):
    s = QM.scores(spark, sf_dir)
    a = M.confusion(s.withColumn("pred", M.binarize("p", 0.5)), "y", "pred", ["model"])
    b = M.rounded(M.roc_auc(s, "y", "p", ["model"]))
    return a.unionByName(b, allowMissingColumns=True)


@register("hyperparams_with_defaults")
def q_hyperparams_with_defaults(spark, sf_dir):
    """Selected parameters (long form of a regularisation search's winner) completed with per-key defaults."""
    from ..sources.splits import hyperparams_with_defaults
    from .q_models import search, selected

    sel = selected(search(spark, sf_dir, [c for c in MD.lr_grid() if not c["balanced"] and c["l1"] == 0.0], None))
    long = sel.select("model", F.explode(F.from_json("best_params", "map<string,string>")).alias("param", "value")).select(
        "model", F.regexp_replace("param", "^model__", "").alias("param"), "value"
    )
    return hyperparams_with_defaults(long)
