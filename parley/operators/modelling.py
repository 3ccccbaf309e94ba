"""Cross-validation, grid search, held-out evaluation, nested calibration and ablation as
Spark jobs over ``run`` keys.

A *run* is (candidate, fold[, inner fold]); its training rows are the rows whose fold
differs, compacted by feature values before any fit. Rows stand once for each *part* (fold,
inner fold, feature set), not for each run: logistic regressions take all runs of a part in
the same Newton passes, and tree candidates are cuts of a few shared trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import STRUCTURAL_FEATURES
from ..session import cut_lineage
from . import calibrate as CAL  # noqa: F401
from . import linear as LIN
from . import metrics as M
from . import tree as TR

FEATS = STRUCTURAL_FEATURES

# ---- fixed values (model configurations and grids) ----
LR_BASELINE = {"C": 1.0, "l1": 0.0, "balanced": False, "penalise_intercept": False}  # its solver leaves the intercept free
TREE_BASELINE = {"criterion": "gini", "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "balanced": False}
LR_TUNED = {"C": 0.1, "l1": 1.0, "balanced": False}
TREE_TUNED = {"criterion": "entropy", "max_depth": 5, "min_samples_split": 2, "min_samples_leaf": 1, "balanced": False}
LR_GRID = {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "l1_ratio": [0.0, 1.0], "class_weight": [None, "balanced"]}
TREE_GRID = {
    "criterion": ["gini", "entropy"],
    "max_depth": [None, 3, 5, 7, 10],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 5],
    "class_weight": [None, "balanced"],
}
LR_NAME, TREE_NAME = "Logistic Regression", "Decision Tree"

CAND_SCHEMA = (
    "cand_id string, model string, C double, l1 double, criterion string, max_depth int, "
    "min_samples_split int, min_samples_leaf int, balanced boolean, penalise_intercept boolean, params string"
)


def _cand_row(cid, model, p):
    import json

    return (
        cid, model, p.get("C"), p.get("l1"), p.get("criterion"), p.get("max_depth"),
        p.get("min_samples_split"), p.get("min_samples_leaf"), bool(p.get("balanced", False)), bool(p.get("penalise_intercept", True)),
        json.dumps(p.get("_params", {k: v for k, v in p.items() if not k.startswith("_")}), sort_keys=True),
    )


def candidates(spark, lr: dict | None = None, tree: dict | None = None, lr_list=None, tree_list=None) -> DataFrame:
    """Candidate table (model parameters only; never data)."""
    rows = []
    for i, p in enumerate(lr_list or ([lr] if lr else [])):
        rows.append(_cand_row(f"lr{i:03d}", LR_NAME, p))
    for i, p in enumerate(tree_list or ([tree] if tree else [])):
        rows.append(_cand_row(f"dt{i:03d}", TREE_NAME, p))
    return spark.createDataFrame(rows, CAND_SCHEMA)


def lr_grid():
    out = []
    for c in LR_GRID["C"]:
        for l1 in LR_GRID["l1_ratio"]:
            for cw in LR_GRID["class_weight"]:
                out.append({"C": c, "l1": l1, "balanced": cw == "balanced",
                            "_params": {"model__C": c, "model__l1_ratio": l1, "model__class_weight": cw}})
    return out


def tree_grid():
    out = []
    for crit in TREE_GRID["criterion"]:
        for md in TREE_GRID["max_depth"]:
            for mss in TREE_GRID["min_samples_split"]:
                for msl in TREE_GRID["min_samples_leaf"]:
                    for cw in TREE_GRID["class_weight"]:
                        out.append({"criterion": crit, "max_depth": md, "min_samples_split": mss, "min_samples_leaf": msl,
                                    "balanced": cw == "balanced",
                                    "_params": {"criterion": crit, "max_depth": md, "min_samples_split": mss,
                                                "min_samples_leaf": msl, "class_weight": cw}})
    return out


def fold_runs(data: DataFrame, cands: DataFrame, k: int, fold_col: str = "fold", group_cols=()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, train, valid): runs = candidates x folds, each with the ``part`` (fold, and group) whose rows it takes.

    Rows carry their part only: train rows stand in the parts of all other folds, valid rows in
    that of their own, however many candidates there are. ``group_cols`` (present in both data
    and cands) further split parts, e.g. a feature set.
    """
    g = list(group_cols)
    part = F.concat_ws("#", *[F.col(c).cast("string") for c in g], F.col("k").cast("string")).alias("part")
    runs = cands.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k")).select(
        F.concat_ws("#", "cand_id", *[F.col(c).cast("string") for c in g], F.col("k").cast("string")).alias("run"), part, "*"
    )
    # compact before the fan-out: one row per distinct (group, fold, features, y) with its count
    feats_in = [c for c in FEATS if c in data.columns]
    data = data.groupBy(*g, fold_col, *feats_in, "y").agg(F.count(F.lit(1)).alias("cnt"))
    train = data.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda x: x != F.col(fold_col))).alias("k"))
    valid = data.withColumn("k", F.col(fold_col))
    return runs, *[rows.select(part, *feats_in, "y", "cnt") for rows in (train, valid)]


class Models:
    """Fitted runs: linear models by run; shared trees and each run's cut of them."""

    def __init__(self, runs: DataFrame, lr=None, nodes=None, cuts=None, parts=None):
        self.runs, self.lr, self.nodes, self.cuts, self.parts = runs, lr, nodes, cuts, parts

    def trees(self) -> DataFrame:
        """The node table of each run."""
        return TR.cut_trees(self.nodes, self.cuts)


def fit_models(runs: DataFrame, train: DataFrame, feats=FEATS) -> Models:
    """Fits every run (run, part, candidate parameters) on the train rows (part, features, y, cnt) of its part."""
    runs, train = cut_lineage(runs), cut_lineage(train)
    lr_runs, dt_runs = runs.where(F.col("model") == LR_NAME), runs.where(F.col("model") == TREE_NAME)
    out = Models(runs)
    if not lr_runs.isEmpty():
        own = train.join(lr_runs.select("part").distinct(), "part", "left_semi")
        out.lr = cut_lineage(LIN.fit_runs(own, lr_runs.select("run", "part", "C", "l1", "balanced", "penalise_intercept"), feats))
    if not dt_runs.isEmpty():
        trees, cuts = (cut_lineage(t) for t in TR.shared_trees(dt_runs.select("run", "part", "criterion", "max_depth", "min_samples_split", "min_samples_leaf", "balanced")))
        rows = train.join(trees.select("run", "part"), "part").select("run", *feats, "y", "cnt")
        out.nodes, out.cuts, out.parts = cut_lineage(TR.fit_trees(rows, trees, feats)), cuts, trees.select("run", "part")
    return out


def score_models(rows: DataFrame, models: Models, feats=FEATS, compact: bool = False) -> DataFrame:
    """rows (part, features, ...) scored by each run of their part: adds ``run``, ``decision`` (LR log-odds, tree probability) and ``p1``.

    ``compact``: only (run, y, cnt, decision, p1) are wanted, and a tree's rows are counted by leaf before they meet its runs.
    """
    columns = ["run", "y", "cnt"] if compact else ["run", *rows.columns]
    out = None
    if models.lr is not None:
        own = rows.join(models.runs.where(F.col("model") == LR_NAME).select("run", "part"), "part")
        out = LIN.score(own, models.lr, feats).select(*columns, "decision", "p1")
    if models.nodes is not None:
        own = TR.apply_trees(rows.join(models.parts, "part"), models.nodes, feats).withColumnRenamed("run", "tree").drop("p1")
        if compact:
            own = own.groupBy("tree", "leaf", "y").agg(F.sum("cnt").alias("cnt"))
        says = TR.leaf_values(models.nodes, models.trees(), models.cuts)
        scored = own.join(says, ["tree", "leaf"]).select(*columns, F.col("p1").alias("decision"), "p1")
        out = scored if out is None else out.unionByName(scored)
    return out


def fit_and_score(runs: DataFrame, train: DataFrame, valid: DataFrame, feats=FEATS) -> DataFrame:
    """Fit every run (LR and tree candidates) and score its validation rows: (run, y, cnt, decision, p1)."""
    return score_models(cut_lineage(valid), fit_models(runs, train, feats), feats, compact=True)


def run_metrics(scored: DataFrame, runs: DataFrame, keys=("cand_id", "model", "k")) -> DataFrame:
    """Per-run metrics: labels by ``p1 > 0.5``, AUC on p1."""
    s = scored.drop(*[c for c in keys if c in scored.columns]).join(runs.select("run", *keys), "run")
    w = "cnt" if "cnt" in s.columns else None
    return M.fold_metrics(s, "y", "p1", ["run", *keys], threshold=0.5, rule=">", weight=w)


def cv_summary(metrics: DataFrame, keys=("cand_id", "model"), sample_std: bool = False) -> DataFrame:
    return M.summarize(metrics, list(keys), M.METRICS, sample_std=sample_std)


def cross_validate(data: DataFrame, cands: DataFrame, k: int = 5, feats=FEATS) -> DataFrame:
    runs, train, valid = fold_runs(data, cands, k)
    scored = fit_and_score(runs, train, valid, feats)
    return run_metrics(scored, runs)


def fit_full(train: DataFrame, cands: DataFrame, feats=FEATS) -> tuple[DataFrame | None, DataFrame | None]:
    """Fit each candidate once on all training rows (run = cand_id). Returns (lr_models, tree_nodes)."""
    rows = train.groupBy(F.lit("all").alias("part"), *feats, "y").agg(F.count(F.lit(1)).alias("cnt"))
    models = fit_models(cands.select(F.col("cand_id").alias("run"), F.lit("all").alias("part"), "*"), rows, feats)
    return models.lr, None if models.nodes is None else cut_lineage(models.trees())


def score_full(rows: DataFrame, cands: DataFrame, lr_models, tree_nodes, feats=FEATS) -> DataFrame:
    """Score rows with every fitted candidate: (run, rows..., decision, p1)."""
    ids = cands.select(F.col("cand_id").alias("run"), "model")  # every row meets every candidate, which is what is asked for
    each = rows.withColumn("all__", F.lit(1)).join(ids.withColumn("all__", F.lit(1)), "all__").drop("all__")
    out = None
    if lr_models is not None:
        out = LIN.score(each.where(F.col("model") == LR_NAME).drop("model"), lr_models, feats)
    if tree_nodes is not None:
        own = each.where(F.col("model") == TREE_NAME).drop("model")
        sc = TR.apply_trees(own, tree_nodes, feats).drop("leaf").withColumn("decision", F.col("p1"))
        sc = sc.select(*own.columns, "decision", "p1")
        out = sc if out is None else out.unionByName(sc)
    return out


def heldout_evaluation(train: DataFrame, test: DataFrame, cands: DataFrame, feats=FEATS) -> DataFrame:
    """Fit on the training rows, evaluate on held-out rows: metrics + confusion matrix per candidate."""
    lr_models, nodes = fit_full(train, cands, feats)
    scored = score_full(test, cands, lr_models, nodes, feats)
    s = scored.join(cands.select(F.col("cand_id").alias("run"), "model"), "run")
    s = s.withColumn("pred", M.predict_label("p1"))
    conf = M.confusion(s, "y", "pred", ["model"])
    auc = M.roc_auc(s, "y", "p1", ["model"]).select("model", "roc_auc")
    return conf.join(auc, "model").select(
        "model", *M.metric_columns(), "roc_auc",
        "true_negative", "false_positive", "false_negative", "true_positive",
    )


# ------------------------------------------------------------------------------------------------
# nested calibration
# ------------------------------------------------------------------------------------------------
def nested_calibration(data: DataFrame, nested: DataFrame, cands: DataFrame, methods=("sigmoid", "isotonic"),
                       k_inner: int = 3, feats=FEATS) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold calibrated probabilities and per-outer-fold metrics, for as many outer folds as ``data`` has.

    data: (orig_index, feats, y, fold); nested: (orig_index, outer_fold, inner_fold).
    Base runs are (candidate, outer k, inner j); each is fitted once and shared by all
    calibration methods. Calibrator j is fitted on inner fold j's scores; the outer
    fold's probability is the mean of the k_inner calibrated predictions.
    Returns (oof: cand_id, model, calibration_method, orig_index, fold, y, p; metrics per fold).
    """
    nd = nested.join(data, "orig_index")
    k_outer = (data.agg(F.max("fold")).first()[0] or 0) + 1
    inner = F.sequence(F.lit(0), F.lit(k_inner - 1))
    part = F.concat_ws("#", F.col("k").cast("string"), F.col("j").cast("string")).alias("part")
    base = cands.select("*", F.explode(F.sequence(F.lit(0), F.lit(k_outer - 1))).alias("k")).select("*", F.explode(inner).alias("j"))
    base = cut_lineage(base.select(F.concat_ws("#", "cand_id", F.col("k").cast("string"), F.col("j").cast("string")).alias("run"), part, "*"))
    tr = nd.select(*feats, "y", F.col("outer_fold").alias("k"), F.explode(F.filter(inner, lambda x: x != F.col("inner_fold"))).alias("j"))
    cal = nd.select("orig_index", *feats, "y", F.col("outer_fold").alias("k"), F.col("inner_fold").alias("j"))
    val = data.select("orig_index", *feats, "y", F.col("fold").alias("k"), F.explode(inner).alias("j"))
    models = fit_models(base, tr.groupBy(part, *feats, "y").agg(F.count(F.lit(1)).alias("cnt")), feats)  # compact before fitting
    cal_s, val_s = (cut_lineage(score_models(rows.select(part, "orig_index", *feats, "y"), models, feats)) for rows in (cal, val))
    pieces = []
    for method in methods:
        calib_in = cal_s.select("run", F.col("decision").alias("score"), "y")
        if method == "sigmoid":
            prm = CAL.fit_platt(calib_in)
            applied = CAL.apply_platt(val_s.withColumnRenamed("decision", "score"), prm)
        else:
            model = CAL.fit_isotonic(calib_in)
            applied = CAL.apply_isotonic(val_s.withColumnRenamed("decision", "score"), model)
        pieces.append(applied.select("run", "orig_index", "y", "p_cal", F.lit(method).alias("calibration_method")))
    allp = pieces[0]
    for p_ in pieces[1:]:
        allp = allp.unionByName(p_)
    meta = base.select("run", "cand_id", "model", "k")
    oof = allp.join(meta, "run").groupBy("cand_id", "model", "calibration_method", "orig_index", "k", "y").agg(
        F.avg("p_cal").alias("p")
    ).withColumnRenamed("k", "fold")
    oof = cut_lineage(oof)
    met = M.fold_metrics(oof, "y", "p", ["cand_id", "model", "calibration_method", "fold"], threshold=0.5, rule=">=")
    return oof, met


# ------------------------------------------------------------------------------------------------
# ablation
# ------------------------------------------------------------------------------------------------
def feature_sets(feats=FEATS):
    sets = [("full_feature_set", "None", list(feats))]
    for c in feats:
        sets.append((f"without_{c}", c, [x for x in feats if x != c]))
    return sets


def ablation(data: DataFrame, cands: DataFrame, k: int = 5, feats=FEATS) -> DataFrame:
    """Leave-one-feature-out CV, all feature sets in one batch of runs.

    A removed feature is replaced by a constant 0, which no tree can split on and which
    standardises to 0 (coefficient 0): the same fit as dropping the column.
    """
    sets = feature_sets(feats)
    items = []
    for name, removed, cols in sets:
        items.append(F.struct(
            F.lit(name).alias("feature_set"),
            *[(F.col(c) if c in cols else F.lit(0).cast(data.schema[c].dataType)).alias(c) for c in feats],
        ))
    others = [c for c in data.columns if c not in feats]
    d = data.select(*others, F.explode(F.array(*items)).alias("s")).select(*others, "s.*")
    c = cands.select("*", F.explode(F.array(*[F.lit(n) for n, _, _ in sets])).alias("feature_set"))
    runs, train, valid = fold_runs(d, c, k, group_cols=["feature_set"])
    scored = fit_and_score(runs, train, valid, feats)
    m = run_metrics(scored, runs, keys=("cand_id", "model", "feature_set", "k"))
    summ = cv_summary(m, ["model", "feature_set"], sample_std=True)
    meta = d.sparkSession.createDataFrame(
        [(n, r, ", ".join(cols), len(cols)) for n, r, cols in sets],
        "feature_set string, removed_feature string, features_used string, n_features int",
    )
    out = summ.join(F.broadcast(meta), "feature_set")
    return out.select("model", "feature_set", "removed_feature", "features_used", "n_features",
                      *[x for x in summ.columns if x not in ("model", "feature_set")])


DROP_METRICS = ["accuracy_mean", "precision_mean", "recall_mean", "f1_mean", "roc_auc_mean"]


def add_drops(results: DataFrame, keys=("model",), full_name: str = "full_feature_set") -> DataFrame:
    """``<metric>_drop_from_full`` = full-set value minus this row's value, per model; 0.0 without a full row."""
    keys = list(keys)
    full = results.where(F.col("feature_set") == full_name).select(*keys, *[F.col(m).alias(f"_full_{m}") for m in DROP_METRICS])
    j = results.join(F.broadcast(full), keys, "left")
    return j.select(
        *results.columns,
        *[F.coalesce(F.col(f"_full_{m}") - F.col(m), F.lit(0.0)).alias(f"{m}_drop_from_full") for m in DROP_METRICS],
    )


def largest_drop(results: DataFrame, metric: str = "f1_mean_drop_from_full", keys=("model",), full_name: str = "full_feature_set") -> DataFrame:
    from .selection import first_by

    return first_by(results.where(F.col("feature_set") != full_name), list(keys), [F.col(metric).desc(), F.col("feature_set")])
