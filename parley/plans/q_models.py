"""Queries: model fits and evaluations on the decorated thread features (I1-I20, C4, F6 post-processing)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import STRUCTURAL_FEATURES
from ..operators import modelling as MD
from ..operators import split as S
from ..session import cut_lineage
from .registry import features, register

FEATS = STRUCTURAL_FEATURES


def model_data(spark, sf_dir):
    """Training rows of the stratified split with their 5-fold assignment, both ranked in place: (orig_index, feats, y, fold)."""
    train = S.with_part(features(spark, sf_dir)).where("part = 'train'").drop("part")
    return cut_lineage(S.with_folds(train).select("orig_index", *FEATS, F.col("thread_label").alias("y"), "fold"))


@register("cross_validate")
def q_cross_validate(spark, sf_dir):
    data = model_data(spark, sf_dir)
    cands = MD.candidates(spark, lr=MD.LR_BASELINE, tree=MD.TREE_BASELINE)
    m = MD.cross_validate(data, cands, 5)
    return MD.cv_summary(m, ["model"])


def _split_rows(spark, sf_dir):
    f = S.with_part(features(spark, sf_dir))
    part = cut_lineage(f.select("orig_index", *FEATS, F.col("thread_label").alias("y"), "part"))
    return part.where("part = 'train'").drop("part"), part.where("part = 'test'").drop("part")


def _fit_score_heldout(spark, sf_dir, lr=None, tree=None):
    train, test = _split_rows(spark, sf_dir)
    cands = MD.candidates(spark, lr=lr, tree=tree)
    lr_models, nodes = MD.fit_full(train, cands)
    scored = MD.score_full(test, cands, lr_models, nodes)
    return scored.select(F.col("run").alias("cand_id"), "orig_index", "y", "decision", "p1", (F.col("p1") > 0.5).cast("int").alias("pred"))


@register("logreg_scores")
def q_logreg_scores(spark, sf_dir):
    """Baseline LR (L2, C=1) fit on the training split, scored on the held-out rows."""
    return _fit_score_heldout(spark, sf_dir, lr=MD.LR_BASELINE)


@register("logreg_l1_scores")
def q_logreg_l1_scores(spark, sf_dir):
    return _fit_score_heldout(spark, sf_dir, lr=MD.LR_TUNED)


@register("tree_scores")
def q_tree_scores(spark, sf_dir):
    return _fit_score_heldout(spark, sf_dir, tree=MD.TREE_TUNED)


@register("heldout_evaluation")
def q_heldout_evaluation(spark, sf_dir):
    """Untuned models fit on train, evaluated on the held-out split (metrics + confusion matrix)."""
    train, test = _split_rows(spark, sf_dir)
    cands = MD.candidates(spark, lr=MD.LR_BASELINE, tree=MD.TREE_BASELINE)
    return MD.heldout_evaluation(train, test, cands)


@register("grid_search")
def q_grid_search(spark, sf_dir):
    """20 LR + 180 tree candidates x 5 folds, all fitted together; mean/pop-std and F1 rank per model."""
    return search(spark, sf_dir, MD.lr_grid(), MD.tree_grid())


def search(spark, sf_dir, lr_list, tree_list):
    from pyspark.sql import Window

    data = model_data(spark, sf_dir)
    cands = MD.candidates(spark, lr_list=lr_list, tree_list=tree_list)
    m = MD.cross_validate(data, cands, 5)
    summ = MD.cv_summary(m, ["cand_id", "model"])
    summ = summ.join(F.broadcast(cands.select("cand_id", "params")), "cand_id")
    w = Window.partitionBy("model").orderBy(F.col("f1_mean").desc())
    return summ.withColumn("rank_test_f1", F.rank().over(w))


@register("selected_params")
def q_selected_params(spark, sf_dir):
    """Refit-by-F1 winner per model (first candidate among equal mean F1) with its ten metric fields."""
    return selected(q_grid_search(spark, sf_dir))


def selected(g):
    from ..operators.selection import first_by

    best = first_by(g, ["model"], [F.col("f1_mean").desc(), F.col("cand_id")])
    metrics = F.struct(*[F.col(f"{m}_{s}") for m in ["accuracy", "precision", "recall", "f1", "roc_auc"] for s in ["mean", "std"]])
    return best.select("model", F.col("params").alias("best_params"), F.col("f1_mean").alias("best_f1"), F.to_json(metrics).alias("metrics"))


@register("coefficients")
def q_coefficients(spark, sf_dir):
    """Tuned LR coefficients on standardised features, sorted by absolute value."""
    from ..operators.explain import coefficient_table

    train, _ = _split_rows(spark, sf_dir)
    lr_models, _ = MD.fit_full(train, MD.candidates(spark, lr=MD.LR_TUNED))
    return coefficient_table(lr_models, FEATS)


def _tuned_tree(spark, sf_dir):
    train, _ = _split_rows(spark, sf_dir)
    _, nodes = MD.fit_full(train, MD.candidates(spark, tree=MD.TREE_TUNED))
    return nodes


@register("tree_importance")
def q_tree_importance(spark, sf_dir):
    from ..operators.tree import importances

    return importances(_tuned_tree(spark, sf_dir), FEATS).select("feature", "importance").orderBy(F.col("importance").desc())


@register("tree_rules")
def q_tree_rules(spark, sf_dir):
    from ..operators.tree_text import rule_lines

    return rule_lines(_tuned_tree(spark, sf_dir)).select("sort_key", "line").orderBy("sort_key")


@register("tree_paths")
def q_tree_paths(spark, sf_dir):
    from ..operators.tree_text import leaf_paths

    return leaf_paths(_tuned_tree(spark, sf_dir)).select("leaf", "depth", "class", "conditions")


def _calibration(spark, sf_dir):
    data = model_data(spark, sf_dir)
    nested = S.nested_folds(data.select("orig_index", F.col("y").alias("thread_label"), "fold"))
    cands = MD.candidates(spark, lr=MD.LR_TUNED, tree=MD.TREE_TUNED)
    return MD.nested_calibration(data, nested.select("orig_index", "outer_fold", "inner_fold"), cands)


@register("calibration_cv")
def q_calibration_cv(spark, sf_dir):
    """Nested 5x3 calibration (sigmoid, isotonic) of both tuned models: mean and sample std per setup."""
    from ..operators import metrics as M

    _, met = _calibration(spark, sf_dir)
    return M.summarize(met, ["model", "calibration_method"], M.METRICS + ["brier_score"], sample_std=True)


@register("oof_predictions")
def q_oof_predictions(spark, sf_dir):
    oof, _ = _calibration(spark, sf_dir)
    return oof.select("model", "calibration_method", "orig_index", "fold", "y", "p")


def _setups(spark, sf_dir):
    """Out-of-fold probabilities of the best (model, calibration method): lowest mean Brier score, then highest mean F1."""
    from ..operators import metrics as M
    from ..operators.selection import first_by

    oof, met = _calibration(spark, sf_dir)
    summary = M.summarize(met, ["model", "calibration_method"], M.METRICS + ["brier_score"], sample_std=True)
    best = first_by(summary, [], [F.col("brier_score_mean"), F.col("f1_mean").desc(), F.col("model"), F.col("calibration_method")])
    won = oof.join(best.select("model", "calibration_method"), ["model", "calibration_method"], "left_semi")
    return cut_lineage(won.select("model", "orig_index", "fold", "y", "p"))


@register("risk_bands_oof")
def q_risk_bands_oof(spark, sf_dir):
    """Features -> nested calibration -> best setup -> risk bands from its out-of-fold probabilities."""
    from ..operators import thresholds as T

    won = _setups(spark, sf_dir)
    return T.risk_bands(T.sweep(won, "y", "p", ["model"]), ["model"])


@register("thread_risk")
def q_thread_risk(spark, sf_dir):
    """Each training thread with the winner's out-of-fold probability and the band it falls in."""
    from ..operators import thresholds as T

    won = _setups(spark, sf_dir)
    bands = cut_lineage(T.risk_bands(T.sweep(won, "y", "p", ["model"]), ["model"]))
    return T.assign_band(won, bands, "p", ["model"])


@register("tree_baseline_scores")
def q_tree_baseline_scores(spark, sf_dir):
    return _fit_score_heldout(spark, sf_dir, tree=MD.TREE_BASELINE)


@register("ablation")
def q_ablation(spark, sf_dir):
    data = model_data(spark, sf_dir)
    cands = MD.candidates(spark, lr=MD.LR_TUNED, tree=MD.TREE_TUNED)
    return MD.add_drops(MD.ablation(data, cands, 5)).orderBy("model", "feature_set")
