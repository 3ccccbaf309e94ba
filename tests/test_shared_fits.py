"""Shared trees and shared Newton passes give the same models as fits of their own; grid and ablation against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import linear as LIN
from parley.operators import modelling as MD
from parley.operators import tree as TR

FEATS = ["a", "b", "c"]


def rows(n=300, seed=1, levels=8):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, levels, n), rng.integers(0, 40, n), rng.random(n).round(1)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - levels / 2) / 2 - (x[:, 2] - 0.5)))).astype(int)
    return x, y


def frame(spark, x, y, **more):
    names = [*more, *FEATS, "y"]
    return spark.createDataFrame([(*[v[i] for v in more.values()], *map(float, x[i]), int(y[i])) for i in range(len(y))], names)


def nodes_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["run"], {})[r["node"]] = (r["n"], r["is_leaf"], r["feature"], None if r["threshold"] is None else round(r["threshold"], 9), round(r["p1"], 9))
    return out


@pytest.mark.parametrize("criterion,balanced", [("gini", False), ("entropy", True)])
def test_candidates_are_cuts_of_shared_trees(spark, criterion, balanced):
    x, y = rows()
    grid = [(d, s, m) for d in (None, 0, 2, 5) for s in (2, 5, 60) for m in (1, 7)]
    runs = spark.createDataFrame([(f"{d}/{s}/{m}", "p", criterion, d, s, m, balanced) for d, s, m in grid], "run string, part string, criterion string, max_depth int, min_samples_split int, min_samples_leaf int, balanced boolean")
    trees, cuts = TR.shared_trees(runs)
    assert trees.count() == 2
    data = frame(spark, x, y)
    shared = TR.fit_trees(data.join(trees.select("run")), trees, FEATS)
    cut = TR.cut_trees(shared, cuts)
    own = TR.fit_trees(data.join(runs.select("run")), runs.drop("part"), FEATS)
    assert nodes_of(cut) == nodes_of(own)
    # scores through the shared tree's leaves
    routed = TR.apply_trees(data.withColumn("id", F.monotonically_increasing_id()).join(trees.select("run")), shared, FEATS).withColumnRenamed("run", "tree").drop("p1")
    says = routed.join(TR.leaf_values(shared, cut, cuts), ["tree", "leaf"])
    direct = TR.apply_trees(data.withColumn("id", F.monotonically_increasing_id()).join(runs.select("run")), own, FEATS, compile_limit=0)
    assert {(r["run"], r["id"]): round(r["p1"], 12) for r in says.collect()} == {(r["run"], r["id"]): round(r["p1"], 12) for r in direct.collect()}


@pytest.mark.parametrize("criterion,balanced,leaf", [("entropy", True, 3)])
def test_subtrees_grown_in_one_task_equal_levels(spark, monkeypatch, criterion, balanced, leaf):
    x, y = rows(150, 4, 5)
    runs = spark.createDataFrame([("r", criterion, 4, leaf, balanced), ("q", criterion, 3, leaf + 1, balanced)], "run string, criterion string, max_depth int, min_samples_leaf int, balanced boolean")
    data = frame(spark, x, y).join(runs.select("run"))
    found = {}
    for limit in (100_000, 60, 0):  # all in one task, from some level on, never
        monkeypatch.setattr(TR, "LOCAL_ROWS", limit)
        found[limit] = nodes_of(TR.fit_trees(data, runs, FEATS))
    assert found[100_000] == found[60] == found[0] and len(found[0]["r"]) > 8


def test_runs_of_a_part_fit_together_as_alone(spark):
    x, y = rows(400, 2)
    part = ["even" if i % 2 else "odd" for i in range(len(y))]
    data = frame(spark, x, y, part=part)
    grid = [(p, c, l1, b, i) for p in ("even", "odd") for c in (0.01, 10.0) for l1 in (0.0, 1.0) for b in (False, True) for i in (False, True)]
    schema = "run string, part string, C double, l1 double, balanced boolean, penalise_intercept boolean"
    runs = spark.createDataFrame([(f"{k}", *g) for k, g in enumerate(grid)], schema)
    together = {r["run"]: [*r["coefficients"], r["intercept"]] for r in LIN.fit_runs(data, runs, FEATS).collect()}
    assert len(together) == len(grid)
    for k in (3, 30):
        one = runs.where(F.col("run") == str(k))
        alone = LIN.fit_runs(data.where(F.col("part") == grid[k][0]).drop("part").withColumn("run", F.lit(str(k))), one.drop("part"), FEATS).first()
        assert np.allclose(together[str(k)], [*alone["coefficients"], alone["intercept"]], atol=1e-9, rtol=1e-9)


def plain_tree(x, y, crit, depth, split, leaf, balanced):
    n1 = y.sum()
    w = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1))) if balanced else np.ones(len(y))

    def impurity(m):
        p = np.array([w[m & (y == 0)].sum(), w[m & (y == 1)].sum()]) / w[m].sum()
        return 1 - (p**2).sum() if crit == "gini" else -sum(v * np.log2(v) for v in p if v > 0)

    def build(m, d):
        value = w[m & (y == 1)].sum() / w[m].sum()
        if (depth is not None and d >= depth) or m.sum() < split or m.sum() < 2 * leaf or impurity(m) <= 2.3e-16:
            return value
        best = None
        for f in range(x.shape[1]):
            v = np.unique(x[m, f])
            for a, b in zip(v, v[1:]):
                left = m & (x[:, f] <= a)
                right = m & ~left
                if left.sum() >= leaf and right.sum() >= leaf:
                    s = w[left].sum() * impurity(left) + w[right].sum() * impurity(right)
                    if best is None or s < best[0] - 1e-12:
                        best = (s, f, (a + b) / 2, left, right)
        if best is None:
            return value
        return best[1], best[2], build(best[3], d + 1), build(best[4], d + 1)

    return build(np.ones(len(y), bool), 0)


def says(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def f1(y, p):
    tp = ((p == 1) & (y == 1)).sum()
    return 2 * tp / (2 * tp + (p != y).sum()) if tp else 0.0


def test_grid_scores_and_winner_equal_plain_code(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 6, 150), rng.integers(0, 4, 150), rng.integers(0, 3, 150), rng.random(150).round(1)]).astype(float)
    y = (rng.random(150) < 1 / (1 + np.exp(-(x[:, 0] - 2.5)))).astype(int)
    fold = np.arange(150) % 5
    data = spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), int(fold[i])) for i in range(150)], ["orig_index", *MD.FEATS, "y", "fold"])
    grid = [g for g in MD.tree_grid() if g["max_depth"] in (None, 3) and g["min_samples_split"] in (2, 10)]
    got = {r["params"]: (r["f1_mean"], r["accuracy_mean"]) for r in MD.cv_summary(MD.cross_validate(data, MD.candidates(spark, tree_list=grid)), ["cand_id", "model"]).join(MD.candidates(spark, tree_list=grid).select("cand_id", "params"), "cand_id").collect()}
    import json

    best = {}
    for g in grid:
        scores = []
        for k in range(5):
            tree = plain_tree(x[fold != k], y[fold != k], g["criterion"], g["max_depth"], g["min_samples_split"], g["min_samples_leaf"], g["balanced"])
            p = np.array([says(tree, r) > 0.5 for r in x[fold == k]]).astype(int)
            scores.append((f1(y[fold == k], p), (p == y[fold == k]).mean()))
        best[json.dumps(g["_params"], sort_keys=True)] = tuple(np.mean(scores, axis=0))
    assert set(got) == set(best) and all(np.allclose(got[k], best[k], atol=1e-9) for k in best)


def test_ablation_equals_fits_without_the_feature(spark):
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.integers(0, 6, 200), rng.integers(0, 5, 200), rng.integers(0, 4, 200), rng.random(200).round(2)]).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] - 2.5) - (x[:, 3] - 0.5)))).astype(int)
    fold = np.arange(200) % 5
    data = spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), int(fold[i])) for i in range(200)], ["orig_index", *MD.FEATS, "y", "fold"])
    out = {(r["model"], r["removed_feature"]): r["f1_mean"] for r in MD.ablation(data, MD.candidates(spark, lr=MD.LR_TUNED, tree=MD.TREE_TUNED)).collect()}
    assert len(out) == 10
    for removed in ["None", *MD.FEATS]:
        keep = [i for i, c in enumerate(MD.FEATS) if c != removed]
        scores = []
        for k in range(5):
            tree = plain_tree(x[fold != k][:, keep], y[fold != k], "entropy", 5, 2, 1, False)
            p = np.array([says(tree, r) > 0.5 for r in x[fold == k][:, keep]]).astype(int)
            scores.append(f1(y[fold == k], p))
        assert abs(out[MD.TREE_NAME, removed] - np.mean(scores)) < 1e-9
