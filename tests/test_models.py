"""Model operators against brute force: Newton LR vs numpy, PAV vs max-min, tree splits vs exhaustive search."""

import numpy as np
from pyspark.sql import functions as F

from parley.operators import calibrate as CAL
from parley.operators import linear as LIN
from parley.operators import tree as TR
from parley.operators import tree_text as TT


def _numpy_lr(X, y, C, iters=100):
    Z = (X - X.mean(0)) / np.where(X.std(0) == 0, 1, X.std(0))
    A = np.hstack([Z, np.ones((len(Z), 1))])
    b = np.zeros(A.shape[1])
    for _ in range(iters):
        s = 1 / (1 + np.exp(-A @ b))
        g = C * A.T @ (s - y) + b
        H = C * (A.T * (s * (1 - s))) @ A + np.eye(len(b))
        b = b - np.linalg.solve(H, g)
    return b


def test_logistic_l2_matches_numpy_newton(spark):
    rng = np.random.default_rng(3)
    X = rng.integers(0, 6, (300, 3)).astype(float)
    y = (X @ [0.8, -0.5, 0.3] + rng.normal(0, 1, 300) > 1).astype(int)
    rows = [("r", *map(float, x), int(t)) for x, t in zip(X, y)]
    df = spark.createDataFrame(rows, "run string, a double, b double, c double, y int")
    runs = spark.createDataFrame([("r", 1.0, 0.0, False)], "run string, C double, l1 double, balanced boolean")
    m = LIN.fit_runs(df, runs, ["a", "b", "c"]).first()
    want = _numpy_lr(X, y, 1.0)
    got = np.array(list(m.coefficients) + [m.intercept])
    assert np.allclose(got, want, atol=1e-6)


def test_logistic_l1_zeroes_useless_feature(spark):
    rng = np.random.default_rng(4)
    X = np.hstack([rng.normal(0, 1, (400, 1)), rng.normal(0, 1, (400, 1))])
    y = (X[:, 0] + rng.normal(0, 0.5, 400) > 0).astype(int)
    rows = [("r", float(a), float(b), int(t)) for (a, b), t in zip(X, y)]
    df = spark.createDataFrame(rows, "run string, a double, b double, y int")
    runs = spark.createDataFrame([("r", 0.01, 1.0, False)], "run string, C double, l1 double, balanced boolean")
    m = LIN.fit_runs(df, runs, ["a", "b"]).first()
    assert m.coefficients[0] > 0 and m.coefficients[1] == 0.0


def _maxmin(y, w):
    n = len(y)
    cs, cw = np.concatenate([[0], np.cumsum(y * w)]), np.concatenate([[0], np.cumsum(w)])
    return np.array([max(min((cs[b + 1] - cs[a]) / (cw[b + 1] - cw[a]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_pav_equals_max_min_formula():
    rng = np.random.default_rng(5)
    x = np.arange(40, dtype=float)
    y = (rng.random(40) < x / 40).astype(float)
    w = rng.integers(1, 5, 40).astype(float)
    pool = CAL.Pool()
    for a, sy, n in zip(x, y * w, w):
        pool.add(a, a, sy, n)
    full = np.interp(x, [e for b in pool.blocks for e in b[:2]], [b[2] / b[3] for b in pool.blocks for _ in "ab"])
    assert np.allclose(full, _maxmin(y, w))
    assert np.all(np.diff(full) >= 0)


def test_isotonic_apply_interpolates_and_clips(spark):
    fit = spark.createDataFrame([("r", 0.2, 0.1), ("r", 0.6, 0.5)], "run string, x double, fitted double")
    df = spark.createDataFrame([("r", 0.0), ("r", 0.4), ("r", 0.9)], "run string, score double")
    got = [round(r.p_cal, 9) for r in CAL.apply_isotonic(df, fit).orderBy("score").collect()]
    assert got == [0.1, 0.3, 0.5]


def test_platt_recovers_logistic_link(spark):
    rng = np.random.default_rng(6)
    s = rng.normal(0, 2, 3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(1.5 * s - 0.5)))).astype(int)
    df = spark.createDataFrame([("r", float(a), int(b)) for a, b in zip(s, y)], "run string, score double, y int")
    p = CAL.fit_platt(df).first()
    assert abs(p.a - 1.5) < 0.25 and abs(p.b + 0.5) < 0.25


def _best_root_split(X, y):
    best = None
    for f in range(X.shape[1]):
        vals = np.unique(X[:, f])
        for v, nv in zip(vals[:-1], vals[1:]):
            t = (v + nv) / 2
            left = X[:, f] <= t

            def g(m):
                n = m.sum()
                p1 = y[m].mean()
                return n * (1 - p1 * p1 - (1 - p1) ** 2)

            sc = g(left) + g(~left)
            if best is None or sc < best[0] - 1e-12:
                best = (sc, f, t)
    return best


def test_tree_root_split_and_importance(spark):
    rng = np.random.default_rng(7)
    X = rng.integers(0, 8, (250, 3)).astype(float)
    y = ((X[:, 1] > 3) ^ (rng.random(250) < 0.1)).astype(int)
    df = spark.createDataFrame([("r", *map(float, x), int(t)) for x, t in zip(X, y)], "run string, a double, b double, c double, y int")
    runs = spark.createDataFrame([("r", "gini", 3)], "run string, criterion string, max_depth int")
    nodes = TR.fit_trees(df, runs, ["a", "b", "c"])
    root = nodes.where("node = ''").first()
    sc, f, t = _best_root_split(X, y)
    assert root.feature_index == f and root.threshold == t
    imp = {r.feature: r.importance for r in TR.importances(nodes, ["a", "b", "c"]).collect()}
    assert abs(sum(imp.values()) - 1.0) < 1e-9 and imp["b"] == max(imp.values())
    assert nodes.agg(F.max("depth")).first()[0] <= 3
    # every row reaches exactly one leaf
    scored = TR.apply_trees(df, nodes, ["a", "b", "c"])
    assert scored.count() == 250


def test_rules_roundtrip():
    from parley.plans.q_fixed import EXAMPLE_RULES

    tree = TT.parse_rules(EXAMPLE_RULES)
    assert tree[0] == "split" and tree[1] == "aggregate_money_terms" and tree[2] == 3.5
    assert TT.rules_sql(tree).count("CASE WHEN") == 3


def test_bucketed_and_window_split_search_agree(spark):
    rng = np.random.default_rng(8)
    n = 3000
    X = np.round(rng.normal(0, 1, (n, 2)), 3)
    y = ((X[:, 0] + 0.3 * X[:, 1]) > 0.2).astype(int)
    rows = spark.createDataFrame(
        [("r", str(i % 3), float(a), float(b), int(t), 1) for i, ((a, b), t) in enumerate(zip(X, y))],
        "run string, node string, a double, b double, y int, cnt long",
    )
    stats = rows.groupBy("run", "node").agg(
        F.sum("cnt").alias("n_node"), F.sum(F.when(F.col("y") == 1, F.col("cnt")).otherwise(0)).alias("c1_node")
    ).select("*", F.lit(0.7).alias("cw0"), F.lit(1.3).alias("cw1"), F.lit("gini").alias("criterion"), F.lit(5).alias("msl"))
    a, b, c = ({tuple(r) for r in TR.best_splits(rows, stats, ["a", "b"], n_buckets=n).collect()} for n in (1, 16, 64))
    assert a == b == c and len(a) == 3  # bit-equal, with fractional class weights


def test_one_row_in_forty_million_is_split_off(spark):
    rows = spark.createDataFrame([("r", 0.0, 0, 40_000_000), ("r", 1.0, 1, 1)], "run string, a double, y int, cnt long")
    nodes = TR.fit_trees(rows, spark.createDataFrame([("r",)], "run string"), ["a"])
    assert nodes.count() == 3 and nodes.where("is_leaf").agg(F.max("impurity")).first()[0] == 0.0


def test_no_depth_is_too_deep(spark):
    """A node 75 levels down is split like any other, and its path orders the rule lines."""
    deep = "1" * 75
    rows = spark.createDataFrame([("r", deep, 1.0, 0, 5), ("r", deep, 2.0, 1, 4)], "run string, node string, a double, y int, cnt long")
    _, params = TR.compact_rows(rows.drop("node"), TR.tree_params(spark.createDataFrame([("r",)], "run string")), ["a"])
    level = TR._level(rows, params, ["a"], depth=75, n_buckets=1).collect()
    assert [(n.node, n.is_leaf, n.threshold, n.n_left, n.n_right) for n in level] == [(deep, False, 1.5, 5, 4)]
    chain = [("r", "1" * d, d, False, "a", float(d), 0.0) for d in range(76)] + [("r", "1" * d + "0", d + 1, True, None, None, 0.0) for d in range(76)] + [("r", "1" * 76, 76, True, None, None, 1.0)]
    nodes = spark.createDataFrame(chain, "run string, node string, depth int, is_leaf boolean, feature string, threshold double, p1 double")
    lines = [r.line for r in TT.rule_lines(nodes).orderBy("sort_key").collect()]
    assert len(lines) == 2 * 76 + 77 and lines[0] == "|--- a <= 0.0000" and lines[-1] == "|   " * 76 + "|--- class: 1"
    paths = {r.leaf: r.conditions for r in TT.leaf_paths(nodes).where("depth = 76 and class = 1").collect()}
    assert len(paths["1" * 76]) == 76


def _cart(X, y, cw, criterion, depth, split, leaf, path=""):
    """Plain CART: {path: (n, feature, threshold) or (n, share of class 1)}."""

    def imp(w0, w1):
        p = np.array([w0, w1]) / (w0 + w1)
        return 1 - (p * p).sum() if criterion == "gini" else -sum(q * np.log2(q) for q in p if q > 0)

    w0, w1 = (y == 0).sum() * cw[0], (y == 1).sum() * cw[1]
    out = {path: (len(y), None, w1 / (w0 + w1))}
    if len(path) >= depth or len(y) < split or len(y) < 2 * leaf or imp(w0, w1) <= 2.3e-16:
        return out
    best = None
    for f in range(X.shape[1]):
        values = np.unique(X[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = X[:, f] <= t
            if min(left.sum(), (~left).sum()) < leaf:
                continue
            parts = [((y[s] == 0).sum() * cw[0], (y[s] == 1).sum() * cw[1]) for s in (left, ~left)]
            score = sum((a + b) * imp(a, b) for a, b in parts)
            if best is None or score < best[0] - 1e-9:
                best = (score, f, t, left)
    if best is None:
        return out
    _, f, t, left = best
    out[path] = (len(y), f, t)
    for s, step in ((left, "0"), (~left, "1")):
        out |= _cart(X[s], y[s], cw, criterion, depth, split, leaf, path + step)
    return out


def test_trees_equal_plain_cart(spark):
    rng = np.random.default_rng(11)
    X = rng.integers(0, 9, (220, 3)).astype(float)
    y = ((X[:, 0] * 2 + X[:, 1] > 12) ^ (rng.random(220) < 0.2)).astype(int)
    settings = {"r0": ("entropy", 4, 10, 5, True), "r1": ("gini", 5, 2, 1, False), "r2": ("gini", 3, 30, 2, True)}
    df = spark.createDataFrame([(r, *map(float, x), int(t)) for r in settings for x, t in zip(X, y)], "run string, a double, b double, c double, y int")
    runs = spark.createDataFrame([(r, *s) for r, s in settings.items()], "run string, criterion string, max_depth int, min_samples_split int, min_samples_leaf int, balanced boolean")
    got = TR.fit_trees(df, runs, ["a", "b", "c"]).collect()
    for r, (criterion, depth, split, leaf, balanced) in settings.items():
        cw = [len(y) / (2 * (y == c).sum()) if balanced else 1.0 for c in (0, 1)]
        want = _cart(X, y, cw, criterion, depth, split, leaf)
        tree = {n.node: n for n in got if n.run == r}
        assert set(tree) == set(want)
        for path, (n, f, v) in want.items():
            assert tree[path].n == n and tree[path].feature_index == f
            assert abs((tree[path].threshold if f is not None else tree[path].p1) - v) < 1e-12


def test_intercept_free_or_penalised(spark):
    """Against plain gradient conditions, on imbalanced classes."""
    rng = np.random.default_rng(12)
    X = rng.integers(0, 6, (400, 2)).astype(float)
    y = (X @ [0.9, -0.4] + rng.normal(0, 1, 400) > 3.2).astype(int)
    df = spark.createDataFrame([(r, *map(float, x), int(t)) for r in ("free", "o'neil") for x, t in zip(X, y)], "run string, a double, b double, y int")
    runs = spark.createDataFrame([("free", 1.0, 0.0, False, False), ("o'neil", 1.0, 0.0, False, True)], "run string, C double, l1 double, balanced boolean, penalise_intercept boolean")
    got = {r.run: r for r in LIN.fit_runs(df, runs, ["a", "b"]).collect()}
    Z = np.hstack([(X - X.mean(0)) / X.std(0), np.ones((len(X), 1))])
    for run, weights in (("free", [1, 1, 0]), ("o'neil", [1, 1, 1])):
        b = np.array([*got[run].coefficients, got[run].intercept])
        gradient = Z.T @ (1 / (1 + np.exp(-Z @ b)) - y) + np.array(weights) * b
        assert np.abs(gradient).max() < 1e-8 and got[run].converged and got[run].iterations < 50
    assert abs(got["free"].intercept) > abs(got["o'neil"].intercept)
    capped = LIN.fit_logistic(spark.createDataFrame([("r", 1.0, 1, 1.0), ("r", -1.0, 0, 1.0)], "run string, z0 double, y int, w double"), spark.createDataFrame([("r", 1.0, False)], "run string, C double, l1 boolean"), 1, max_iter=1).first()
    assert not capped.converged


def test_l1_meets_the_optimality_conditions(spark):
    rng = np.random.default_rng(13)
    X = rng.integers(0, 7, (300, 3)).astype(float)
    y = (X @ [0.8, -0.5, 0.0] + rng.normal(0, 1, 300) > 2.5).astype(int)
    runs = spark.createDataFrame([(f"r{c}", c, 1.0, True) for c in (0.01, 0.1, 10.0)], "run string, C double, l1 double, balanced boolean")
    df = spark.createDataFrame([(f"r{c}", *map(float, x), int(t)) for c in (0.01, 0.1, 10.0) for x, t in zip(X, y)], "run string, a double, b double, c double, y int")
    Z = np.hstack([(X - X.mean(0)) / X.std(0), np.ones((len(X), 1))])
    w = np.array([len(y) / (2 * (y == t).sum()) for t in y])
    for r in LIN.fit_runs(df, runs, ["a", "b", "c"]).collect():
        b = np.array([*r.coefficients, r.intercept])
        g = float(r.run[1:]) * Z.T @ (w * (1 / (1 + np.exp(-Z @ b)) - y))
        assert all(abs(gi + np.sign(bi)) < 1e-6 if bi else abs(gi) <= 1 + 1e-9 for gi, bi in zip(g, b))


def _newton(A, y, w, penalty):
    b = np.zeros(A.shape[1])
    for _ in range(200):
        s = 1 / (1 + np.exp(-A @ b))
        b = b - np.linalg.solve((A.T * (w * s * (1 - s))) @ A + np.diag(penalty), A.T @ (w * (s - y)) + penalty * b)
    return b


def test_platt_is_the_optimum(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(0, 1, 300)
    y = (x + rng.normal(0, 1.5, 300) > 0.5).astype(int)
    got = CAL.fit_platt(spark.createDataFrame([("r", float(a), int(t)) for a, t in zip(x, y)], "run string, score double, y int")).first()
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    want = _newton(np.column_stack([x, np.ones(len(x))]), t, np.ones(len(x)), np.zeros(2))
    assert np.allclose([got.a, got.b], want, atol=1e-6)


def test_cross_validation_and_held_out_scores_equal_numpy(spark):
    from parley.operators import modelling as MD

    rng = np.random.default_rng(15)
    feats = MD.FEATS
    X = rng.integers(0, 6, (120, 4)).astype(float)
    y = (X @ [0.5, -0.4, 0.3, 0.1] + rng.normal(0, 1, 120) > 1.2).astype(int)
    fold = rng.integers(0, 10, 120)
    data = spark.createDataFrame([(i, *map(float, x), int(t), int(f)) for i, (x, t, f) in enumerate(zip(X, y, fold))], "orig_index bigint, " + ", ".join(f"{c} double" for c in feats) + ", y int, fold int")

    def fit(tr):
        m, s = X[tr].mean(0), X[tr].std(0)
        Z = lambda a: np.hstack([(a - m) / np.where(s == 0, 1, s), np.ones((len(a), 1))])
        b = _newton(Z(X[tr]), y[tr], np.ones(tr.sum()), np.array([1, 1, 1, 1, 0.0]))
        return lambda a: 1 / (1 + np.exp(-Z(a) @ b))

    got = {r.k: r for r in MD.cross_validate(data, MD.candidates(spark, lr=MD.LR_BASELINE), 10).collect()}
    assert len(got) == 10
    for k in range(10):
        p = fit(fold != k)(X[fold == k])
        pred, true = p > 0.5, y[fold == k]
        tp = (pred & (true == 1)).sum()
        assert abs(got[k].accuracy - (pred == true).mean()) < 1e-12
        assert abs(got[k].recall - (tp / true.sum() if true.sum() else 0)) < 1e-12
        assert abs(got[k].brier_score - ((p - true) ** 2).mean()) < 1e-9
        pos, neg = p[true == 1], p[true == 0]
        if len(pos) and len(neg):
            assert abs(got[k].roc_auc - np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])) < 1e-9
    cands = MD.candidates(spark, lr=MD.LR_BASELINE)
    models, nodes = MD.fit_full(data.where("fold < 8"), cands)
    scored = {r.orig_index: r.p1 for r in MD.score_full(data.where("fold >= 8"), cands, models, nodes).collect()}
    want = fit(fold < 8)(X[fold >= 8])
    assert np.allclose([scored[i] for i in np.flatnonzero(fold >= 8)], want, atol=1e-8)


def test_nested_calibration_covers_every_outer_fold(spark):
    from parley.operators import modelling as MD
    from parley.operators import split as S
    from parley.operators import thresholds as T

    rng = np.random.default_rng(16)
    X = rng.integers(0, 6, (200, 4)).astype(float)
    y = (X[:, 0] - X[:, 1] + rng.normal(0, 1, 200) > 0).astype(int)
    data = spark.createDataFrame([(i, *map(float, x), int(t), i % 10) for i, (x, t) in enumerate(zip(X, y))], "orig_index bigint, " + ", ".join(f"{c} double" for c in MD.FEATS) + ", y int, fold int")
    nested = S.nested_folds(data.select("orig_index", F.col("y").alias("thread_label"), "fold"), k_outer=10)
    oof, metrics = MD.nested_calibration(data, nested.select("orig_index", "outer_fold", "inner_fold"), MD.candidates(spark, lr=MD.LR_BASELINE), methods=("sigmoid",))
    rows = oof.collect()
    assert {r.fold for r in rows} == set(range(10)) and sorted(r.orig_index for r in rows) == list(range(200))
    assert metrics.count() == 10
    inner = {(r.orig_index, r.outer_fold): r.inner_fold for r in nested.collect()}
    for k in (3, 9):  # the calibrated mean of three inner models, from scratch
        test = np.arange(200) % 10 == k
        total = np.zeros(test.sum())
        for j in range(3):
            tr = np.array([(i, k) in inner and inner[i, k] != j for i in range(200)])
            ca = np.array([(i, k) in inner and inner[i, k] == j for i in range(200)])
            m, s = X[tr].mean(0), X[tr].std(0)
            Z = lambda a: np.hstack([(a - m) / s, np.ones((len(a), 1))])  # noqa: B023, E731
            b = _newton(Z(X[tr]), y[tr], np.ones(tr.sum()), np.array([1, 1, 1, 1, 0.0]))
            sc, yc = Z(X[ca]) @ b, y[ca]
            t = np.where(yc == 1, (yc.sum() + 1) / (yc.sum() + 2), 1 / ((1 - yc).sum() + 2))
            ab = _newton(np.column_stack([sc, np.ones(len(sc))]), t, np.ones(len(sc)), np.zeros(2))
            total += 1 / (1 + np.exp(-(Z(X[test]) @ b * ab[0] + ab[1])))
        got = np.array([r.p for r in sorted(rows, key=lambda r: r.orig_index) if r.fold == k])
        assert np.allclose(got, total / 3, atol=1e-6)
    scored = oof.select("model", "orig_index", "y", "p")
    bands = T.risk_bands(T.sweep(scored, "y", "p", ["model"]), ["model"])
    edges = sorted((r.probability_min, r.probability_max_exclusive) for r in bands.collect())
    assert edges[0][0] == 0.0 and edges[-1][1] == 1.01 and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
    placed = T.assign_band(scored, bands, "p", ["model"]).collect()
    assert len(placed) == 200 and all(r.risk_band for r in placed)


def test_compiled_and_joined_tree_routing_agree(spark):
    rng = np.random.default_rng(9)
    X = rng.integers(0, 10, (400, 3)).astype(float)
    y = ((X[:, 0] + X[:, 2] > 9) ^ (rng.random(400) < 0.15)).astype(int)
    df = spark.createDataFrame(
        [(f"r{i % 2}", i, *map(float, x), int(t)) for i, (x, t) in enumerate(zip(X, y))],
        "run string, id int, a double, b double, c double, y int",
    )
    runs = spark.createDataFrame([("r0", "gini", 4), ("r1", "entropy", 6)], "run string, criterion string, max_depth int")
    nodes = TR.fit_trees(df.select("run", "a", "b", "c", "y"), runs, ["a", "b", "c"])
    fast = {(r.run, r.id): (r.leaf, r.p1) for r in TR.apply_trees(df, nodes, ["a", "b", "c"]).collect()}
    slow = {(r.run, r.id): (r.leaf, r.p1) for r in TR.apply_trees(df, nodes, ["a", "b", "c"], compile_limit=0).collect()}
    assert fast == slow and len(fast) == 400
