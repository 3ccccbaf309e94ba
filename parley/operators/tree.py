"""Exact CART (gini / entropy) grown level by level for many runs at once.

Rows are compacted to (run, node, features..., y, cnt) and carry a per-run class
weight. One level = one distributed pass:
  1. node statistics per (run, node);
  2. candidate splits: per (run, node, feature, value) class counts, exact running
     sums over the value order (bucketed prefix sums, no per-node global sort) and the
     next distinct value -> midpoint thresholds;
  3. best split per (run, node) as a ``min(struct(score, feature, threshold))`` hash
     aggregate (ties: lower feature index, then lower threshold);
  4. rows move to a child; rows that reached a leaf leave the active set.
A node is its path from the root, a string of 0 (left) and 1 (right): depth is its length,
its parent the string without the last step, and sorting by it is depth-first order, at any
depth. Counts are integers per class; class weights enter where a node or side is scored, so
sums are exact and don't depend on how the work is split.
The active rows are checkpointed every level (reliable checkpoint, survives executor
loss). The driver only sees per-level row counts; nodes are a DataFrame.

A node with at most LOCAL_ROWS compacted rows needs no further passes: its rows go to one task,
which grows the subtree below it with the same formulas and ties (``grow``). So the number of
passes follows the size of the data, and a small table takes one.

Candidates that differ only in their depth limit and ``min_samples_split`` share one tree: the
best split of a node depends on neither, so each candidate's tree is the shared one cut where
its own limits stop (``cut_trees``).

Stopping rules follow the reference library: depth limit, ``min_samples_split``,
``2 * min_samples_leaf``, pure node, or no valid split; leaf sizes use row counts,
impurities use class-weighted counts.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PURE = 2.220446049250313e-16  # machine epsilon: an impurity above it can be split
UNLIMITED = 2**31 - 1
TIES = 1e12  # scores per unit of weight are compared in steps of its inverse, so that rounding decides no tie
ROOT = ""
LOCAL_ROWS = 100_000  # compacted rows of a node whose subtree one task grows
ROWS_PER_BUCKET = 1_000_000  # compacted rows of a node that one ordered window takes


def impurity(w0: Column, w1: Column, criterion: Column) -> Column:
    n = w0 + w1
    p0 = F.when(n > 0, w0 / n).otherwise(F.lit(0.0))
    p1 = F.when(n > 0, w1 / n).otherwise(F.lit(0.0))
    gini = F.lit(1.0) - p0 * p0 - p1 * p1

    def xlog(p):
        return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))

    ent = -(xlog(p0) + xlog(p1))
    return F.when(criterion == "entropy", ent).otherwise(gini)


def _view(df: DataFrame, prefix: str) -> str:
    name = f"{prefix}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def _imp_sql(a: str, b: str) -> str:
    n = f"({a} + {b})"
    p0 = f"(CASE WHEN {n} > 0 THEN {a} / {n} ELSE 0.0D END)"
    p1 = f"(CASE WHEN {n} > 0 THEN {b} / {n} ELSE 0.0D END)"
    gini = f"(1.0D - {p0} * {p0} - {p1} * {p1})"
    ent = f"(-((CASE WHEN {p0} > 0 THEN {p0} * log2({p0}) ELSE 0.0D END) + (CASE WHEN {p1} > 0 THEN {p1} * log2({p1}) ELSE 0.0D END)))"
    return f"(CASE WHEN criterion = 'entropy' THEN {ent} ELSE {gini} END)"


def best_splits(rows: DataFrame, node_stats: DataFrame, feats, keys=("run", "node"), n_buckets: int = 1) -> DataFrame:
    """Best valid split per node, as one SQL statement.

    rows: keys + feats + (y, cnt); node_stats: keys + (n_node, c1_node, cw0, cw1 [class
    weights], criterion, msl). Class counts per (node, feature, value) are aggregated, running sums
    over the value order use order-preserving buckets (approximate quantile bounds per
    group, exact offsets from integer bucket totals; any number of buckets gives the same
    result; nodes and bounds are broadcast, so that a node's rows never meet in one task), midpoints use the next distinct value, and
    the winner is ``min(struct(score, feature, threshold))`` per node, with scores per unit of weight
    that are equal to 12 places taken as ties.
    """
    spark = rows.sparkSession
    rv, sv = _view(rows, "parley_rows"), _view(node_stats, "parley_nodes")
    k = ", ".join(keys)
    structs = ", ".join(f"named_struct('f', {i}, 'v', CAST({c} AS DOUBLE))" for i, c in enumerate(feats))
    probs = ", ".join(repr(i / n_buckets) for i in range(1, n_buckets))
    score = f"(lw0 + lw1) * {_imp_sql('lw0', 'lw1')} + (rw0 + rw1) * {_imp_sql('rw0', 'rw1')}"
    if n_buckets > 1:
        buckets = f"""bnd AS (SELECT {k}, f, percentile_approx(v, array({probs}), 1000) AS bnds FROM per GROUP BY {k}, f),
    bkt AS (SELECT /*+ BROADCAST(b) */ p.*, size(filter(b.bnds, x -> x < p.v)) AS bk FROM per p JOIN bnd b USING ({k}, f)),"""
    else:
        buckets = "bkt AS (SELECT p.*, 0 AS bk FROM per p),"
    sql = f"""
    WITH act AS (SELECT /*+ BROADCAST(s) */ r.* FROM {rv} r LEFT SEMI JOIN {sv} s USING ({k})),
    lng AS (SELECT {k}, y, cnt, inline(array({structs})) FROM act),
    per AS (SELECT {k}, f, v, sum(cnt) AS n, sum(CASE WHEN y = 1 THEN cnt ELSE 0 END) AS n1 FROM lng GROUP BY {k}, f, v),
    {buckets}
    tot AS (SELECT {k}, f, bk, sum(n) AS tn, sum(n1) AS tn1, min(v) AS mn FROM bkt GROUP BY {k}, f, bk),
    off AS (SELECT {k}, f, bk, coalesce(sum(tn) OVER wb, 0) AS o_n, coalesce(sum(tn1) OVER wb, 0) AS o_n1,
                   lead(mn) OVER (PARTITION BY {k}, f ORDER BY bk) AS nextmin
            FROM tot WINDOW wb AS (PARTITION BY {k}, f ORDER BY bk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    cum AS (SELECT {k}, f, v, o_n + sum(n) OVER wl AS ln, o_n1 + sum(n1) OVER wl AS ln1,
                   coalesce(lead(v) OVER (PARTITION BY {k}, f, bk ORDER BY v), nextmin) AS next_v
            FROM bkt JOIN off USING ({k}, f, bk)
            WINDOW wl AS (PARTITION BY {k}, f, bk ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    cand AS (SELECT /*+ BROADCAST(s) */ {k}, f, ln, n_node - ln AS rn, (ln - ln1) * cw0 AS lw0, ln1 * cw1 AS lw1,
                    (n_node - c1_node - ln + ln1) * cw0 AS rw0, (c1_node - ln1) * cw1 AS rw1, criterion,
                    CASE WHEN (v + next_v) / 2.0D = next_v THEN v ELSE (v + next_v) / 2.0D END AS threshold
             FROM cum JOIN {sv} s USING ({k}) WHERE next_v IS NOT NULL AND ln >= msl AND n_node - ln >= msl),
    scored AS (SELECT {k}, f, threshold, ln, rn, {score} AS score, lw0 + lw1 + rw0 + rw1 AS weight FROM cand)
    SELECT {k}, b.score AS score, b.f AS feature_index, b.threshold AS threshold, b.ln AS n_left, b.rn AS n_right
    FROM (SELECT {k}, min(named_struct('key', floor(score / weight * {TIES} + 0.5D), 'f', f, 'threshold', threshold, 'score', score, 'ln', ln, 'rn', rn)) AS b
          FROM scored GROUP BY {k})"""
    out = spark.sql(sql)
    for view in (rv, sv):  # analysed already
        spark.catalog.dropTempView(view)
    return out


def _node_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run", "node").agg(
        F.sum("cnt").alias("n_node"),
        F.sum(F.when(F.col("y") == 0, F.col("cnt")).otherwise(0)).alias("c0"),
        F.sum(F.when(F.col("y") == 1, F.col("cnt")).otherwise(0)).alias("c1"),
    )


def tree_params(runs: DataFrame) -> DataFrame:
    """Normalise a run-parameter table: (run, criterion, max_depth, min_samples_split, min_samples_leaf, balanced)."""
    cols = set(runs.columns)

    def get(name, default, dtype):
        return (F.coalesce(F.col(name).cast(dtype), F.lit(default).cast(dtype)) if name in cols else F.lit(default).cast(dtype)).alias(name)

    return runs.select(
        "run",
        get("criterion", "gini", "string"),
        get("max_depth", UNLIMITED, "int"),
        get("min_samples_split", 2, "int"),
        get("min_samples_leaf", 1, "int"),
        get("balanced", False, "boolean"),
    )


def compact_rows(train: DataFrame, params: DataFrame, feats, y: str = "y") -> tuple[DataFrame, DataFrame]:
    """Compacted (run, features, y, cnt), and the parameters with each run's class weights cw0, cw1 (``balanced`` = n / (2 n_c))."""
    n = F.sum("cnt") if "cnt" in train.columns else F.count(F.lit(1))
    compact = train.groupBy("run", *feats, F.col(y).alias("y")).agg(n.alias("cnt"))
    cls = compact.groupBy("run", "y").agg(F.sum("cnt").alias("n_c"))
    tot = cls.groupBy("run").agg(F.sum("n_c").alias("n_run"), F.count(F.lit(1)).alias("k"))
    cw = cls.join(tot, "run").join(params.select("run", "balanced"), "run").select(
        "run", "y", F.when(F.col("balanced"), F.col("n_run") / (F.col("k") * F.col("n_c"))).otherwise(F.lit(1.0)).alias("cw")
    )
    by_class = cw.groupBy("run").agg(*[F.coalesce(F.max(F.when(F.col("y") == c, F.col("cw"))), F.lit(1.0)).alias(f"cw{c}") for c in (0, 1)])
    return compact, params.join(by_class, "run")


def _level(rows: DataFrame, params: DataFrame, feats, depth: int, n_buckets: int) -> DataFrame:
    """One tree level for every run: node statistics, stopping rules, best split, node rows."""
    stats = _node_stats(rows).join(F.broadcast(params), "run")  # params: one row per run
    stats = stats.withColumn("w0_node", F.col("c0") * F.col("cw0")).withColumn("w1_node", F.col("c1") * F.col("cw1"))
    imp = impurity(F.col("w0_node"), F.col("w1_node"), F.col("criterion"))
    stats = stats.withColumn("impurity", imp).withColumn(
        "can_split",
        (F.lit(depth) < F.col("max_depth"))
        & (F.col("n_node") >= F.col("min_samples_split"))
        & (F.col("n_node") >= 2 * F.col("min_samples_leaf"))
        & (F.col("impurity") > F.lit(PURE)),
    )
    open_nodes = stats.where("can_split").select(
        "run", "node", "n_node", F.col("c1").alias("c1_node"), "cw0", "cw1", "criterion", F.col("min_samples_leaf").alias("msl")
    )
    best = best_splits(rows, open_nodes, feats, n_buckets=n_buckets)
    return stats.join(best, ["run", "node"], "left").select(
        "run",
        "node",
        F.lit(depth).alias("depth"),
        F.col("n_node").alias("n"),
        "c0",
        "c1",
        F.col("w0_node").alias("w0"),
        F.col("w1_node").alias("w1"),
        "impurity",
        F.col("feature_index").isNull().alias("is_leaf"),
        "feature_index",
        F.when(F.col("feature_index").isNotNull(), F.element_at(F.array(*[F.lit(c) for c in feats]), F.col("feature_index") + 1)).alias("feature"),
        "threshold",
        ((F.col("w0_node") + F.col("w1_node")) * F.col("impurity") - F.col("score")).alias("decrease"),
        (F.col("w1_node") / (F.col("w0_node") + F.col("w1_node"))).alias("p1"),
        "n_left",
        "n_right",
    )


NODE_COLUMNS = (
    "run string, node string, depth int, n bigint, c0 bigint, c1 bigint, w0 double, w1 double, impurity double, is_leaf boolean, "
    "feature_index int, feature string, threshold double, decrease double, p1 double, n_left bigint, n_right bigint"
)


def _impure(a, b, criterion: str):
    """``impurity`` over arrays."""
    n = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        p0, p1 = np.where(n > 0, a / n, 0.0), np.where(n > 0, b / n, 0.0)
        if criterion != "entropy":
            return 1.0 - p0 * p0 - p1 * p1
        return -sum(np.where(p > 0, p * (np.log(np.where(p > 0, p, 1.0)) / math.log(2.0)), 0.0) for p in (p0, p1))


def grow(x: np.ndarray, y: np.ndarray, cnt: np.ndarray, root: str, prm: dict, feats) -> list[tuple]:
    """Nodes of the subtree below `root`: `_level` and its passes for rows that fit in one task."""
    cw0, cw1, criterion, least = prm["cw0"], prm["cw1"], prm["criterion"], prm["min_samples_leaf"]
    out, waiting = [], [(root, np.arange(len(y)))]
    while waiting:
        node, own = waiting.pop()
        ones = np.where(y[own] == 1, cnt[own], 0)
        n, c0, c1 = int(cnt[own].sum()), int(np.where(y[own] == 0, cnt[own], 0).sum()), int(ones.sum())
        w0, w1 = c0 * cw0, c1 * cw1
        pure = float(_impure(np.float64(w0), np.float64(w1), criterion))
        best, least_key = None, math.inf
        if len(node) < prm["max_depth"] and n >= prm["min_samples_split"] and n >= 2 * least and pure > PURE:
            for f in range(len(feats)):
                order = np.argsort(x[own, f], kind="stable")
                v = x[own[order], f]
                end = np.flatnonzero(v[1:] != v[:-1])  # last row of each value but the largest
                ln, ln1 = np.cumsum(cnt[own[order]])[end], np.cumsum(ones[order])[end]
                good = (ln >= least) & (n - ln >= least)
                if not good.any():
                    continue
                end, ln, ln1 = end[good], ln[good], ln1[good]
                lw0, lw1, rw0, rw1 = (ln - ln1) * cw0, ln1 * cw1, (n - c1 - ln + ln1) * cw0, (c1 - ln1) * cw1
                score = (lw0 + lw1) * _impure(lw0, lw1, criterion) + (rw0 + rw1) * _impure(rw0, rw1, criterion)
                key = np.floor(score / (lw0 + lw1 + rw0 + rw1) * TIES + 0.5)
                i = int(np.argmin(key))  # the least threshold of the least score
                if best is None or key[i] < least_key:
                    least_key, mid = key[i], (v[end[i]] + v[end[i] + 1]) / 2.0
                    best = (float(score[i]), f, float(v[end[i]] if mid == v[end[i] + 1] else mid), int(ln[i]), int(n - ln[i]))
        p1 = w1 / (w0 + w1) if w0 + w1 else None
        if best is None:
            out.append((node, len(node), n, c0, c1, w0, w1, pure, True, None, None, None, None, p1, None, None))
            continue
        score, f, threshold, left, right = best
        out.append((node, len(node), n, c0, c1, w0, w1, pure, False, f, feats[f], threshold, (w0 + w1) * pure - score, p1, left, right))
        above = x[own, f] > threshold
        waiting += [(node + "0", own[~above]), (node + "1", own[above])]
    return out


def _grown(rows: DataFrame, params: DataFrame, feats) -> DataFrame:
    """The subtrees below the nodes of `rows`, each grown in one task."""
    names = [c.split()[0] for c in NODE_COLUMNS.split(", ")]
    whole = ("depth", "n", "c0", "c1", "feature_index", "n_left", "n_right")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        x = group[list(feats)].to_numpy(dtype=float)
        made = grow(x, group["y"].to_numpy(), group["cnt"].to_numpy(dtype=np.int64), first["node"], first, feats)
        out = pd.DataFrame([(first["run"], *r) for r in made], columns=names)
        return out.astype({c: "Int64" for c in whole})

    given = rows.join(params, "run").select("run", "node", *[F.col(c).cast("double").alias(c) for c in feats], "y", "cnt", "criterion", "max_depth", "min_samples_split", "min_samples_leaf", "cw0", "cw1")
    return given.groupBy("run", "node").applyInPandas(one, NODE_COLUMNS)


def fit_trees(train: DataFrame, runs: DataFrame, feats, y: str = "y") -> DataFrame:
    """Grow one tree per run. ``train`` has (run, feats..., y[, cnt]); ``runs`` has the parameters.

    Per level: nodes that are small enough by now are grown to their leaves by a task each. For
    the others one job builds the level (statistics + split search, checkpointed), one
    small job reads the number of splits and the largest child, one job moves the
    rows to the children (checkpointed). The number of ordered buckets follows the
    largest node's exact row count. Returns the node table: NODE_COLUMNS.
    """
    compact, params = compact_rows(train, tree_params(runs), feats, y)
    rows, params = cut_lineage(compact.withColumn("node", F.lit(ROOT))), cut_lineage(params)
    levels = []
    depth = 0
    xf = F.element_at(F.array(*[F.col(c).cast("double") for c in feats]), F.col("feature_index") + 1)
    while True:
        sizes = cut_lineage(rows.groupBy("run", "node").agg(F.count(F.lit(1)).alias("rows"), F.sum("cnt").alias("n")))
        small, largest = sizes.agg(F.count_if(F.col("rows") <= LOCAL_ROWS), F.max(F.when(F.col("rows") > LOCAL_ROWS, F.col("n")))).first()
        if small:
            fit = sizes.where(F.col("rows") <= LOCAL_ROWS).select("run", "node")
            fit = F.broadcast(fit)  # so that the rows of a large node stay where they are
            levels.append(cut_lineage(_grown(rows if largest is None else rows.join(fit, ["run", "node"], "left_semi"), params, feats)))
            rows = rows.join(fit, ["run", "node"], "left_anti")
        if largest is None:
            break
        level = cut_lineage(_level(rows, params, feats, depth, n_buckets=-(-largest // ROWS_PER_BUCKET)))
        levels.append(level)
        splits = level.where(~F.col("is_leaf")).select("run", "node", "feature_index", "threshold")
        depth += 1
        if splits.isEmpty():
            break
        rows = cut_lineage(
            rows.join(F.broadcast(splits), ["run", "node"]).select("run", *feats, "y", "cnt", _child(xf > F.col("threshold")).alias("node"))
        )
    if not levels:  # no rows
        return train.sparkSession.createDataFrame([], NODE_COLUMNS)
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def shared_trees(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trees, cuts): the least number of trees, in the column ``run``, that the runs (run, part, parameters) are cuts of;
    and each run's tree and limits."""
    named = tree_params(runs).join(runs.select("run", "part"), "run").withColumn(
        "tree", F.concat_ws("|", "part", "criterion", F.col("min_samples_leaf").cast("string"), F.col("balanced").cast("string"))
    )
    trees = named.groupBy(F.col("tree").alias("run")).agg(
        F.first("part").alias("part"), F.first("criterion").alias("criterion"), F.max("max_depth").alias("max_depth"),
        F.min("min_samples_split").alias("min_samples_split"), F.first("min_samples_leaf").alias("min_samples_leaf"), F.first("balanced").alias("balanced"),
    )
    return trees, named.select("run", "tree", F.col("max_depth").alias("most"), F.col("min_samples_split").alias("least"))


def cut_trees(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """The node table of each run of `cuts` (run, tree, most, least), from the nodes of the shared trees."""
    shared = nodes.withColumnRenamed("run", "tree")
    above = shared.select(F.col("tree").alias("t__"), F.col("node").alias("p__"), F.col("n").alias("n_above"))
    parent = F.expr("substring(node, 1, length(node) - 1)")
    linked = shared.join(above, (F.col("tree") == F.col("t__")) & (F.col("depth") > 0) & (parent == F.col("p__")), "left")
    kept = linked.join(cuts, "tree").where((F.col("depth") == 0) | ((F.col("depth") <= F.col("most")) & (F.col("n_above") >= F.col("least"))))
    leaf = F.col("is_leaf") | (F.col("depth") >= F.col("most")) | (F.col("n") < F.col("least"))
    inner = ("feature_index", "feature", "threshold", "decrease", "n_left", "n_right")
    return kept.withColumn("is_leaf", leaf).select(
        *[F.when(~F.col("is_leaf"), F.col(c)).alias(c) if c in inner else F.col(c) for c in nodes.columns]
    )


def leaf_values(nodes: DataFrame, run_nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """(run, tree, leaf, p1): what each run says for each leaf of its shared tree, by the leaf's longest way up to a leaf of the run."""
    leaves = nodes.where("is_leaf").select(F.col("run").alias("tree"), F.col("node").alias("leaf"))
    ways = leaves.select("*", F.explode(F.expr("transform(sequence(0, length(leaf)), i -> substring(leaf, 1, i))")).alias("node"))
    ends = run_nodes.where("is_leaf").select("run", "node", "p1").join(cuts.select("run", "tree"), "run")
    return ways.join(ends, ["tree", "node"]).select("run", "tree", "leaf", "p1")


COMPILE_NODE_LIMIT = 2000  # node rows up to which fitted trees are applied as one CASE expression, the same routing without joins
COMPILE_RUN_LIMIT = 64
COMPILE_DEPTH_LIMIT = 40


def _child(right: Column) -> Column:
    return F.concat("node", F.when(right, F.lit("1")).otherwise(F.lit("0")))


def _tree_expr(tree: dict, node: str, feats):
    is_leaf, fi, thr, p1 = tree[node]
    if is_leaf:
        return F.struct(F.lit(node).alias("leaf"), F.lit(float(p1)).alias("p1"))
    x = F.col(feats[fi]).cast("double")
    return F.when(x > F.lit(float(thr)), _tree_expr(tree, node + "1", feats)).otherwise(_tree_expr(tree, node + "0", feats))


def apply_trees(rows: DataFrame, nodes: DataFrame, feats, keep=(), compile_limit: int = COMPILE_NODE_LIMIT) -> DataFrame:
    """Route (run, feats..., keep...) rows to their leaves; adds ``p1`` and ``leaf``.

    Size-checked: a small node table (model parameters, <= ``compile_limit`` rows and
    <= 64 runs) becomes one nested CASE per run, a narrow projection with no join.
    Larger forests are routed level by level, one join per level with the routed rows
    checkpointed, so level d runs one join (not d).
    """
    n_nodes, max_depth = nodes.agg(F.count(F.lit(1)), F.max("depth")).first()
    if 0 < n_nodes <= compile_limit and max_depth <= COMPILE_DEPTH_LIMIT:
        trees: dict = {}
        for r in nodes.select("run", "node", "is_leaf", "feature_index", "threshold", "p1").collect():
            trees.setdefault(r["run"], {})[r["node"]] = (r["is_leaf"], r["feature_index"], r["threshold"], r["p1"])
        if len(trees) <= COMPILE_RUN_LIMIT:
            expr = None
            for run, tree in sorted(trees.items()):
                e = _tree_expr(tree, ROOT, feats)
                expr = F.when(F.col("run") == F.lit(run), e) if expr is None else expr.when(F.col("run") == F.lit(run), e)
            out = rows.join(nodes.select("run").distinct(), "run", "left_semi").select("*", expr.alias("_leaf"))
            return out.select(*rows.columns, F.col("_leaf.leaf").alias("leaf"), F.col("_leaf.p1").alias("p1"))
    nd = nodes.select("run", "node", "is_leaf", "feature_index", "threshold", "p1")
    cur = rows.withColumn("node", F.lit(ROOT))
    xf = F.element_at(F.array(*[F.col(c).cast("double") for c in feats]), F.col("feature_index") + 1)
    parts = []
    for _ in range((max_depth or 0) + 1):
        j = cut_lineage(cur.join(nd, ["run", "node"]))
        parts.append(j.where("is_leaf").select(*rows.columns, F.col("node").alias("leaf"), "p1"))
        cur = j.where(~F.col("is_leaf")).select(
            *rows.columns, _child(xf > F.col("threshold")).alias("node")
        )
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def importances(nodes: DataFrame, feats) -> DataFrame:
    """Normalised total impurity decrease per (run, feature); features never used get 0."""
    used = nodes.where(~F.col("is_leaf")).groupBy("run", "feature").agg(F.sum("decrease").alias("d"))
    allf = nodes.select("run").distinct().select("run", F.explode(F.array(*[F.lit(c) for c in feats])).alias("feature"))
    j = allf.join(used, ["run", "feature"], "left").fillna(0.0, ["d"])
    tot = j.groupBy("run").agg(F.sum("d").alias("t"))
    return j.join(tot, "run").select(
        "run", "feature", F.when(F.col("t") > 0, F.col("d") / F.col("t")).otherwise(F.lit(0.0)).alias("importance")
    )
