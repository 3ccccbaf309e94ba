"""Tree explanations from the node relation: rule lines in depth-first order, root-to-leaf
paths, and rule models given as text in the same export format, applied as CASE expressions.

A node is its path (0 = left, 1 = right); sorting by that string is depth-first order, with
no recursion and no driver traversal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fmt import fixed

INDENT, BRANCH = "|   ", "|--- "


def rule_lines(nodes: DataFrame, digits: int = 4) -> DataFrame:
    """(run, sort_key, line): one condition line per edge and one ``class:`` line per leaf."""
    parent = nodes.where(~F.col("is_leaf")).select(
        "run", F.col("node").alias("parent"), "feature", "threshold", F.col("depth").alias("pdepth")
    )
    child = nodes.select("run", "node", "depth", "is_leaf", "p1").withColumn(
        "parent", F.when(F.col("depth") > 0, F.expr("left(node, length(node) - 1)"))
    )
    edges = child.join(parent, ["run", "parent"]).select(
        "run",
        F.col("node").alias("sort_key"),
        F.concat(
            F.repeat(F.lit(INDENT), F.col("pdepth")),
            F.lit(BRANCH),
            F.col("feature"),
            F.when(F.col("node").endswith("0"), F.lit(" <= ")).otherwise(F.lit(" >  ")),
            fixed(F.col("threshold"), digits),
        ).alias("line"),
    )
    leaves = child.where("is_leaf").select(
        "run",
        F.concat("node", F.lit("x")).alias("sort_key"),
        F.concat(
            F.repeat(F.lit(INDENT), F.col("depth")), F.lit(BRANCH), F.lit("class: "), (F.col("p1") > 0.5).cast("int").cast("string")
        ).alias("line"),
    )
    return edges.unionByName(leaves)


def rules_text(lines: DataFrame) -> DataFrame:
    """One text per run (a model: bounded by the tree size)."""
    return lines.groupBy("run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "line"))), lambda s: s["line"]), "\n").alias("rules")
    )


def leaf_paths(nodes: DataFrame, digits: int = 4) -> DataFrame:
    """(run, leaf, depth, class, conditions ARRAY<STRING>) root to leaf; ancestors are the leaf's prefixes."""
    cond = rule_lines(nodes, digits).where(~F.col("sort_key").endswith("x"))
    cond = cond.select("run", "sort_key", F.regexp_replace("line", r"^(\|   )*\|--- ", "").alias("cond"))
    leaves = nodes.where("is_leaf").select("run", F.col("node").alias("leaf"), "depth", (F.col("p1") > 0.5).cast("int").alias("class"))
    steps = leaves.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.col("depth"), F.lit(1)))).alias("k")).where(F.col("k") <= F.col("depth"))
    anc = steps.select(
        "run", "leaf", "depth", "class", "k",
        F.expr("left(leaf, k)").alias("sort_key"),
    )
    j = anc.join(cond, ["run", "sort_key"])
    paths = j.groupBy("run", "leaf", "depth", "class").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "cond"))), lambda s: s["cond"]).alias("conditions")
    )
    root_leaf = leaves.where("depth = 0").select("run", "leaf", "depth", "class", F.array().cast("array<string>").alias("conditions"))
    return paths.unionByName(root_leaf)


def parse_rules(text: str):
    """Export-format rules -> nested tuples: ('split', feature, threshold, left, right) | ('leaf', class)."""
    lines = [ln for ln in text.splitlines() if ln.strip()]
    pos = 0

    def depth_of(ln):
        return ln.index(BRANCH) // len(INDENT)

    def node(d):
        nonlocal pos
        ln = lines[pos]
        body = ln[ln.index(BRANCH) + len(BRANCH):]
        if body.startswith("class: "):
            pos += 1
            return ("leaf", int(body.split(": ")[1]))
        feat, _, thr = body.partition(" <= ")
        pos += 1
        left = node(d + 1)
        assert depth_of(lines[pos]) == d and " >  " in lines[pos]
        pos += 1
        right = node(d + 1)
        return ("split", feat, float(thr), left, right)

    return node(0)


def rules_column(tree) -> Column:
    if tree[0] == "leaf":
        return F.lit(tree[1])
    _, feat, thr, left, right = tree
    return F.when(F.col(feat) <= F.lit(thr), rules_column(left)).otherwise(rules_column(right))


def rules_sql(tree) -> str:
    if tree[0] == "leaf":
        return str(tree[1])
    _, feat, thr, left, right = tree
    return f"CASE WHEN {feat} <= {thr!r} THEN {rules_sql(left)} ELSE {rules_sql(right)} END"
