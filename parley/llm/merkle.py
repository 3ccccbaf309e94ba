"""Operator 11: a Merkle manifest of a table by lag and lead windows.

Every row is a leaf. Within a group (a source) leaves stand in order, and runs of three
consecutive nodes become their parent until one node is left, the group's subroot. Subroots in
the order of their groups become the root in the same way. Each row gets its leaf, subroot and
root, and its proof: for each level the digests left and right of its own in its run.

How: rows are range-partitioned by (group, id), which with row counts of the partitions gives
each leaf its place in its group; no task holds a whole group. Places are cut into blocks of
3^DEPTH, which no run crosses, so DEPTH levels are windows over one partitioning and one sort by
(group, block, place). At level k the row at a multiple of 3^k holds a node; its neighbours are
the rows at the fixed offsets 3^k and 2 * 3^k, taken with lag and lead and masked by the slot in
the run and the number of nodes of the level. The row at a multiple of 3^(k+1), the first child,
hashes the parent. Nodes left after DEPTH levels, one for each block, go through the same step
again until each group has one; their proofs come down again with one join by (group, block) for
each such step, so that no join meets a hot group.

Rows: nulls in any column are hashed as `-`. Rows with equal ids stand in the order of their
leaves; equal rows are separate leaves. A null group is a group and comes first; a null id
comes first in its group. A table without rows gives none. Input columns with the name of an
output are replaced; all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored, without

#: Nodes in a run.
ARITY = 3
#: Levels built over one partitioning; a block has ARITY ** DEPTH leaves.
DEPTH = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<l:string,r:string>"
OUTPUTS = ("leaf", "subroot", "root", "proof", "place")


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The digest of a row's values."""
    return digest(*[encoded(v) for v in values])


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda own, s: F.sha2(F.concat(s["l"], own, s["r"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's digests, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["l"], s["r"]))).cast("binary"), 256)


def _placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """(stored rows, rows with place__ (from 0, in their group__ by `order`) and size__ (rows of the group), the largest group's size)."""
    keys = [F.col(k).asc_nulls_first() for k in ("group__", *order, "tie__")]
    ranged = rows.withColumn("tie__", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie__")
    base = stored(ranged.withColumn("at__", F.monotonically_increasing_id()).withColumn("part__", F.shiftright("at__", 33)))
    by_group = Window.partitionBy("g__")
    before = by_group.orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)
    parts = base.groupBy(F.col("group__").alias("g__"), F.col("part__").alias("p__")).agg(F.count("*").alias("n"), F.min("at__").alias("low"))
    parts = parts.select(  # one row for each group and partition that holds some of it
        "g__", "p__", F.sum("n").over(by_group).alias("size__"),
        (F.col("low") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("from__"),
    )
    same = (F.col("part__") == F.col("p__")) & F.col("group__").eqNullSafe(F.col("g__"))
    placed = base.join(parts, same).withColumn("place__", F.col("at__") - F.col("from__")).drop("at__", "part__", "g__", "p__", "from__")
    return base, placed, parts.agg(F.max("size__")).first()[0] or 0


def _levels(nodes: DataFrame) -> DataFrame:
    """nodes (group__, place__, size__, node__, ...) with block__, proof__ (steps up to the top of the block) and, on the first row of each block, top__."""
    w = Window.partitionBy("group__", "block__").orderBy("place__")
    out = nodes.withColumn("block__", F.expr(f"place__ div {ARITY**DEPTH}")).withColumnRenamed("node__", "d0")
    steps = [s for s in range(1 - ARITY, ARITY) if s]
    for k in range(DEPTH):
        span, own = ARITY**k, f"d{k}"
        out = out.withColumns({f"near{s}": F.lag(own, -s * span).over(w) if s < 0 else F.lead(own, s * span).over(w) for s in steps})
        node, last = F.expr(f"place__ div {span}"), F.expr(f"(size__ - 1) div {span}")
        slot, many = node % ARITY, F.col("size__") > span  # more than one node at this level
        inside = {s: (slot + s >= 0) & (slot + s < ARITY) & (node + s <= last) for s in steps}
        left = F.concat(*[F.when(inside[s], F.col(f"near{s}")).otherwise("") for s in steps if s < 0])
        right = F.concat(*[F.when(inside[s], F.col(f"near{s}")).otherwise("") for s in steps if s > 0])
        step = F.when(many & (F.col("place__") % span == 0), F.struct(left.alias("l"), right.alias("r")).cast(STEP))
        parent = F.when(many, digest(F.col(own), right)).otherwise(F.col(own))
        first = F.col("place__") % (ARITY * span) == 0
        out = out.withColumn(f"s{k}", step).withColumn(f"d{k + 1}", F.when(first, parent)).drop(own, *[f"near{s}" for s in steps])
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = [F.when(F.col("size__") > ARITY**k, F.last(f"s{k}", ignorenulls=True).over(upto)) for k in range(DEPTH)]
    proof = F.filter(F.array(*found), lambda s: s.isNotNull())
    return out.withColumn("proof__", proof).withColumnRenamed(f"d{DEPTH}", "top__").drop(*[f"s{k}" for k in range(DEPTH)])


def _tree(nodes: DataFrame, largest: int, finish) -> DataFrame:
    """nodes with proof__ up to the root of all, and what else `finish` gives.

    `finish` gets the groups' tops (group__, node__) and returns them with more__, the proof from
    there on, and further columns, which come down to all rows.
    """
    tiers, now = [], nodes
    while not tiers or largest > 1:
        tiers.append(stored(_levels(now)))
        now = tiers[-1].where("top__ is not null").select(
            "group__", F.col("block__").alias("place__"), F.expr(f"(size__ - 1) div {ARITY**DEPTH} + 1").alias("size__"), F.col("top__").alias("node__")
        )
        largest = -(-largest // ARITY**DEPTH)
    above = finish(now.select("group__", "node__")).withColumnRenamed("group__", "g__").withColumn("b__", F.lit(0).cast("bigint"))
    for tier in reversed(tiers):
        same = (F.col("block__") == F.col("b__")) & F.col("group__").eqNullSafe(F.col("g__"))
        out = tier.drop("top__").join(above, same).withColumn("proof__", F.concat("proof__", "more__")).drop("g__", "b__", "more__", "block__", "size__")
        above = out.withColumnsRenamed({"group__": "g__", "place__": "b__", "proof__": "more__"})
    return out


def _subroots(tops: DataFrame) -> DataFrame:
    """The groups' tops with the root over all, and the proof of each subroot."""
    nodes = tops.select(F.lit(0).alias("group__"), F.col("group__").alias("source__"), "node__", F.col("node__").alias("subroot__"))
    base, placed, largest = _placed(nodes, ["source__"])
    done = _tree(placed, largest, lambda top: top.select("group__", F.array().cast(f"array<{STEP}>").alias("more__"), F.col("node__").alias("root__")))
    discard(base)
    return done.select(F.col("source__").alias("group__"), F.col("proof__").alias("more__"), "subroot__", "root__")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", extra: dict[str, Column] | None = None) -> DataFrame:
    """docs without the fields other than id and group, with `leaf`, `subroot`, `root`, `proof` and `place` (in the group, from 0).

    `extra` holds further columns by name, made in the scan that reads the fields.
    """
    made = {"leaf": leaf(*[F.col(f"`{f}`") for f in fields]), **(extra or {})}
    others = without(docs, {*OUTPUTS, *made, *fields, id_col, group_col}).columns
    leaves = stored(docs.select(  # ids and digests: the texts are read once
        F.col(f"`{id_col}`").alias("id__"), F.col(f"`{group_col}`").alias("group__"), *[F.col(f"`{c}`").alias(f"c{i}__") for i, c in enumerate(others)],
        made["leaf"].alias("node__"), *[c.alias(f"own{i}__") for i, c in enumerate(made.values())],
    ))
    base, placed, largest = _placed(leaves, ["id__", "node__"])
    done = _tree(placed, largest, _subroots)
    discard(leaves)
    discard(base)
    return done.select(
        F.col("id__").alias(id_col), F.col("group__").alias(group_col), *[F.col(f"c{i}__").alias(c) for i, c in enumerate(others)],
        *[F.col(f"own{i}__").alias(c) for i, c in enumerate(made)], *[F.col(f"{c}__").alias(c) for c in OUTPUTS[1:]],
    )


def tampered_leaf(fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row whose text has lost its \\n characters where 2 divides the id's crc32; else the row's own."""
    even = F.crc32(F.col(f"`{id_col}`").cast("string")) % 2 == 0
    text = F.col(f"`{text_col}`")
    cut = F.when(F.coalesce(even, F.lit(False)), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    return leaf(*[cut if f == text_col else F.col(f"`{f}`") for f in fields])


def audit(docs: DataFrame) -> DataFrame:
    """Each document's leaf, subroot, root and digest of its proof, and the root that its tampered leaf leads to.

    A null text stays null and a null id isn't tampered with.
    """
    made = manifest(docs, extra={"tampered": tampered_leaf()})
    made = made.withColumn("folded_root", folded(F.col("tampered"), F.col("proof")))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

