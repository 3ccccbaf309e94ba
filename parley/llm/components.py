"""Connected components of an edge list by alternating large-star and small-star steps.

Each step replaces edges by edges to smaller neighbours, so the number of rows doesn't grow,
and no vertex's neighbourhood is gathered into one row: a step is a partially aggregated
minimum by vertex and a join that adaptive execution splits where a vertex is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u goes to the smallest of u and its neighbours."""
    both = _both(edges)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """u > v: every smaller neighbour of u, and u itself, goes to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for each vertex of the edges (u, v): root is the smallest vertex of its component.

    Vertices without an edge other than to themselves don't appear. An edge list without rows gives none.
    """
    now = cut_lineage(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        now = cut_lineage(_small(_large(now)))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    )
