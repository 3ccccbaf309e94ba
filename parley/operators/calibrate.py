"""Probability calibration per run: Platt (sigmoid) and isotonic, fit and apply.

Platt: 2-parameter logistic fit on the score with smoothed targets
(N+ + 1)/(N+ + 2) and 1/(N- + 2), solved by the grouped Newton of ``linear``.
Isotonic: weighted pool-adjacent-violators over the run's *distinct* scores (rows are
compacted to (run, score, sum y, weight) first), in ranges of the score that are pooled in
tasks of their own until no border between two of them is left to pool; predictions
interpolate linearly between block end points and clip outside, like the reference library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .intervals import lookup, with_next
from .linear import fit_logistic, sigmoid

UNREGULARISED_C = 1e12
#: Distinct scores (later: blocks) that one task pools, about.
RANGE_ROWS = 1_000_000


def fit_platt(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """df: (run, score, y). Returns (run, a, b) with p = sigmoid(a * score + b)."""
    counts = df.groupBy("run").agg(F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg"))
    t = F.when(F.col(y) == 1, (F.col("n_pos") + 1.0) / (F.col("n_pos") + 2.0)).otherwise(1.0 / (F.col("n_neg") + 2.0))
    rows = (
        df.join(F.broadcast(counts), "run")
        .select("run", F.col(score).cast("double").alias("z0"), t.alias("t"))
        .groupBy("run", "z0", "t")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
        .withColumnRenamed("t", "y")
        .cache()
    )
    params = counts.select("run", F.lit(UNREGULARISED_C).alias("C"), F.lit(False).alias("l1"))
    beta = fit_logistic(rows, params, 1)
    rows.unpersist()
    return beta.select("run", F.col("b0").alias("a"), F.col("b1").alias("b"))


def apply_platt(df: DataFrame, params: DataFrame, score: str = "score") -> DataFrame:
    j = df.join(F.broadcast(params), "run")
    return j.select(*df.columns, sigmoid(F.col("a") * F.col(score) + F.col("b")).alias("p_cal"))


class Pool:
    """Pool-adjacent-violators over blocks (lo, hi, sum of y * w, sum of w) that come in order of their scores.

    Blocks keep exact sums and their value is sum_y / sum_w (one division), so a fitted value does
    not depend on the pooling order.
    """

    def __init__(self):
        self.blocks: list[list[float]] = []

    def add(self, lo: float, hi: float, sy: float, w: float) -> None:
        self.blocks.append([lo, hi, sy, w])
        while len(self.blocks) > 1 and self.blocks[-2][2] / self.blocks[-2][3] >= self.blocks[-1][2] / self.blocks[-1][3]:
            _, hi, sy, w = self.blocks.pop()
            top = self.blocks[-1]
            top[1], top[2], top[3] = hi, top[2] + sy, top[3] + w


BLOCKS = "run string, lo double, hi double, sy double, w double, edge boolean"


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pooled blocks of one range of (run, score), sorted; `edge` marks each run's first and last in the range."""
    run, pool = None, Pool()

    def out():
        last = len(pool.blocks) - 1
        lo, hi, sy, w = zip(*pool.blocks)
        arrays = [pa.array([run] * (last + 1), pa.string()), *[pa.array(c, pa.float64()) for c in (lo, hi, sy, w)], pa.array([i in (0, last) for i in range(last + 1)])]
        return pa.RecordBatch.from_arrays(arrays, names=["run", "lo", "hi", "sy", "w", "edge"])

    for batch in batches:
        for r, *block in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if pool.blocks and r != run:
                yield out()
                pool.blocks = []
            run = r
            pool.add(*block)
    if pool.blocks:
        yield out()


def fit_isotonic(df: DataFrame, score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """df: (run, score, y[, weight]) -> (run, x, fitted) block end points, increasing.

    Each pass pools the blocks of every range in a task of its own, then compares the blocks at
    the ranges' borders. While two there violate the order, ranges are cut anew, by another
    number, so that the old borders lie inside, and pooled again. Rows without a score don't count.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    compact = df.where(F.col(score).isNotNull()).groupBy(F.col("run").cast("string").alias("run"), F.col(score).cast("double").alias("lo")).agg(
        F.sum(F.col(y).cast("double") * w).alias("sy"), F.sum(w).alias("w")
    )
    blocks = cut_lineage(compact.select("run", "lo", F.col("lo").alias("hi"), "sy", "w"))
    n, turn = -(-blocks.count() // RANGE_ROWS), 0
    while True:
        ranges = max(1, n + turn % 2) if n > 1 else 1
        ordered = blocks.repartitionByRange(ranges, "run", "lo").sortWithinPartitions("run", "lo")
        pooled = cut_lineage(ordered.mapInArrow(_pooled, BLOCKS))
        if ranges == 1:
            break
        value = F.col("sy") / F.col("w")
        before = F.lag(value).over(Window.partitionBy("run").orderBy("lo"))  # at most two rows for each range of a run
        if pooled.where("edge").select((before >= value).alias("bad")).where("bad").isEmpty():
            break
        blocks, turn = pooled.drop("edge"), turn + 1
        n = -(-blocks.count() // RANGE_ROWS)
    ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")
    return pooled.select("run", ends, (F.col("sy") / F.col("w")).alias("fitted"))


def apply_isotonic(df: DataFrame, fit: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``p_cal``: linear interpolation between the end points (run, x, fitted) of blocks, clipped to the end values.

    Neighbouring end points are intervals, looked up by an equi-join on buckets of the score. Rows
    of a run without a fit go; a null score has a null probability.
    """
    fit = cut_lineage(fit)
    count = fit.count()
    pairs = with_next(fit, ["run"], "x", ["fitted"], count)
    first = fit.groupBy("run").agg(F.min(F.struct("x", "fitted")).alias("p"))
    none = F.lit(None).cast("double")
    pieces = pairs.select("run", F.col("x").alias("lo"), F.col("next_x").alias("hi"), F.col("fitted").alias("y0"), F.col("next_fitted").alias("y1"), F.lit(True).alias("fit"))
    below = first.select("run", none.alias("lo"), F.col("p.x").alias("hi"), F.col("p.fitted").alias("y0"), none.alias("y1"), F.lit(True).alias("fit"))
    names = {c: f"{c}__p" for c in ("y0", "y1", "fit")}
    s = F.col(score).cast("double")
    out = lookup(df.join(first.select("run"), "run", "left_semi"), pieces.unionByName(below).withColumnsRenamed(names), ["run"], s, count)
    y0, y1, lo, hi = F.col("y0__p"), F.col("y1__p"), F.col("lo"), F.col("hi")
    interpolated = F.when(y1.isNull() | lo.isNull(), y0).otherwise(y0 + (s - lo) * (y1 - y0) / (hi - lo))
    return out.select(*df.columns, interpolated.alias("p_cal"))
