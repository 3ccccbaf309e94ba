"""Running sums over an ordered column without a single-partition sort per group.

Input rows must be unique per (keys, order) -- compact with ``groupBy`` first.
Rows are cut into order-preserving buckets by approximate quantile boundaries of each
group; bucket totals (a table of #groups x n_buckets rows) give exact offsets; groups are models, runs
and folds, few and perhaps large, so both are broadcast and rows only meet in their bucket; the
running sum inside a bucket is a window partitioned by (keys, bucket). The result is
exact; only the bucket *sizes* are approximate, and ties always share a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_BUCKETS = 64


def bucketed(df: DataFrame, keys, order: str, n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """df with ``_bk``: 0..n_buckets-1, the place of the order value among its group's quantile bounds (0 for null)."""
    keys = list(keys)
    o = F.col(order)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.groupBy(*keys).agg(F.percentile_approx(order, probs, 1000).alias("_bounds")) if keys else df.agg(
        F.percentile_approx(order, probs, 1000).alias("_bounds")
    )
    bounds = bounds.where(F.col("_bounds").isNotNull())  # a group without any value has none, and no place in the result
    if keys:
        with_b = df.join(F.broadcast(bounds), keys)
    else:  # one-row boundary table joined on a constant key
        with_b = df.withColumn("_k", F.lit(1)).join(F.broadcast(bounds.withColumn("_k", F.lit(1))), "_k").drop("_k")
    # how many bounds lie below the value: binary search, a projection for each step; never null, or the
    # join on it would push a null check, and with it all steps multiplied out, below the projections
    with_b = with_b.withColumn("_bk", F.lit(0))
    for step in (1 << i for i in reversed(range(len(probs).bit_length()))):
        below = F.get("_bounds", F.col("_bk") + (step - 1)) < o  # null beyond the last bound
        with_b = with_b.withColumn("_bk", F.col("_bk") + F.when(below, F.lit(step)).otherwise(F.lit(0)))
    return with_b.drop("_bounds")


def running_sums(
    df: DataFrame, keys, order: str, cols, n_buckets: int = DEFAULT_BUCKETS, descending: bool = False, with_next: bool = False
) -> DataFrame:
    """Adds ``cum_<c>`` = sum of ``c`` over rows of the same keys with order value <= this one
    (>= when ``descending``), inclusive. ``with_next`` adds ``next_<order>``: the next larger
    value in the group (NULL for the last), ascending mode only."""
    keys = list(keys)
    o = F.col(order)
    with_b = bucketed(df, keys, order, n_buckets)
    if descending:
        with_b = with_b.withColumn("_bk", F.lit(n_buckets) - F.col("_bk"))
    totals = with_b.groupBy(*keys, "_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols], F.min(order).alias("_min"))
    wo = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.lead("_min").over(Window.partitionBy(*keys).orderBy("_bk")).alias("_nextmin")] if with_next else []
    offsets = totals.select(
        *keys, "_bk", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}") for c in cols], *extra
    )
    ordering = o.desc() if descending else o.asc()
    wl = Window.partitionBy(*keys, "_bk").orderBy(ordering).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = with_b.join(F.broadcast(offsets), [*keys, "_bk"])
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(wl))
    if with_next:
        wn = Window.partitionBy(*keys, "_bk").orderBy(ordering)
        out = out.withColumn(f"next_{order}", F.coalesce(F.lead(order).over(wn), F.col("_nextmin"))).drop("_nextmin")
    return out.drop("_bk", *[f"_o_{c}" for c in cols])


def global_rank(df: DataFrame, order, name: str) -> DataFrame:
    """df with its 1-based place in the total order (a list of sort columns): `row_number` over all rows, without one task for all.

    Rows are range-partitioned and sorted, and checkpointed with their place in their partition;
    the partitions' row counts, one row each, give the rest.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("_p", F.shiftright("_m", 33)))
    sizes = placed.groupBy(F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select("_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    at = F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(starts, F.col("_p") == F.col("_q")).select(*df.columns, at.alias(name))
