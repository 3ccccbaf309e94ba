"""Lookup of the interval a value lies in, as an equi-join on order-preserving buckets.

The intervals of a group are disjoint. Cut points are approximate quantiles of their lower ends,
about as many as the square root of the number of intervals; they decide sizes, never results.
A value's bucket is the number of cuts up to it, found in two steps of the square root of their
number. An interval stands in every bucket it reaches into, so (group, bucket) is an equi-join
key and a row meets only the intervals of its bucket: no nested loop, no scan of a group's array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cut points of a group at most (a row of the table of cuts holds them).
MOST_CUTS = 4096


def _cuts(points: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """(keys, cuts__, coarse__): sorted distinct cut points of each group, and every step-th of them."""
    probs = [i / (n + 1) for i in range(1, n + 1)]
    found = points.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, probs, 10_000))).alias("cuts__"))
    coarse = f"transform(sequence(0, int(greatest(size(cuts__) - 1, 0) div {_step(n)})), i -> cuts__[i * {_step(n)}])"
    return found.withColumn("coarse__", F.expr(coarse))


def _step(n: int) -> int:
    return max(1, math.isqrt(n))


def _bucket(value: Column, n: int, strict: bool = False) -> Column:
    """The number of cuts up to the value (below it, if strict), from cuts__ and coarse__."""
    up_to = (lambda c: c < value) if strict else (lambda c: c <= value)
    step = _step(n)
    start = F.greatest(F.size(F.filter("coarse__", up_to)) - 1, F.lit(0)) * step
    return start + F.size(F.filter(F.slice("cuts__", start + 1, F.lit(step)), up_to))


def _number(rows: int) -> int:
    return min(MOST_CUTS, max(1, math.isqrt(rows)))


def with_next(points: DataFrame, keys, order: str, cols, rows: int) -> DataFrame:
    """points (unique by keys and order) with next_<c>, for `order` and `cols`, of the next point of the group; null for the last.

    `rows`: about how many points there are. No window holds more than the points of one bucket."""
    keys, n = list(keys), _number(rows)
    named = points.join(_cuts(points, keys, order, n), keys).withColumn("bucket__", _bucket(F.col(order), n)).drop("cuts__", "coarse__")
    point = F.struct(order, *cols)
    inner = Window.partitionBy(*keys, "bucket__").orderBy(order)
    heads = named.groupBy(*keys, "bucket__").agg(F.min(point).alias("head"))
    follows = heads.select(*keys, "bucket__", F.lead("head").over(Window.partitionBy(*keys).orderBy("bucket__")).alias("follow__"))  # at most MOST_CUTS + 1 rows a group
    out = named.withColumn("next__", F.lead(point).over(inner)).join(follows, [*keys, "bucket__"])
    out = out.withColumn("next__", F.coalesce("next__", "follow__"))
    return out.select(*points.columns, *[F.col(f"next__.{c}").alias(f"next_{c}") for c in (order, *cols)])


def lookup(rows: DataFrame, intervals: DataFrame, keys, value: Column, count: int) -> DataFrame:
    """rows with the columns of the interval (keys, lo, hi, ...) of their group with lo <= value < hi; null ends are open.

    Rows without one, and those with a null value, have nulls. `count`: about how many intervals there are.
    """
    keys, n = list(keys), _number(count)
    cuts = _cuts(intervals.where("lo is not null"), keys, "lo", n)
    from_ = F.when(F.col("lo").isNull(), F.lit(0)).otherwise(_bucket(F.col("lo"), n))
    upto = F.when(F.col("hi").isNull(), F.size("cuts__")).otherwise(_bucket(F.col("hi"), n, strict=True))
    several = intervals.join(cuts, keys, "left").withColumn("bucket__", F.explode(F.when(F.col("cuts__").isNull(), F.array(F.lit(0))).otherwise(F.sequence(from_, upto))))
    several = several.drop("cuts__", "coarse__").withColumnsRenamed({k: f"{k}__i" for k in keys} | {"bucket__": "bucket__i"})
    placed = rows.withColumn("value__", value).join(cuts, keys, "left")
    placed = placed.withColumn("bucket__", F.when(F.col("cuts__").isNull(), F.lit(0)).otherwise(_bucket(F.col("value__"), n))).drop("cuts__", "coarse__")
    inside = (F.col("lo").isNull() | (F.col("lo") <= F.col("value__"))) & (F.col("hi").isNull() | (F.col("value__") < F.col("hi"))) & F.col("value__").isNotNull()
    for k in keys:
        inside = inside & (F.col(k) == F.col(f"{k}__i"))
    out = placed.join(several, inside & (F.col("bucket__") == F.col("bucket__i")), "left")
    return out.drop("value__", "bucket__", "bucket__i", *[f"{k}__i" for k in keys])
