"""Profiles: label distributions, describe(), null counts, row counts, dataset profile, split summary."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 10  # output rounding of float aggregates (order-independent results)
RANGES = 1024  # parts of a range that a pass of `order_statistics` counts


def rnd(c):
    return F.round(c, DIGITS)


def label_distribution(df: DataFrame, label: str, level: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(level).alias("level"), "label", "n"
    )


def as_count_map(dist: DataFrame, key: str = "label", value: str = "n") -> DataFrame:
    """One-row ``MAP<STRING,BIGINT>`` of a small distribution (keys are the classes: bounded)."""
    return dist.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))).alias("counts")
    )


def long_form(df: DataFrame, cols, name: str = "feature", value: str = "value") -> DataFrame:
    """Unpivot numeric columns to (feature, value) rows."""
    return df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])).alias("s")
    ).select("s.*")


def order_statistics(df: DataFrame, group: str, value: str, ranks: dict, ends: dict) -> dict:
    """{(group, rank): value}, exact: ranks (from 0) by group, and each group's (least, largest) value.

    A pass counts the values of each still open range in RANGES equal parts; only the part with a
    wanted rank is opened again, between the least and largest value seen in it, until it holds one
    value. A pass brings RANGES rows a range to the driver, whatever the number of rows and values.
    """
    found, spans = {}, {}
    for g, wanted in ranks.items():
        for k in wanted:
            spans.setdefault((g, *ends[g], 0), []).append(k)
    while spans:
        for (g, a, b, below), wanted in list(spans.items()):
            if a == b:
                found |= {(g, k): a for k in wanted}
                del spans[g, a, b, below]
        if not spans:
            break
        given, v = list(spans.items()), F.col(value)
        share = lambda a, b: (v / 2 - a / 2) / (b / 2 - a / 2) if b / 2 > a / 2 else (v - a) / (b - a)  # noqa: E731  (halves don't overflow)
        part = lambda a, b: F.least(F.floor(share(a, b) * RANGES), F.lit(RANGES - 1))
        hits = [F.when((F.col(group) == g) & v.between(a, b), F.struct(F.lit(i).alias("i"), part(a, b).alias("part"))) for i, ((g, a, b, _), _) in enumerate(given)]
        placed = df.select(v.alias("v"), F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
        counts = placed.groupBy("h.i", "h.part").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        spans = {}
        for i, ((g, _, _, below), wanted) in enumerate(given):
            for r in sorted((r for r in counts if r["i"] == i), key=lambda r: r["part"]):
                inside = [k for k in wanted if below <= k < below + r["n"]]
                if inside:
                    spans[g, r["a"], r["b"], below] = inside
                below += r["n"]
    return found


def exact_quantiles(df: DataFrame, group: str, value: str, qs) -> DataFrame:
    """Linear-interpolated quantiles (pandas/``quantile_cont``), exact, per group: (group, q, quantile).

    Groups are few (the columns of a long form). No distinct value is joined, sorted or shuffled.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    facts = {r[0]: r for r in rows.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b")).collect()}
    places = {(g, float(q)): q * (r["n"] - 1) for g, r in facts.items() for q in qs}
    ranks = {g: {min(math.floor(h) + d, r["n"] - 1) for (g2, _), h in places.items() if g2 == g for d in (0, 1)} for g, r in facts.items()}
    at = order_statistics(rows, group, value, ranks, {g: (r["a"], r["b"]) for g, r in facts.items()})
    out = []
    for (g, q), h in places.items():
        k = math.floor(h)
        x0, x1 = at[g, k], at[g, min(k + 1, facts[g]["n"] - 1)]
        out.append((g, q, x0 + (h - k) * (x1 - x0) if h > k else x0))
    return df.sparkSession.createDataFrame(out, f"{group} string, q double, quantile double")


def describe(df: DataFrame, cols) -> DataFrame:
    """pandas ``describe()`` in long form: count, mean, sample std, min, quartiles, max.

    The long form (rows x features, numeric only) is checkpointed once: the moments and
    the quantile passes then read it instead of re-running the plan that produced it."""
    from ..session import cut_lineage

    lf = cut_lineage(long_form(df, cols))
    basic = lf.groupBy("feature").agg(
        F.count("value").cast("double").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = exact_quantiles(lf, "feature", "value", [0.25, 0.5, 0.75])
    piv = q.groupBy("feature").agg(
        *[F.max(F.when(F.col("q") == v, F.col("quantile"))).alias(n) for v, n in [(0.25, "p25"), (0.5, "p50"), (0.75, "p75")]]
    )
    return basic.join(piv, "feature").select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, one pass, long form (column_name, n_null)."""
    a = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return a.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("n_null")) for c in df.columns])).alias("s")
    ).select("s.*")


def row_counts(raw: DataFrame, turns: DataFrame, feats: DataFrame) -> DataFrame:
    k = F.lit(1).alias("k")
    a = raw.agg(F.count(F.lit(1)).alias("raw_rows")).withColumn("k", F.lit(1))
    b = turns.agg(F.count(F.lit(1)).alias("parsed_turn_rows")).withColumn("k", F.lit(1))
    c = feats.agg(F.count(F.lit(1)).alias("thread_feature_rows")).withColumn("k", F.lit(1))
    del k
    return a.join(b, "k").join(c, "k").drop("k")
