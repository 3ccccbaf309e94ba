"""A profile kept up to date file by file: stored partial states, merged.

For each input file one state: rows, and for each profiled column its nulls, count, mean, sum of
squared differences from the mean, least and largest value, and for each label column the
number of rows by label. States merge exactly (the moments by the parallel formula), so a new
file is read alone, and files that were read before are not opened again. A file is known by its
path, size and time of change: a changed file is read anew, a removed one drops out.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("file", "changed", "length")
MOMENTS = "struct<nulls:bigint,n:bigint,mean:double,m2:double,low:double,high:double>"


def files(spark: SparkSession, path) -> DataFrame:
    """(file, changed, length) of the files that are there now; only their metadata is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    return found.select(F.col("path").alias("file"), F.col("modificationTime").alias("changed"), F.col("length"))


def states(rows: DataFrame, columns, labels) -> DataFrame:
    """One state for each file of a file-based table: partial aggregation, then one small row a file and label."""
    meta = {"file": "file_path", "changed": "file_modification_time", "length": "file_size"}
    value = lambda c: F.col(f"`{c}`").cast("double")
    base = rows.select(*[F.col(f"_metadata.{m}").alias(k) for k, m in meta.items()], *[value(c).alias(f"v{i}") for i, c in enumerate(columns)], *[F.col(f"`{c}`").cast("string").alias(f"l{i}") for i, c in enumerate(labels)])
    sums = []
    for i, _ in enumerate(columns):
        v = F.col(f"v{i}")
        sums.append(F.struct(F.count_if(v.isNull()).alias("nulls"), F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high")).cast(MOMENTS).alias(f"c{i}"))
    moments = base.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), *sums)
    out = moments.select(*KEY, "rows", F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"c{i}") for i, _ in enumerate(columns)])).alias("columns"))
    for i, c in enumerate(labels):  # few labels: a map a file
        counts = base.groupBy(*KEY, f"l{i}").agg(F.count(F.lit(1)).alias("k")).groupBy(*KEY)
        counts = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce(f"l{i}", F.lit("")), "k"))).alias(f"label_{c}"))
        out = out.join(counts, list(KEY))
    return out


def update(spark: SparkSession, path, store: str, columns, labels, fmt: str = "parquet", **options) -> DataFrame:
    """The states of all present files; states of new or changed ones are added to the table at `store` (parquet, append only)."""
    present = files(spark, path)
    try:
        known = spark.read.parquet(store)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        known = None
    fresh = present if known is None else present.join(known.select(*KEY), list(KEY), "left_anti")
    names = [r["file"] for r in fresh.select("file").collect()]  # names of new files only, as a scan's listing holds them too
    if names:
        rows = spark.read.format(fmt).options(**options).load(names)
        states(rows, list(columns), list(labels)).write.mode("append").parquet(store)
    return spark.read.parquet(store).join(present, list(KEY), "left_semi")


def merged(parts: DataFrame) -> DataFrame:
    """(column, rows, nulls, count, mean, std, min, max) over all states: what one pass over all rows gives."""
    each = parts.select("rows", F.explode("columns").alias("column", "s")).select("rows", "column", "s.*")
    total = each.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("n").alias("count"), (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"),
        F.min("low").alias("min"), F.max("high").alias("max"),
    )
    centre = each.join(total.select("column", F.col("mean").alias("centre")), "column")
    spread = centre.groupBy("column").agg(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("centre")) ** 2).alias("m2"))
    out = total.join(spread, "column")
    std = F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1)))
    return out.select("column", "rows", "nulls", "count", "mean", std.alias("std"), "min", "max")


def label_counts(parts: DataFrame, label: str) -> DataFrame:
    """(label, n) over all states; a null label counts as the empty string."""
    return parts.select(F.explode(f"label_{label}").alias("label", "k")).groupBy("label").agg(F.sum("k").alias("n"))
