"""Split and hyper-parameter documents.

The reference keeps a split as one JSON object with id arrays. Here the id lists are
a relation written as JSON lines (one id per line, partitioned by ``part``), and the
summary (sizes, label maps) is a separate one-row document, so nothing scales with
the number of ids on one machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import SEED
from ..operators.profile import as_count_map


def split_payload_summary(split: DataFrame, test_size: float = 0.2, label: str = "thread_label", seed: int = SEED) -> DataFrame:
    """One row: seed, test_size, label_column, total/train/test sizes and label maps per part."""
    counts = split.groupBy("part", label).agg(F.count(F.lit(1)).alias("n"))
    overall = as_count_map(counts.groupBy(label).agg(F.sum("n").alias("n")), label).withColumnRenamed(
        "counts", "overall_label_distribution"
    )
    train = as_count_map(counts.where("part = 'train'"), label).withColumnRenamed("counts", "train_label_distribution")
    test = as_count_map(counts.where("part = 'test'"), label).withColumnRenamed("counts", "test_label_distribution")
    sizes = counts.agg(
        F.sum("n").alias("total_rows"),
        F.sum(F.when(F.col("part") == "train", F.col("n")).otherwise(0)).alias("train_size"),
        F.sum(F.when(F.col("part") == "test", F.col("n")).otherwise(0)).alias("test_size_rows"),
    )
    k = F.lit(1)
    row = sizes.withColumn("k", k)
    for m in (overall, train, test):
        row = row.join(m.withColumn("k", k), "k")
    return row.drop("k").select(
        F.lit(seed).alias("seed"), F.lit(test_size).alias("test_size"), F.lit(label).alias("label_column"), "*"
    )


def write_split_json(split: DataFrame, path: str, id_col: str = "orig_index", label: str = "thread_label") -> None:
    split.select(id_col, label, "part").write.mode("overwrite").partitionBy("part").json(f"{path}/ids")
    split_payload_summary(split, label=label).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def read_split_json(spark: SparkSession, path: str, id_col: str = "orig_index", label: str = "thread_label") -> DataFrame:
    """Read the id relation back; ``part`` comes from the directory (partition pruning applies)."""
    df = spark.read.schema(f"{id_col} BIGINT, {label} INT, part STRING").json(f"{path}/ids")
    missing = {id_col, "part"} - set(df.columns)
    if missing:
        raise ValueError(f"Split payload is missing keys: {sorted(missing)}")
    return df.select(id_col, label, "part")


def read_legacy_split(spark: SparkSession, path: str) -> DataFrame:
    """Reader for a reference-style single JSON object with ``train_original_indices`` /
    ``test_original_indices`` arrays: exploded to the (id, part) relation on the executors."""
    doc = spark.read.option("multiLine", True).json(path)
    for k in ("train_original_indices", "test_original_indices"):
        if k not in doc.columns:
            raise ValueError(f"Split file is missing key: {k}")
    tr = doc.select(F.explode("train_original_indices").alias("orig_index"), F.lit("train").alias("part"))
    te = doc.select(F.explode("test_original_indices").alias("orig_index"), F.lit("test").alias("part"))
    return tr.unionByName(te).select(F.col("orig_index").cast("bigint"), "part")


# ---- fixed values (model defaults when no tuned parameters exist) ----
LR_DEFAULTS = {"C": "1.0", "class_weight": None, "l1_ratio": None}
TREE_DEFAULTS = {"criterion": "gini", "max_depth": None, "min_samples_leaf": "1", "min_samples_split": "2", "class_weight": None}


def hyperparams_with_defaults(params: DataFrame) -> DataFrame:
    """(model, param, value) with every known key present: a missing key gets its default, an explicit null stays.

    ``params`` is a long table (model, param, value STRING); an empty table gives all defaults.
    """
    spark = params.sparkSession
    rows = [("Logistic Regression", k, v) for k, v in LR_DEFAULTS.items()] + [
        ("Decision Tree", k, v) for k, v in TREE_DEFAULTS.items()
    ]
    defaults = spark.createDataFrame(rows, "model string, param string, default_value string")
    given = params.withColumn("_given", F.lit(True))
    value = F.when(F.col("_given"), F.col("value")).otherwise(F.col("default_value"))
    return defaults.join(given, ["model", "param"], "left").select("model", "param", value.alias("value"))


def read_selected_params(spark: SparkSession, path: str) -> DataFrame:
    """Selected-parameter JSON (``selected_models.<model>.best_params``) to the long (model, param, value) table."""
    doc = spark.read.option("multiLine", True).json(path)
    models = doc.select(F.explode(F.from_json(F.to_json("selected_models"), "map<string, struct<best_params: map<string,string>>>")).alias("model", "m"))
    return models.select("model", F.explode("m.best_params").alias("param", "value")).select(
        "model", F.regexp_replace("param", "^model__", "").alias("param"), "value"
    )
