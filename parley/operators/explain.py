"""Readable model explanations: coefficient table (tree importances and rules live in tree / tree_text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values (explanation texts) ----
DIRECTION_UP = "Increases predicted scam probability"
DIRECTION_DOWN = "Decreases predicted scam probability"
DIRECTION_NONE = "No effect in the fitted model"
COEF_NOTE = "Coefficient is based on standardized feature values."


def coefficient_table(models: DataFrame, feats) -> DataFrame:
    """(run, feature, coefficient, absolute_coefficient, direction, note), largest |coefficient| first."""
    long = models.select(
        "run", F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in feats]).alias("feature"), F.col("coefficients").alias("coefficient"))).alias("z")
    ).select("run", F.col("z.feature").alias("feature"), F.col("z.coefficient").alias("coefficient"))
    c = F.col("coefficient")
    return long.select(
        "run",
        "feature",
        "coefficient",
        F.abs(c).alias("absolute_coefficient"),
        F.when(c > 0, DIRECTION_UP).when(c < 0, DIRECTION_DOWN).otherwise(DIRECTION_NONE).alias("direction"),
        F.lit(COEF_NOTE).alias("note"),
    ).orderBy("run", F.col("absolute_coefficient").desc())
