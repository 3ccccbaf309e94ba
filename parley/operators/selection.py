"""Arg-max / ranking selections over small result tables (first wins on ties)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_of(col: str, values) -> F.Column:
    """Position of ``col`` in a fixed list (tie order = listing order)."""
    expr = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        expr = F.when(F.col(col) == v, F.lit(i)).otherwise(expr)
    return expr


def best_per_metric(summary: DataFrame, metrics, model_order, model_col: str = "model") -> DataFrame:
    """(metric, model, score): the model with the highest ``<metric>_mean``; first listed wins ties."""
    long = summary.select(
        model_col,
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("score")) for m in metrics])).alias("s"),
    ).select("s.metric", model_col, "s.score")
    w = Window.partitionBy("metric").orderBy(F.col("score").desc(), order_of(model_col, model_order))
    return long.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("metric", model_col, "score")


def first_by(df: DataFrame, keys, order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
