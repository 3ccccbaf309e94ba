"""Sinks: turn, feature and metric tables as CSV or Parquet folders; profile and selected parameters as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder of part files, written by the tasks that hold the rows (CSV with header and doubled quotes)."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).save(path)


def write_document(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON document."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_profile(profile: DataFrame, path: str) -> None:
    """The profile row of ``profile_json.dataset_profile``."""
    write_document(profile.select("profile.*"), path)


def write_selected_params(selected: DataFrame, path: str) -> None:
    """``selected_models.<model>.{best_params, best_f1}`` from (model, best_params JSON, best_f1): a row per model."""
    params = F.from_json("best_params", "map<string,string>")
    entry = F.struct("model", F.struct(params.alias("best_params"), "best_f1").alias("m"))
    write_document(selected.agg(F.map_from_entries(F.collect_list(entry)).alias("selected_models")), path)
