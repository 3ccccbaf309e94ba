"""Shared helpers: per-batch text functions and reliable lineage cuts.

Columns: an operator adds its output columns to the rows it is given. An input column that
has the name of an output column is replaced by it; all others pass through unchanged.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, discard, release, stored

#: Rows that a batch function gets at once.
SLICE = 512
#: A function of one batch of texts (None for null), and of further columns if asked for, that returns one list of values for each output column.
BatchFn = Callable[[list], tuple]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application; they needn't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    fd, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two columns that most operators need, so that the scan reads no other."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def without(df: DataFrame, names) -> DataFrame:
    """df without the columns that an operator is about to add (names compare as Spark's do, by lower case)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def aside(df: DataFrame, used, outputs, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(df) with all columns but the used ones under names that no operator has, and under their own again in the result.

    Input columns with the name of an output go first.
    """
    others = [c for c in without(df, {*used, *outputs}).columns]
    hidden = {f"aside{i}__": c for i, c in enumerate(others)}
    out = run(df.select(*[F.col(f"`{c}`") for c in used], *[F.col(f"`{c}`").alias(h) for h, c in hidden.items()]))
    return out.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in out.columns])


def arrow_type(ddl: str) -> pa.DataType:
    return {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
    }[ddl]


def add_columns(df: DataFrame, text_col: str, outputs: dict[str, str], make: Callable[[], BatchFn], also: tuple[str, ...] = (), kind: str = "string") -> DataFrame:
    """df with `outputs` (name -> DDL type), made from `text_col` batch by batch in Arrow.

    `make` runs once per task and returns the batch function, so that a task builds its tables
    once. The function gets the lists of the columns `also` after the texts; these columns go.
    """
    kept = [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in (*outputs, *also)}]
    names = [f.name for f in kept]
    added = list(outputs.items())
    schema = T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in added])
    inner = "text__in"
    source = df.select(F.col(f"`{text_col}`").cast(kind).alias(inner), *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate((*also, *names))])
    kinds = [arrow_type(t) for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):  # few texts at a time as Python objects
                batch = whole.slice(at, SLICE)
                made = fn(*[batch.column(i).to_pylist() for i in range(1 + len(also))])
                passed = [batch.column(i + 1 + len(also)) for i in range(len(names))]
                arrays = passed + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names + [n for n, _ in added])

    return map_arrow(source, run, schema)


__all__ = ["add_columns", "aside", "cut_lineage", "discard", "documents", "map_arrow", "read_table", "release", "stored", "without"]
