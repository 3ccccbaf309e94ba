"""Table scans. Every reader returns a lazy DataFrame; pruning and pushdown are Catalyst's."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import csv_records

FEATURE_TYPES = {
    "thread_label": "int", "turn_count": "bigint", "aggregate_num_urls": "bigint", "aggregate_money_terms": "bigint", "ratio_request_messages": "double",
}
FEATURE_READ = {"thread_id": "string", "orig_index": "bigint"} | FEATURE_TYPES

RAW_SCHEMA = T.StructType(
    [
        T.StructField("dialogue", T.StringType(), True),
        T.StructField("type", T.StringType(), True),
        T.StructField("label", T.IntegerType(), True),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def require_columns(df: DataFrame, required) -> None:
    """Plan-time guard (no job): raise on missing columns, like the reference's ValueError."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"Missing required columns: {sorted(missing)}")


def optional_column(df: DataFrame, name: str, dtype: str = "string"):
    """``row.get(name, None)``: the column if present, else a typed NULL."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def read_raw_dialogues(spark: SparkSession, path: str, id_column: str | None = None) -> DataFrame:
    """CSV of raw dialogues (header, quoted newlines, doubled quotes).

    ``orig_index`` must be a stable row key. With a source id column it is that id;
    otherwise it is the row's position in all files, in order of their names. A file is
    cut into records by many tasks (`csv_records`), quoted newlines or not.
    """
    df = csv_records.read_csv(spark, path)
    require_columns(df, {"dialogue", "label"})
    return df.select(
        F.col("dialogue").cast("string").alias("dialogue"),
        optional_column(df, "type").alias("type"),
        F.col("label").cast("int").alias("label"),
        F.col(id_column if id_column else "position__").cast("bigint").alias("orig_index"),
    )


def read_features(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A feature table as ``sinks.write_table`` leaves it, or fail: the path must exist and hold the required columns."""
    reader = spark.read.option("header", True).option("escape", '"') if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    require_columns(df, FEATURE_TYPES)
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in FEATURE_READ.items()])


# ---- fixed values (decorated-thread fixture, FIXTURES.md section 3) ----
ROLE_MARKERS = {"user": "caller: ", "assistant": "receiver: ", "system": ""}
SUFFIXES = [
    " Please confirm your bank account.",
    " Transfer $1,250.00 today.",
    " Go to https://pay.example.com/x and click.",
    " My number is 555-123-4567.",
    " Mail me at a.b@example.com?",
    " SSN 123-45-6789.",
    " The fee is 20 dollars, see www.refund.example.org now.",
    " Order $500000 payment voucher.",
    " See you soon.",
    "",
]


def decorated_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decorated piece per conversation turn: marker + text + deterministic suffix."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marker = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_MARKERS.items() for x in kv]), F.col("role")), F.lit("")
    )
    k = (F.col("conv_id") * 7 + F.col("turn") * 3) % 10
    odd = (F.col("conv_id") % 2) == 1
    three = (F.col("conv_id") % 10) == 3
    idx = F.when((odd != three) | (((F.col("conv_id") + F.col("turn")) % 5) == 0), k).otherwise(F.lit(8))
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (idx + 1).cast("int"))
    return conv.select("conv_id", "turn", F.concat(marker, F.col("text"), suffix).alias("piece"))


def decorated_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-dialogue table (dialogue, type, label, orig_index) built from ``conversations``.

    A dialogue is one record by definition, so the ordered assembly groups one
    conversation's pieces into one row: the row *is* the group. The hash aggregate
    keeps only (turn, piece) structs per key and sorts them once.
    """
    pieces = decorated_pieces(spark, sf_dir)
    return pieces.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), " "
        ).alias("dialogue")
    ).select(
        "dialogue",
        F.lit(None).cast("string").alias("type"),
        (F.col("conv_id") % 2).cast("int").alias("label"),
        F.col("conv_id").alias("orig_index"),
    )


def input_presence(spark: SparkSession, paths) -> DataFrame:
    """(path, exists, size_bytes) of each named input; of a folder, its files' sizes together; a missing one has no size.

    The ``content`` column is pruned, so only metadata is read. The named inputs are a short list.
    """
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            found = files.agg(F.sum("length").alias("size_bytes")).select(F.lit(path).alias("path"), F.lit(True).alias("exists"), "size_bytes")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = spark.createDataFrame([(path, False, None)], "path string, exists boolean, size_bytes bigint")
        out = found if out is None else out.unionByName(found)
    return out
