"""Streaming thread features and risk scoring.

One input row is one whole dialogue, so every operator is stateless per row: the same
Column expressions as the batch path run on a ``readStream`` DataFrame, with no
watermark or state store. Band tables and model parameters are static DataFrames
joined to the stream (stream-static join), but for one group of bands, which is a CASE.

Turns can also arrive one at a time (`turn_features`). Then the state store holds, for each open
thread, the four running sums, and for each turn of the watermark's span its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import features as feat
from ..operators import thresholds as T
from ..session import ensure_checkpoint_dir
from pyspark.sql import types as T_

from ..sources.tables import RAW_SCHEMA

STREAM_SCHEMA = T_.StructType(RAW_SCHEMA.fields + [T_.StructField("orig_index", T_.LongType(), True)])


def read_dialogue_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Dialogue files (dialogue, type, label, orig_index) arriving in a folder."""
    r = spark.readStream.schema(STREAM_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def stream_features(stream: DataFrame) -> DataFrame:
    """The four thread features on a stream (same plan as batch: narrow, no state)."""
    return feat.thread_features(stream)


TURN_SCHEMA = (
    "thread_id string, message_id string, turn_index int, speaker_role string, message_text string, thread_label int, type string, sent_at timestamp"
)


def read_turn_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Redacted turns (as `parse_turns` gives them, and the time each was sent) arriving in a folder, in any order."""
    r = spark.readStream.schema(TURN_SCHEMA).format(fmt)
    return (r.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else r).load(path)


def turn_features(turns: DataFrame, delay: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """The four thread features of turns that arrive one at a time: keyed state, one row for each thread once it is complete.

    A turn may come up to ``delay`` later than turns sent after it; one that comes later still is
    dropped. A turn that arrives again (same ``message_id``) within the delay counts once. A
    thread is complete when the watermark is ``gap`` past its last turn; turns of one thread
    that are further apart than ``gap`` are two threads in time, with a row each. Only sums are
    kept for a thread, so its length doesn't matter. On a static table it gives the same rows.
    """
    once = turns.withWatermark("sent_at", delay)
    once = once.dropDuplicatesWithinWatermark(["message_id"]) if turns.isStreaming else once.dropDuplicates(["message_id"])
    sums = once.groupBy(F.session_window("sent_at", gap).alias("span"), "thread_id", "thread_label", "type").agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.sum(X.url_count("message_text")).alias("aggregate_num_urls"),
        F.sum(X.money_terms("message_text")).alias("aggregate_money_terms"),
        F.sum(X.is_request("message_text").cast("bigint")).alias("requests"),
    )
    return sums.select(
        "thread_id", "thread_label", "type", "turn_count", "aggregate_num_urls", "aggregate_money_terms",
        X.safe_ratio("requests", "turn_count").alias("ratio_request_messages"), F.col("span.start").alias("first_sent_at"), (F.col("span.end") - F.expr(f"INTERVAL {gap}")).alias("last_sent_at"),
    )


def stream_risk(stream: DataFrame, bands: DataFrame, score_col: str = "p") -> DataFrame:
    """Risk band per scored stream row from a static band table (3 rows, broadcast)."""
    return T.assign_band(stream, bands, score_col)


def write_stream(df: DataFrame, path: str, query_name: str, fmt: str = "parquet", trigger_once: bool = False, checkpoint: str | None = None):
    """Append sink. ``checkpoint`` is the stream's own folder on shared storage: started again with the
    same one, the stream goes on where it stopped. File sinks need it; others take a new folder without it."""
    if checkpoint is None:
        if fmt not in ("memory", "console"):
            raise ValueError("a file sink needs a checkpoint folder that outlives the application")
        checkpoint = ensure_checkpoint_dir(df.sparkSession).rstrip("/") + f"/stream-{query_name}"
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).queryName(query_name)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start(path) if fmt not in ("memory", "console") else w.start()
