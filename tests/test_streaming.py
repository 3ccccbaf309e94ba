"""The feature plan runs unchanged on a stream and equals the batch result."""

import datetime
import random
import tempfile

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import features as feat
from parley.sources import tables as src
from parley.streaming import features as SF

from .conftest import SF001


def test_stream_features_equal_batch(spark):
    raw = src.decorated_threads(spark, SF001)
    folder = tempfile.mkdtemp(prefix="parley-stream-in-")
    raw.select("dialogue", "type", "label", "orig_index").repartition(3).write.mode("overwrite").parquet(folder)
    stream = SF.read_dialogue_stream(spark, folder, max_files_per_trigger=1)
    q = SF.write_stream(SF.stream_features(stream), None, "parley_stream_features", fmt="memory")
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM parley_stream_features")
    want = feat.thread_features(raw)
    cols = ["thread_id", "turn_count", "aggregate_num_urls", "aggregate_money_terms", "ratio_request_messages"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert got.count() == raw.count()


def test_stream_risk_bands(spark):
    bands = spark.createDataFrame(
        [("Low", 0.0, 0.26), ("Medium", 0.26, 0.54), ("High", 0.54, 1.01)],
        "risk_band string, probability_min double, probability_max_exclusive double",
    )
    folder = tempfile.mkdtemp(prefix="parley-stream-scores-")
    spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.9), (4, 0.54)], "id int, p double").write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema("id int, p double").parquet(folder)
    q = SF.write_stream(SF.stream_risk(stream, bands), None, "parley_stream_risk", fmt="memory")
    q.processAllAvailable()
    q.stop()
    got = {r.id: r.risk_band for r in spark.sql("SELECT * FROM parley_stream_risk").collect()}
    assert got == {1: "Low", 2: "Medium", 3: "High", 4: "High"}


def test_stream_goes_on_after_a_restart(spark):
    source, sink, state = (tempfile.mkdtemp(prefix="parley-restart-") for _ in range(3))
    raw = src.decorated_threads(spark, SF001).select("dialogue", "type", "label", "orig_index")
    for part in ("orig_index < 10", "orig_index >= 10"):
        raw.where(part).write.mode("append").parquet(source)
        stream = SF.stream_features(SF.read_dialogue_stream(spark, source))
        SF.write_stream(stream, sink, "parley_restart", trigger_once=True, checkpoint=state).awaitTermination()
    got = [r.orig_index for r in spark.read.parquet(sink).select("orig_index").collect()]
    assert sorted(got) == list(range(20))


FEATURES = ["thread_id", "turn_count", "aggregate_num_urls", "aggregate_money_terms", "ratio_request_messages"]


def _timed_turns(spark):
    """Turns of the fixture, a minute apart, threads half an hour apart at their start."""
    turns = feat.parse_turns(src.decorated_threads(spark, SF001))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.xxhash64("thread_id") % 20 * 1800 + F.col("turn_index") * 60)
    return turns.withColumn("sent_at", at).select(*[f.name for f in T.StructType.fromDDL(SF.TURN_SCHEMA).fields])


def test_turns_out_of_order_and_repeated_equal_batch_after_a_restart(spark):
    source, sink, state = (tempfile.mkdtemp(prefix="parley-turns-") for _ in range(3))
    rows = _timed_turns(spark).collect()
    rng = random.Random(7)
    late = sorted(rows, key=lambda r: r.sent_at.timestamp() + rng.uniform(0, 1500))  # at most 25 minutes out of order
    n = len(late) // 4
    batches = [late[:n], late[n : 2 * n], late[2 * n : 3 * n], late[3 * n :]]
    batches[1] = batches[1] + batches[0][-5:]  # sent again
    end = rows[0].asDict() | {"thread_id": "end", "message_id": "end", "sent_at": datetime.datetime(2030, 1, 1)}
    for part in [*batches, [Row(**end)]]:  # a stop and a restart between any two
        spark.createDataFrame(part, SF.TURN_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        made = SF.turn_features(SF.read_turn_stream(spark, source), delay="3 hours")
        SF.write_stream(made, sink, "parley_turns", trigger_once=True, checkpoint=state).awaitTermination()
    got = spark.read.parquet(sink).where("thread_id != 'end'").select(*FEATURES)
    want = feat.thread_features_from_turns(spark.createDataFrame(rows, SF.TURN_SCHEMA)).select(*FEATURES)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    static = SF.turn_features(spark.createDataFrame(rows + rows[:9], SF.TURN_SCHEMA)).select(*FEATURES)
    assert sorted(map(tuple, static.collect())) == sorted(map(tuple, want.collect()))


def test_turns_beyond_the_delay_are_dropped(spark):
    source, sink, state = (tempfile.mkdtemp(prefix="parley-late-") for _ in range(3))
    turn = lambda thread, minute: (thread, f"{thread}{minute}", 0, "caller", "hi", 0, None, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute))
    for part in ([turn("a", 0), turn("a", 10)], [turn("b", 600)], [turn("a", 5)], [turn("c", 2000)]):
        spark.createDataFrame(part, SF.TURN_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        made = SF.turn_features(SF.read_turn_stream(spark, source))
        SF.write_stream(made, sink, "parley_late", trigger_once=True, checkpoint=state).awaitTermination()
    assert {r.thread_id: r.turn_count for r in spark.read.parquet(sink).collect()} == {"a": 2, "b": 1}
