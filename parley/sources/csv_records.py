"""CSV with quoted newlines, read by many tasks per file.

Spark's own multi-line CSV reader gives a file to one task, as a line end may lie inside quotes.
Here the text reader cuts a file into byte ranges at line ends, and quotes tell which line ends
end a record: those after an even number of quote characters since the start of the file (a
doubled quote inside a field counts twice).

1. A first scan gives, for each range, whether its number of quotes is odd, and how many records
   end in it if it starts outside quotes and if it starts inside. One row for each range.
2. Running sums over a file's ranges give the state at the start of each range and the number of
   records before it.
3. A second scan cuts each range into records, numbered within their file. A record that runs
   over a border leaves a piece in each range; pieces, at most two for each range, are put
   together by the record's number. All other records stay in their task, without a shuffle.

The state at the start of the ranges is broadcast while it has no more than BROADCAST rows (one
for each range, that is each 128 MB by default); beyond it, lines are shuffled to their range.
Ranges are those of the session's file settings. Both scans must see the same: a range that the
first one did not see raises an error. As RFC 4180 has it, a field with a quote in it is quoted.
Line ends are `\\n` or `\\r\\n`, which becomes `\\n` inside quotes too, as in Spark's reader; empty
lines between records are no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Ranges whose state is broadcast at most.
BROADCAST = 200_000


def lines(spark: SparkSession, path) -> DataFrame:
    """(file, start, line) in the order of the files' lines within each range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


class Summary:
    """Of a range's lines: an odd number of quotes or not, and the records that end here if it starts outside quotes, or inside."""

    def __init__(self):
        self.odd, self.ends, self.empty = False, [0, 0], [True, False]

    def feed(self, line: str) -> None:
        self.odd ^= line.count('"') % 2 == 1
        for inside in (0, 1):
            over = self.odd == bool(inside)
            self.ends[inside] += over and not (self.empty[inside] and line in ("", "\r"))
            self.empty[inside] = over


class Cutter:
    """Cuts a range's lines into (number among the records that end here, whole or a piece, text)."""

    def __init__(self, inside: bool):
        self.odd, self.whole, self.n, self.held = inside, not inside, 0, []

    def feed(self, line: str) -> tuple[int, bool, str] | None:
        self.odd ^= line.count('"') % 2 == 1
        if not self.held and self.whole and not self.odd and line in ("", "\r"):
            return None
        self.held.append(line)
        return None if self.odd else self._record(self.n + 1, True)

    def _record(self, n: int, whole: bool) -> tuple[int, bool, str]:
        out = (self.n, self.whole, "\n".join(self.held))
        self.n, self.whole, self.held = n, whole, []
        return out

    def rest(self) -> tuple[int, bool, str] | None:
        """The piece of a record that goes on in the next range."""
        if not self.held:
            return None
        self.whole = False
        return self._record(self.n, False)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None

    def row():
        return pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "odd": state.odd, "ends0": state.ends[0], "ends1": state.ends[1]}])

    for batch in batches:
        for file, start, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (file, start) != key:
                if key is not None:
                    yield row()
                key, state = (file, start), Summary()
            state.feed(line)
    if key is not None:
        yield row()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, out = None, None, []

    def add(found):
        if found is not None:
            n, whole, text = found
            out.append((key[0], key[1], key[3] + n, key[4], whole, text))

    def made():
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["file", "start", "position", "shift", "whole", "record"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if row[:2] != (key and key[:2]):
                if key is not None:
                    add(state.rest())
                key = row
                state = Cutter(row[2])
            add(state.feed(row[5]))
        if out:
            yield made()
    if key is not None:
        add(state.rest())
    if out:
        yield made()


def records(spark: SparkSession, path) -> DataFrame:
    """(file, position, shift, record): the files' records, header lines too, numbered from 0 in their file; shift: records other than headers of the files before."""
    seen = cut_lineage(lines(spark, path).mapInArrow(_summaries, "file string, start bigint, odd boolean, ends0 bigint, ends1 bigint"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    inside = F.coalesce(F.sum(F.col("odd").cast("int")).over(before) % 2 == 1, F.lit(False))
    state = seen.withColumn("inside", inside).withColumn("ends", F.when(F.col("inside"), F.col("ends1")).otherwise(F.col("ends0")))
    over = state.groupBy("file").agg(F.sum("ends").alias("n"), (F.sum(F.col("odd").cast("int")) % 2).alias("open"))  # open: a quote that nothing ends
    earlier = Window.partitionBy(F.lit(1)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    shift = F.coalesce(F.sum(F.greatest(F.col("n") + F.col("open") - 1, F.lit(0))).over(earlier), F.lit(0))
    state = state.withColumn("done", F.coalesce(F.sum("ends").over(before), F.lit(0))).join(over.select("file", shift.alias("shift")), "file")
    state = cut_lineage(state.select(F.col("file").alias("f"), F.col("start").alias("s"), "inside", "done", "shift"))
    few = state.count() <= BROADCAST
    now = lines(spark, path) if few else lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    joined = now.join(F.broadcast(state) if few else state, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")), "left")
    if not few:
        joined = joined.repartition("file", "start").sortWithinPartitions("file", "start", "at")
    known = F.when(F.col("f").isNull(), F.raise_error(F.lit("the files' ranges changed between two scans")).cast("boolean")).otherwise(F.col("inside"))
    made = joined.select("file", "start", known.alias("inside"), "done", "shift", "line")
    cut = made.mapInArrow(_pieces, "file string, start bigint, position bigint, shift bigint, whole boolean, record string")
    parts = cut.where(~F.col("whole")).groupBy("file", "position", "shift").agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("p"))
    together = parts.select("file", "position", "shift", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    out = cut.where("whole").select("file", "position", "shift", "record").unionByName(together)
    return out.withColumn("record", F.regexp_replace(F.replace("record", F.lit("\r\n"), F.lit("\n")), "\r\\z", ""))


def read_csv(spark: SparkSession, path) -> DataFrame:
    """The files' columns as strings, named by their header lines, and `position__`: the row's place in all files, in order of their names.

    Fields are taken by their place, in the order of the header that Spark's reader finds first.
    """
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.csv(path, header=True, **{k: v for k, v in options.items() if k != "multiLine"}, multiLine=True).columns
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    rows = records(spark, path).where("position > 0").select(F.from_csv("record", schema, options).alias("r"), (F.col("shift") + F.col("position") - 1).alias("position__"))
    return rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], "position__")
