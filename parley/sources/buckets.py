"""Tables stored in buckets of a key, so that joins and groupings by it need no shuffle.

Feature and split tables are joined by ``orig_index`` again and again. Written once in equal
numbers of buckets, their joins read bucket by bucket: the shuffle is paid when writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Aim for buckets of about this many rows.
BUCKET_ROWS = 1_000_000


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """A power of two, so that tables of different sizes divide each other's buckets."""
    return 1 << max(0, (max(1, -(-rows // bucket_rows)) - 1).bit_length())


def write_bucketed(df: DataFrame, name: str, folder: str, key: str = "orig_index", buckets: int | None = None) -> DataFrame:
    """df as the table `name`, stored in `folder`, bucketed and sorted by `key`; replaces a table of that name. Returns it as read.

    One shuffle by the key brings each bucket into one file. Rows whose key is null share one bucket."""
    n = buckets or bucket_count(df.count())
    placed = df.repartition(n, F.col(key))
    placed.write.bucketBy(n, key).sortBy(key).format("parquet").option("path", folder).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def colocated(spark: SparkSession, left: str, right: str) -> bool:
    """Whether two tables have buckets of the same columns, in numbers that divide each other."""

    def spec(name):
        rows = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
        return rows.get("Bucket Columns"), int(rows.get("Num Buckets") or 0)

    (a, n), (b, m) = spec(left), spec(right)
    return a is not None and a == b and max(n, m) % min(n, m) == 0
