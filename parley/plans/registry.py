"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus the matching oracle SQL.

Every query reads the given tables (or data Spark derives from them) whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as feat
from ..sources import tables as src

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw dialogue table (decorated fixture from ``conversations``)."""
    return src.decorated_threads(spark, sf_dir)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.thread_features(threads(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.parse_turns(threads(spark, sf_dir))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir)
