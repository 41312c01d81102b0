"""The registered queries: a name, a function of (spark, sf_dir), and equivalent SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The results log in SQL: part id, lane, time, order, value and configuration of each event.
LOG = """log AS (
  SELECT user_id AS id, event_type AS lane, ts AS created, event_id, value,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results log: the events as answers of lanes to parts; type error is a failed call."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("lane"), F.col("ts").alias("created"), "event_id", "value", k.alias("k"))
