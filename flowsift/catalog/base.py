"""Registry of named queries over the driver tables, and the views they share.

A query is registered together with the SQL that must give the same rows, where SQL can.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.streaming.store import state_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DAY = 86_400
# the events span thirty days; look-backs count from this moment
NOW = "2024-01-30 00:00:00"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own per run, under the shared checkpoint folder, else under the warehouse."""
    warehouse = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/runs"
    return state_root(spark, f"{name}-{uuid.uuid4().hex}", warehouse)


def micros(column: str) -> Column:
    """A zone-less timestamp as epoch microseconds, whatever the session zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def flows(spark: SparkSession, directory: str, events: DataFrame | None = None) -> DataFrame:
    """Events seen as flows: user to event type, port from the properties."""
    events = table(spark, directory, "events") if events is None else events
    return events.select(
        F.col("event_id").cast("string").alias("uid"),
        (micros("ts") / F.lit(1e6)).alias("ts"),
        F.col("user_id").cast("string").alias("src_ip"),
        F.col("event_type").alias("dst_ip"),
        prop_k().alias("dst_port"),
    )


# the same view for the SQL side; t is in microseconds
FLOWS_SQL = """flows AS (
  SELECT event_id::VARCHAR AS uid, epoch_us(ts) AS t, user_id::VARCHAR AS src, event_type AS dst,
         json_extract_string(props, '$.k')::INT AS port, value
  FROM events)"""


def rounded(column: str, digits: int = 6) -> Column:
    """Rounded for comparison across engines; no negative zero."""
    return (F.round(F.col(column).cast("double"), digits) + F.lit(0.0)).alias(column)
