"""Batch-numbered tables for foreachBatch writers.

A micro-batch writes to <table>/batch=N with overwrite, so running it again after a lost
executor or a restarted driver leaves the same files: at-least-once input, exactly-once
tables. State of batch N is read by batch N+1 only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BATCH = "batch"


def state_root(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """A folder all executors share: the session's checkpoint dir, else the caller's."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not shared:
        raise ValueError("set spark.checkpoint.dir or pass a shared folder for stream state")
    return f"{shared.rstrip('/')}/{name}"


def write_batch(df: DataFrame, table: str, batch_id: int, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{table}/{BATCH}={batch_id}")


def read_batch(spark: SparkSession, table: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{table}/{BATCH}={batch_id}")


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.option("basePath", table).parquet(table)


def batch_numbers(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the batches present, from the folder listing."""
    return sorted(int(name.split("=", 1)[1]) for name in children(spark, table) if name.startswith(f"{BATCH}="))


def drop_batches_before(spark: SparkSession, table: str, batch_id: int) -> None:
    for number in batch_numbers(spark, table):
        if number < batch_id:
            _delete(spark, f"{table}/{BATCH}={number}")


def drop_partitions_before(spark: SparkSession, table: str, column: str, cutoff: str) -> list[str]:
    """Retention: drops partitions whose value sorts before the cutoff; returns their names."""
    expired = [n for n in children(spark, table) if n.startswith(f"{column}=") and n.split("=", 1)[1] < cutoff]
    for name in expired:
        _delete(spark, f"{table}/{name}")
    return expired


def drop_numbers_below(spark: SparkSession, table: str, column: str, least: int) -> list[str]:
    """Retention by number: drops partitions whose value is a number below `least`; returns their names."""
    numbered = [(n, n.split("=", 1)[1]) for n in children(spark, table) if n.startswith(f"{column}=")]
    expired = [name for name, value in numbered if value.lstrip("-").isdigit() and int(value) < least]
    for name in expired:
        _delete(spark, f"{table}/{name}")
    return expired


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> list[str]:
    files, place = _filesystem(spark, path)
    if not files.exists(place):
        return []
    return [status.getPath().getName() for status in files.listStatus(place)]


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _filesystem(spark, path)
    files.delete(place, True)
