"""Message streams: sources, decoding with dead letters, deduplication, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowsift.functions.scalar import event_time
from flowsift.sources import wire, zeek
from flowsift.streaming.store import write_batch

MESSAGE_SCHEMA = "key binary, value binary"
LATENESS = "2 minutes"
# fixed values: the producer's batch limits
TRIGGER = {"processingTime": "100 milliseconds"}
BATCH_ROWS = 500


def kafka_messages(spark: SparkSession, servers: str, topic: str, max_rows: int | None = None) -> DataFrame:
    """Needs the Kafka connector on the class path; offsets live in the query's checkpoint."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_rows:
        reader = reader.option("maxOffsetsPerTrigger", max_rows)
    return reader.load()


def file_messages(spark: SparkSession, directory: str, max_files: int = 100) -> DataFrame:
    """The same messages as Parquet files of (key, value)."""
    return (
        spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(directory)
    )


def publish(rows: DataFrame, checkpoint: str, fmt: str = "parquet", **options):
    """Starts the writer of feature rows as (key, value) messages."""
    writer = wire.encode(rows).writeStream.format(fmt).option("checkpointLocation", checkpoint)
    return writer.options(**options).trigger(**TRIGGER).start()


def tail_log(spark: SparkSession, directory: str, fields: list[str], progress: str, preserve_dash=(),
             glob: str | None = None, max_rows: int = BATCH_ROWS) -> DataFrame:
    """Rows of growing logs in batches of the producer's size, for `publish` and `start_batches`."""
    return zeek.stream_log(spark, directory, fields, preserve_dash, glob=glob, max_rows=max_rows, progress=progress)


def deduplicate(rows: DataFrame, key: str = "flow_id", lateness: str = LATENESS) -> DataFrame:
    """One row per flow within the lateness: re-sent files produce every row again."""
    timed = rows if "event_time" in rows.columns else rows.withColumn("event_time", event_time("ts"))
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([key])


def split_messages(good_table: str, dead_table: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: decoded rows and dead letters, one parse for both."""

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = wire.decode(batch).persist()
        write_batch(wire.good_rows(decoded), good_table, batch_id)
        write_batch(wire.dead_letters(decoded), dead_table, batch_id)
        decoded.unpersist()

    return write


def split_log(good_table: str, dead_table: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of `zeek.stream_log`: rows that fit their fields, and the file and line of all others.

    Lines that don't fit are counted while the others are written; a batch without any, but the first one, writes no
    table of them, and only a batch with some is read a second time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        unfit = Observation()
        seen = batch.observe(unfit, F.count_if("_malformed").alias("n"))
        write_batch(seen.filter(~F.col("_malformed")).drop("_file", "_offset", "_raw", "_malformed"), good_table, batch_id)
        if batch_id == 0 or unfit.get["n"]:
            write_batch(batch.filter("_malformed").select("_file", "_raw"), dead_table, batch_id)

    return write


def start_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                  once: bool = False, interval: str = "2 seconds"):
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def with_hour(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds the hour partition that retention drops by."""
    return rows.withColumn("hour", F.date_format(event_time(ts), "yyyy-MM-dd-HH"))
