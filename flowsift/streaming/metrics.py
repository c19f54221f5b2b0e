"""Throughput windows, queue depth and publisher counters, in batch or on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scalar import event_time
from flowsift.operators.ordering import latest

METRICS_SECONDS = 2
COUNTER_SECONDS = 10


def throughput(rows: DataFrame, seconds: int = METRICS_SECONDS, time: str = "event_time") -> DataFrame:
    """Per tumbling window: flows/s, bytes/s, mean and last latency, flows.

    rows: time, bytes, latency_ms, flow_id (breaks ties of the last latency).
    """
    order = F.struct(time, "flow_id")
    return rows.groupBy(F.window(time, f"{seconds} seconds").alias("_w")).agg(
        F.count(F.lit(1)).alias("window_flows"),
        F.sum("bytes").alias("_bytes"),
        F.avg("latency_ms").alias("_mean"),
        F.max_by("latency_ms", order).alias("_last"),
    ).select(
        F.col("_w.start").alias("ts"),
        F.round(F.col("window_flows") / F.lit(float(seconds)), 2).alias("flows_per_sec"),
        F.round(F.col("_bytes") / F.lit(float(seconds)), 2).alias("bytes_per_sec"),
        F.round("_last", 2).alias("pipeline_latency_ms"),
        F.round("_mean", 2).alias("latency_ms_mean"),
        "window_flows",
    )


def batch_point(rows: DataFrame, started: float, finished: float, depth: int = -1) -> DataFrame:
    """One row of the live feed per batch: the rates are over the seconds the batch took.

    rows: bytes, latency_ms, consumer_ts, flow_id; started and finished are epoch seconds. An empty
    batch gives zeros; a clock that stood still counts as a millisecond.
    """
    elapsed = F.lit(max(finished - started, 1e-3))
    return rows.agg(
        F.count(F.lit(1)).alias("window_flows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("_bytes"),
        F.avg("latency_ms").alias("_mean"),
        F.max_by("latency_ms", F.struct("consumer_ts", "flow_id")).alias("_last"),
    ).select(
        event_time(F.lit(finished)).alias("ts"),
        F.round(F.col("window_flows") / elapsed, 2).alias("flows_per_sec"),
        F.round(F.col("_bytes") / elapsed, 2).alias("bytes_per_sec"),
        F.round(F.coalesce("_last", F.lit(0.0)), 2).alias("pipeline_latency_ms"),
        F.round(F.coalesce("_mean", F.lit(0.0)), 2).alias("latency_ms_mean"),
        "window_flows",
        F.lit(depth).cast("bigint").alias("kafka_queue_depth"),
    )


def queue_depth(produced: DataFrame, committed: DataFrame, key: str = "partition", offset: str = "offset") -> DataFrame:
    """Newest minus committed offset per partition; -1 where nothing was committed."""
    newest = produced.groupBy(key).agg(F.max(offset).alias("_newest"))
    done = committed.groupBy(key).agg(F.max(offset).alias("_done"))
    depth = F.when(F.col("_done").isNotNull(), F.greatest(F.col("_newest") - F.col("_done"), F.lit(0)))
    return newest.join(done, key, "left").select(key, F.coalesce(depth, F.lit(-1)).cast("bigint").alias("queue_depth"))


def progress_depth(progress: dict) -> int:
    """Rows known to the source but not yet read, from one StreamingQueryProgress; -1 unknown."""
    total = 0
    for source in progress.get("sources", []):
        newest, read = source.get("latestOffset"), source.get("endOffset")
        if not isinstance(newest, dict) or not isinstance(read, dict):
            return -1
        for topic, partitions in newest.items():
            total += sum(int(o) - int(read.get(topic, {}).get(p, 0)) for p, o in partitions.items())
    return total


def outcome_counters(outcomes: DataFrame, seconds: int = COUNTER_SECONDS, time: str = "event_time") -> DataFrame:
    """Publisher report per window: published, dropped, errors, batches.

    outcomes: time, outcome in (published, dropped, error), batch_id.
    """
    def is_a(name: str):
        return F.count_if(F.col("outcome") == name)

    # batches are counted as distinct (window, batch) pairs before the sum, which a stream allows too
    per_batch = outcomes.groupBy(F.window(time, f"{seconds} seconds").alias("_w"), "batch_id").agg(
        is_a("published").alias("published"), is_a("dropped").alias("dropped"), is_a("error").alias("errors")
    )
    return per_batch.groupBy("_w").agg(
        F.sum("published").alias("published"), F.sum("dropped").alias("dropped"),
        F.sum("errors").alias("errors"), F.count(F.lit(1)).alias("batches"),
    ).select(F.col("_w.start").alias("ts"), "published", "dropped", "errors", "batches")


def latest_metrics(metrics: DataFrame, points: int = 30) -> DataFrame:
    """The last points of the live feed, oldest first."""
    return latest(metrics, "ts", points)
