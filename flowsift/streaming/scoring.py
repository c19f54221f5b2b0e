"""Scores a stream of contract rows into results (as rows and as keyed messages), alerts and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scalar import event_time
from flowsift.operators.alerts import to_alerts
from flowsift.plans.score import Models, score
from flowsift.schema import RESULT_COLUMNS
from flowsift.sources import wire
from flowsift.streaming.ingest import with_hour
from flowsift.streaming.metrics import batch_point
from flowsift.streaming.store import read_batch, write_batch


def score_batches(models: Models, root: str, clock: Callable[[], float],
                  depth: Callable[[], int] = lambda: -1) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: every row is scored once, the four tables derive from that.

    clock gives epoch seconds; latency is the time from the start of the batch to its score. depth gives
    the rows still to read, for which `progress_depth` of the running query's last progress serves.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        started = clock()
        sized = batch.withColumn("bytes", F.octet_length(F.to_json(F.struct(*batch.columns))))
        scored = score(sized, models)
        write_batch(scored, f"{root}/scored", batch_id)
        finished = clock()

        done = read_batch(spark, f"{root}/scored", batch_id).select(
            "*",
            F.round(F.lit((finished - started) * 1000.0), 2).alias("latency_ms"),
            F.lit(finished).alias("consumer_ts"),
        )
        write_batch(done.select(*RESULT_COLUMNS), f"{root}/results", batch_id)
        write_batch(wire.encode_results(done), f"{root}/messages", batch_id)
        alerts = to_alerts(done, event_time(F.lit(finished)))
        hourly = with_hour(alerts.withColumn("ts", F.unix_micros("timestamp") / 1e6)).drop("ts")
        # rebalanced: few files per hour, and an hour with most rows still splits over tasks
        write_batch(hourly.hint("rebalance", "hour"), f"{root}/alerts", batch_id, ["hour"])
        write_batch(batch_point(done, started, finished, depth()), f"{root}/metrics", batch_id)

    return write
