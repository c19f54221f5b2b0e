"""Rolling flow features over an unbounded stream, equal to the batch result.

One stateful operator keeps the windows. Its keys are buckets of sources, a fixed number of them, and rows reach it
as packed Arrow tables, so a bucket costs a few calls to the state per batch and its windows are array operations. A
flow waits in its bucket's state until the watermark has passed it, so flows of a source leave in (ts, uid) order
whatever order they came in; an event-time timer wakes the bucket. The state of a bucket is what waits, the flows
of one window before, and the sums of all gaps of each source so far. With `forget_seconds` the sums of a
source start anew after so long a silence, and the state is freed then.

Distinct sources of a destination are a running sum: a source and destination come into the window with a flow that no
flow of theirs precedes within one window, and leave it one window after a flow that none follows. The operator tells
both, each when the watermark has passed it; the writer adds them up along time, on from what the batch before has
left open. So a busy destination is no key in one task but cut into slices of time, as in batch.

Flows behind the watermark and flows without a time leave at once as late ones. A row without a uid is no
flow but a heartbeat: its time moves the watermark on, which is how a finished log is flushed.

Rows of a bucket's sources of one batch are in one task, so the reader's limits per batch bound what a busy source holds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsift.functions.scalar import event_time, ticks
from flowsift.operators.rolling import SWEEP
from flowsift.operators.running import per_temperature, plan_slices, running
from flowsift.schema import WINDOW_SECONDS
from flowsift.streaming.ingest import start_batches
from flowsift.streaming.packed import pack_buckets, unpack_rows
from flowsift.streaming.store import batch_numbers, read_batch, write_batch
from flowsift.streaming.windows import DESTINATION, SOURCE, KeyedWindows

SOURCE_FEATURES = {
    "fan_out": "double", "unique_dst_ips": "bigint", "unique_dst_ports": "bigint", "iat_mean": "double",
    "iat_std": "double", "iat_min": "double", "iat_max": "double", "connection_frequency": "double",
    "src_ip_entropy": "double", "periodicity_score": "double",
}
PARTITIONS = "spark.sql.shuffle.partitions"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# all stores of an executor share one bound of native memory, whatever their number; packed tables come few at a time
BOUNDED = {"spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
           "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
           "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
# fixed for the life of a checkpoint; every partition keeps a store open, so there are no more than that
BUCKETS, STATE_PARTITIONS = 512, 32
# steps of one destination in a task
SWEEP_ROWS = 250_000


def keyed_features(flows: DataFrame, window_seconds: float = WINDOW_SECONDS, lateness_seconds: float = 120.0,
                   forget_seconds: float | None = None) -> DataFrame:
    """Flows with the features of their source, steps of the destinations that sources leave, and late flows, marked."""
    columns = [*flows.columns, "_t"]
    timed = flows.withColumn("_event_time", event_time("ts")).withWatermark(
        "_event_time", f"{round(lateness_seconds * 1000)} milliseconds").withColumn("_t", ticks("ts"))
    bucket = F.pmod(F.xxhash64("src_ip"), F.lit(BUCKETS)).cast("int").alias("_bucket")
    # the event time itself stays behind: the operator sees late flows too
    placed = F.when(F.col("uid").isNotNull(), F.array(F.struct(bucket, *columns)))
    rows = timed.select(F.explode(placed).alias("_flow")).select("_flow.*")
    out = T.StructType([
        *(rows.schema[c] for c in columns),
        *(T.StructField(n, T.LongType() if kind == "bigint" else T.DoubleType()) for n, kind in SOURCE_FEATURES.items()),
        T.StructField("_step", T.LongType()), T.StructField("side", T.StringType()), T.StructField("late", T.BooleanType())])
    buckets, schema = rows.mapInArrow(pack_buckets, "bucket int, rows binary").groupBy("bucket"), to_arrow_schema(out)
    if any(pa.types.is_nested(t) for t in schema.types):
        # pandas doesn't keep these as they are
        return buckets.transformWithStateInPandas(
            KeyedWindows(window_seconds, forget_seconds), "rows binary", "Append", "eventTime").mapInArrow(unpack_rows(schema), out)
    return buckets.transformWithStateInPandas(
        KeyedWindows(window_seconds, forget_seconds, schema), out, "Append", "eventTime")


def split_features(root: str, target_rows: int | None = SWEEP_ROWS, partitions: str | None = None):
    """foreachBatch writer under `root`: features (flows of both sides as one row), late, and open, the sources in each
    destination's window behind a batch, from which the next one goes on."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{root}/halves", batch_id)
        conf = batch.sparkSession.conf
        of_state = conf.get(PARTITIONS)
        conf.set(PARTITIONS, partitions or of_state)
        try:
            add_up(batch.sparkSession, batch_id)
        finally:
            conf.set(PARTITIONS, of_state)

    def add_up(spark, batch_id: int) -> None:
        halves = read_batch(spark, f"{root}/halves", batch_id)
        steps = halves.filter("not late").withColumn("_leaves", (F.col("side") == DESTINATION).cast("int"))
        before = [n for n in batch_numbers(spark, f"{root}/open") if n < batch_id]
        if before:
            opened = read_batch(spark, f"{root}/open", before[-1]).select(
                "dst_ip", "_step", F.lit(-1 << 62).alias("_t"), F.lit(1).alias("_leaves"), F.lit(DESTINATION).alias("side"))
            steps = steps.unionByName(opened, allowMissingColumns=True)

        def swept(rows: DataFrame, slicing) -> DataFrame:
            return running(rows, ["dst_ip"], SWEEP, {"_sources": ("sum", F.col("_step"))}, slicing)

        done = per_temperature(steps, plan_slices(steps, ["dst_ip"], "_t", target_rows), swept)
        features = done.filter(F.col("side") == SOURCE).withColumn("fan_in", F.col("_sources").cast("double"))
        write_batch(features.drop("_t", "_step", "_leaves", "_sources", "side", "late"), f"{root}/features", batch_id)
        left = steps.groupBy("dst_ip").agg(F.sum("_step").alias("_step")).filter("_step > 0")
        write_batch(left, f"{root}/open", batch_id)
        late = halves.filter("late").drop("_t", "_step", "side", "late", *SOURCE_FEATURES)
        write_batch(late, f"{root}/late", batch_id)

    return write


def start_features(flows: DataFrame, root: str, window_seconds: float = WINDOW_SECONDS, lateness_seconds: float = 120.0,
                   forget_seconds: float | None = None, once: bool = False, interval: str = "2 seconds"):
    """Starts the query; its state lives beside its tables under `root`, a folder that all machines share."""
    rows = keyed_features(flows, window_seconds, lateness_seconds, forget_seconds)
    partitions = rows.sparkSession.conf.get(PARTITIONS)
    settings = BOUNDED | {PARTITIONS: str(min(int(partitions), STATE_PARTITIONS))}
    return with_keyed_state(rows, split_features(root, partitions=partitions), f"{root}/state", once, interval, settings)


def with_keyed_state(rows: DataFrame, write, checkpoint: str, once: bool, interval: str, settings: dict | None = None):
    """Starts a foreachBatch query whose keyed state needs a store of its own kind."""
    conf = rows.sparkSession.conf
    wanted = {STORE: ROCKS} | (settings or {})
    before = {key: conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)  # read when the query starts
    try:
        return start_batches(rows, write, checkpoint, once, interval)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)
