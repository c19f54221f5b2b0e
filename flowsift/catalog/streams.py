"""Queries that run as streams: each drains what is there and returns the written table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from flowsift.catalog.alerts import ALERTS_SQL, CORRELATED_SQL, LOOKBACK, MOMENT, alerts
from flowsift.catalog.base import DAY, FLOWS_SQL, ORACLE, flows, micros, query, run_folder, table
from flowsift.catalog.features import _interval_columns, damaged_messages, dns_rounded, name_queries
from flowsift.catalog.analytics import contract_features, small_models
from flowsift.operators.alerts import correlate
from flowsift.sources import wire
from flowsift.streaming import ingest, metrics
from flowsift.streaming.correlation import start_correlation, tagged_alerts
from flowsift.streaming.features import start_features
from flowsift.streaming.names import start_queries
from flowsift.streaming.scoring import score_batches
from flowsift.streaming.store import children, read_table, write_batch

HOUR = 3_600_000_000
# rows of one file of a stream's input
FILE_ROWS = 200_000


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _drain(stream, write, root: str):
    ingest.start_batches(stream, write, f"{root}/offsets", once=True).awaitTermination()


def _append(path: str):
    return lambda batch, batch_id: write_batch(batch, path, batch_id)


def _files(rows, parts: int) -> int:
    """Files of one part, so that a task writes or reads a bounded number of rows."""
    return max(1, math.ceil(rows.count() / (parts * FILE_ROWS)))


def _as_batch(rows, folder: str, files: int = 1):
    """Adds rows as exactly so many files, which a stream of so many files a batch takes at once; blank rows fill up."""
    (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(folder)
    missing = -sum(name.endswith(".parquet") for name in children(rows.sparkSession, folder)) % files
    if missing:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
        rows.sparkSession.range(0, missing, 1, missing).select(*blank).write.mode("append").parquet(folder)


def _in_parts(rows, order: str, folder: str, parts: int = 4, files: int = 1):
    """Writes rows as files in time order, so many per part, so a stream of so many files a batch meets the parts in turn."""
    cuts = rows.select(F.col(order).cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.01)
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        at = F.col(order).cast("double")
        inside = (F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
        _as_batch(rows.where(inside), folder, files)


def _as_stream(spark, folder: str, files: int = 1):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def _heartbeat(rows, order: str, later: float):
    """One row without a flow, later than all others by so much: it flushes a stream."""
    end = rows.agg((F.max(order) + F.lit(later)).alias(order))
    return end.select(*(F.col(c) if c == order else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))


@query("stream_flow_features", ORACLE["flow_windows"])
def stream_flow_features(spark, d):
    """Rolling features from keyed state, over four batches in time order and one that flushes."""
    root = run_folder(spark, "features")
    rows = flows(spark, d)
    files = _files(rows, 4)
    _in_parts(rows, "ts", f"{root}/in", 4, files)
    _as_batch(_heartbeat(rows, "ts", 10.0), f"{root}/in", files)
    start_features(_as_stream(spark, f"{root}/in", files), root, DAY, lateness_seconds=5.0, once=True).awaitTermination()
    return read_table(spark, f"{root}/features").select(
        "uid", "connection_frequency", "fan_out", "unique_dst_ips", "unique_dst_ports", "fan_in",
        (F.round("src_ip_entropy", 6) + 0.0).alias("src_ip_entropy"), *_interval_columns(),
        F.round(F.least("periodicity_score", F.lit(100.0)), 9).alias("periodicity_score"),
    )


@query("stream_dns_window", ORACLE["dns_window"])
def stream_dns_window(spark, d):
    """Purchases with the name queries of their user in the day before, both arriving over four batches."""
    root = run_folder(spark, "names")
    purchases, asked = flows(spark, d).filter("dst_ip = 'purchase'"), name_queries(spark, d)
    for name, rows in (("flows", purchases), ("queries", asked)):
        _in_parts(rows, "ts", f"{root}/{name}")
        # behind both ends: the slower stream's watermark rules
        _heartbeat(rows, "ts", 40 * DAY).select(
            *(F.col(f.name).cast(f.dataType) for f in rows.schema)).write.mode("append").parquet(f"{root}/{name}")
    start_queries(_as_stream(spark, f"{root}/flows"), _as_stream(spark, f"{root}/queries"), root, DAY, 5.0, 5.0,
                  once=True).awaitTermination()
    return dns_rounded(read_table(spark, f"{root}/dns").drop("batch"), "uid")


LATE_SQL = f"""WITH {FLOWS_SQL} SELECT uid, CASE WHEN t % 10 = 0 THEN 'no time' ELSE 'behind' END AS reason FROM flows WHERE t % 10 < 2"""


@query("stream_late_flows", LATE_SQL)
def stream_late_flows(spark, d):
    """Flows that come after the watermark has passed them, or have no time, leave as late ones."""
    root = run_folder(spark, "late")
    rows = flows(spark, d)
    digit = F.round(F.col("ts") * 1e6).cast("bigint") % 10
    files = _files(rows, 2)
    _in_parts(rows.where(digit >= 2), "ts", f"{root}/in", 2, files)
    _as_batch(_heartbeat(rows, "ts", 10.0), f"{root}/in", files)
    late = rows.where(digit < 2).withColumn("ts", F.when(digit == 1, F.col("ts")))
    _as_batch(late, f"{root}/in", files)
    start_features(_as_stream(spark, f"{root}/in", files), root, DAY, lateness_seconds=5.0, once=True).awaitTermination()
    reason = F.when(F.col("ts").isNull(), "no time").otherwise("behind")
    return read_table(spark, f"{root}/late").select("uid", reason.alias("reason"))


def _flow_stream(spark, d):
    return flows(spark, d, _events(spark, d))


@query("stream_throughput", f"""WITH e AS (SELECT epoch_us(ts) // {HOUR} AS h, length(props) AS b FROM events)
  SELECT h * {HOUR} AS t, round(count(*) / 3600.0, 2) AS flows_per_sec, round(sum(b) / 3600.0, 2) AS bytes_per_sec, count(*) AS window_flows
  FROM e GROUP BY h""")
def stream_throughput(spark, d):
    """Hourly windows, each written once the watermark has passed its end; a heartbeat flushes the last ones."""
    root = run_folder(spark, "throughput")
    rows = table(spark, d, "events").select(
        micros("ts").alias("t"), F.col("event_id").alias("flow_id"), F.length("props").alias("bytes"),
        F.col("value").alias("latency_ms"))
    _in_parts(rows, "t", f"{root}/in")
    _heartbeat(rows, "t", 3 * HOUR).select(F.col("t").cast("bigint"), *rows.columns[1:]).write.mode("append").parquet(f"{root}/in")
    timed = _as_stream(spark, f"{root}/in").withColumn("event_time", F.timestamp_micros("t")).withWatermark("event_time", "1 hour")
    _drain(metrics.throughput(timed, 3600), _append(f"{root}/metrics"), root)
    return read_table(spark, f"{root}/metrics").select(
        F.unix_micros("ts").alias("t"), "flows_per_sec", "bytes_per_sec", "window_flows"
    )


@query("stream_unique_flows", "SELECT event_id::VARCHAR AS flow_id FROM events")
def stream_unique_flows(spark, d):
    """Every flow arrives twice and leaves once."""
    rows = _flow_stream(spark, d).withColumnRenamed("uid", "flow_id").select("flow_id", "ts")
    root = run_folder(spark, "unique")
    _drain(ingest.deduplicate(rows.union(rows)), _append(f"{root}/flows"), root)
    return read_table(spark, f"{root}/flows").select("flow_id")


@query("stream_messages", ORACLE["wire_messages"])
def stream_messages(spark, d):
    """Damaged and sound messages, split into rows and dead letters."""
    root = run_folder(spark, "messages")
    messages = damaged_messages(_flow_stream(spark, d))
    _drain(messages, ingest.split_messages(f"{root}/rows", f"{root}/dead"), root)
    good = read_table(spark, f"{root}/rows").select(F.lit("good").alias("outcome"))
    dead = read_table(spark, f"{root}/dead").select(F.col("error_class").alias("outcome"))
    return good.unionByName(dead).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("stream_correlation", f"WITH {ALERTS_SQL}, {CORRELATED_SQL} SELECT * FROM made")
def stream_correlation(spark, d):
    """Alerts written as a stream; each batch triggers a correlation cycle over the table."""
    root = run_folder(spark, "chains")

    def write(batch, batch_id):
        write_batch(batch, f"{root}/alerts", batch_id)
        found = correlate(tagged_alerts(spark, f"{root}/alerts", f"{root}/chains"), MOMENT, LOOKBACK)
        write_batch(found, f"{root}/chains", batch_id)

    _drain(alerts(spark, d, _events(spark, d)), write, root)
    return read_table(spark, f"{root}/chains").select("id", "src_ip", "kill_chain_id")


@query("stream_correlation_cycles", f"""WITH {ALERTS_SQL}, seen AS (SELECT *, (arrived + {24 * HOUR - 1}) // {24 * HOUR} AS cycle FROM alerts WHERE threat_class <> 'benign'),
  per AS (SELECT src_ip, cycle, count(DISTINCT threat_class) AS classes, arg_min(id, (arrived, id)) AS first_id,
      arg_min(kill_chain_id, (arrived, id)) FILTER (kill_chain_id IS NOT NULL) AS old FROM seen GROUP BY src_ip, cycle)
  SELECT id, src_ip, coalesce(old, 'kc-' || md5(src_ip || '|' || first_id)) AS kill_chain_id
  FROM seen JOIN per USING (src_ip, cycle) WHERE classes >= 2 AND kill_chain_id IS NULL""")
def stream_correlation_cycles(spark, d):
    """Daily cycles over the day before, from keyed state, the alerts arriving over four batches."""
    root = run_folder(spark, "cycles")
    rows = alerts(spark, d).select("id", "src_ip", "threat_class", "kill_chain_id", F.unix_micros("ingested_at").alias("t"))
    _in_parts(rows, "t", f"{root}/in")
    _heartbeat(rows, "t", 48 * HOUR).withColumn("t", F.col("t").cast("bigint")).write.mode("append").parquet(f"{root}/in")
    stream = _as_stream(spark, f"{root}/in").withColumn("ingested_at", F.timestamp_micros("t")).drop("t")
    start_correlation(stream, f"{root}/chains", f"{root}/state", LOOKBACK, LOOKBACK, once=True).awaitTermination()
    return read_table(spark, f"{root}/chains").select("id", "src_ip", "kill_chain_id")


@query("result_messages", """WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)
  SELECT user_id::VARCHAR AS sender, '{"flow_id":"' || event_id || '","ts":' || epoch_us(ts) || ',"src_ip":"' || user_id || '","dst_ip":"' || event_type
    || '","src_port":' || event_id % 65536 || ',"dst_port":' || k || ',"protocol":"tcp","threat_class":"' || event_type || '","confidence":0.5,"anomaly_score":0.25,"evidence":['
    || CASE WHEN k % 3 > 0 THEN '"High rate: ' || k || '"' ELSE '' END || '],"latency_ms":' || CASE WHEN k % 2 = 0 THEN 'null' ELSE k::VARCHAR END || ',"consumer_ts":1.5}' AS body FROM e""")
def result_messages(spark, d):
    """Scored rows as messages keyed by their source."""
    rows = flows(spark, d).select(
        F.col("uid").alias("flow_id"), F.round(F.col("ts") * 1e6).cast("bigint").alias("ts"), "src_ip", "dst_ip",
        (F.col("uid").cast("bigint") % 65536).alias("src_port"), "dst_port", F.lit("tcp").alias("protocol"),
        F.col("dst_ip").alias("threat_class"), F.lit(0.5).alias("confidence"), F.lit(0.25).alias("anomaly_score"),
        F.when(F.col("dst_port") % 3 > 0, F.array(F.concat(F.lit("High rate: "), "dst_port"))).otherwise(
            F.array().cast("array<string>")).alias("evidence"),
        F.when(F.col("dst_port") % 2 > 0, F.col("dst_port")).alias("latency_ms"), F.lit(1.5).alias("consumer_ts"))
    sent = wire.encode_results(rows)
    return sent.select(F.col("key").cast("string").alias("sender"), F.col("value").cast("string").alias("body"))


@query("stream_scores")
def stream_scores(spark, d):
    """Contract rows scored as a stream: results per class, alerts and metrics written beside."""
    root = run_folder(spark, "scores")
    contract_features(spark, d).write.parquet(f"{root}/rows")
    rows = spark.read.parquet(f"{root}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/rows")
    _drain(stream, score_batches(small_models(rows), root, lambda: 1_700_000_000.0), root)
    results = read_table(spark, f"{root}/results")
    return results.groupBy("threat_class").agg(F.count(F.lit(1)).alias("n"))
