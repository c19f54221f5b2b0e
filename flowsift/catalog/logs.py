"""Queries that go through log files: events written as sensor logs, read back, and turned into features."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.catalog.base import micros, prop_k, query, run_folder, table
from flowsift.plans import jobs
from flowsift.sources import tables, zeek
from flowsift.sources.tail import filesystem
from flowsift.streaming import ingest
from flowsift.streaming.store import read_table

CONN = ["uid", "ts", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p", "proto", "duration",
        "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "conn_state"]
# lines of a log for which four files are written
PIECE_LINES = 400_000
EVENTS_SQL = "e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, epoch_us(ts) AS t FROM events)"


def _log_rows(spark, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", prop_k().alias("k"),
                                            F.floor("value").alias("value"), micros("ts").alias("t"))


def _conn_cells() -> dict[str, Column]:
    """Cells of a connection log line; '-' where a value is missing."""
    k = F.col("k")
    return {
        "uid": F.col("event_id"), "ts": (F.col("t") / F.lit(1e6)).cast("decimal(20,6)"),
        "id.orig_h": F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256), F.lit("."), F.col("user_id") % 256),
        "id.resp_h": F.concat(F.lit("10.9.9."), F.length("event_type")), "id.orig_p": F.col("event_id") % 65536, "id.resp_p": k,
        "proto": F.when(F.col("event_id") % 2 == 0, "TCP").otherwise("udp"),
        "duration": F.when(k % 5 == 0, "-").otherwise(k.cast("string")), "orig_bytes": F.col("value"),
        "resp_bytes": F.lit("-"), "orig_pkts": k, "resp_pkts": F.lit("1"), "conn_state": F.lit("SF"),
    }


def _line(cells: list[Column], separator: str = "\t") -> Column:
    return F.concat_ws(separator, *[c.cast("string") for c in cells])


def _write_logs(lines: DataFrame, headers: list[tuple[int, int, str]], folder: str) -> None:
    """lines: part, line. Each part stands under its own header, several parts may share a file.

    A part is spread over as many pieces as its rows ask for, each of which repeats its header."""
    pieces = max(1, -(-lines.count() // PIECE_LINES))
    above = lines.sparkSession.createDataFrame(headers, "part int, place int, line string").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    below = lines.select("part", F.lit(1_000).alias("place"), "line",
                         F.pmod(F.xxhash64("line"), F.lit(pieces)).cast("int").alias("piece"))
    of_piece = ["part"] if pieces == 1 else ["part", "piece"]
    above.unionByName(below).repartition(4 * pieces, *of_piece).sortWithinPartitions(*of_piece, "place").select(
        "line").write.text(folder)


def _header(part: int, names: list[str], separator: str = "\t", named: str = r"\x09") -> list[tuple[int, int, str]]:
    return [(part, 0, f"#separator {named}"), (part, 1, separator.join(["#fields", *names])),
            (part, 2, separator.join(["#types", *("string" for _ in names)]))]


@query("mixed_log_rows", f"""WITH {EVENTS_SQL} SELECT event_id::VARCHAR AS uid,
    CASE WHEN event_id % 3 = 0 OR event_id % 3 = 2 AND k % 2 = 1 THEN k END::VARCHAR AS k,
    CASE WHEN event_id % 3 < 2 THEN floor(value)::BIGINT END::VARCHAR AS value, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind FROM e""")
def mixed_log_rows(spark, d):
    """Three layouts with separators of their own, some of them one below the other in a file."""
    folder = run_folder(spark, "logs")
    uid, k, value, kind = (F.col(c) for c in ("event_id", "k", "value", "event_type"))
    part = (uid % 3).cast("int")
    line = (F.when(part == 0, _line([uid, k, value])).when(part == 1, _line([value, uid, kind], ", "))
            .otherwise(_line([uid, kind, F.when(k % 2 == 1, k.cast("string")).otherwise("-")], "|")))
    headers = [*_header(0, ["uid", "k", "value"]), *_header(1, ["value", "uid", "kind"], ", ", r"\x2c\x20"),
               *_header(2, ["uid", "kind", "k"], "|", "|")]
    _write_logs(_log_rows(spark, d).select(part.alias("part"), line.alias("line")), headers, folder)
    return zeek.read_log(spark, folder).select("uid", "k", "value", "kind")


def _conn_log(rows: DataFrame, folder: str, line: Column | None = None) -> None:
    cells = _conn_cells()
    line = _line([cells[c] for c in CONN]) if line is None else line
    headers = [h for part in range(4) for h in _header(part, CONN)]
    _write_logs(rows.select((F.col("event_id") % 4).cast("int").alias("part"), line.alias("line")), headers, f"{folder}/conn.log")


FEATURES_SQL = f"""WITH {EVENTS_SQL} SELECT event_id::VARCHAR AS flow_id, t / 1e6 AS ts, '10.0.' || user_id // 256 || '.' || user_id % 256 AS src_ip,
    '10.9.9.' || length(event_type) AS dst_ip, k AS dst_port, CASE event_id % 2 WHEN 0 THEN 'tcp' ELSE 'udp' END AS protocol,
    CASE WHEN k % 5 = 0 THEN 0 ELSE k END::DOUBLE AS duration, floor(value)::BIGINT AS orig_bytes, 0::BIGINT AS resp_bytes,
    CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END::DOUBLE AS packets_per_sec, event_type = 'click' AS is_tls,
    CASE event_type WHEN 'click' THEN 'C' || k ELSE '' END AS cipher_suite, 'all' AS scenario,
    count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)::DOUBLE AS connection_frequency FROM e"""


@query("feature_job_rows", FEATURES_SQL)
def feature_job_rows(spark, d):
    """The whole job: logs in, one Parquet row of features per flow out."""
    folder = run_folder(spark, "job")
    rows = _log_rows(spark, d)
    _conn_log(rows, f"{folder}/logs")
    sessions = rows.where("event_type = 'click'").select(F.lit(0).alias("part"), _line([
        F.col("event_id"), (F.col("t") / F.lit(1e6)).cast("decimal(20,6)"), F.lit("TLSv12"), F.concat(F.lit("C"), "k")]).alias("line"))
    _write_logs(sessions, _header(0, ["uid", "ts", "version", "cipher"]), f"{folder}/logs/ssl.log")
    jobs.feature_job(spark, f"{folder}/logs", "all", f"{folder}/features")
    return tables.read_features(spark, f"{folder}/features").select(
        "flow_id", "ts", "src_ip", "dst_ip", "dst_port", "protocol", "duration", "orig_bytes", "resp_bytes", "packets_per_sec",
        "is_tls", "cipher_suite", "scenario", "connection_frequency")


@query("rejected_rows", """SELECT event_id::VARCHAR AS flow_id, ['invalid orig_bytes', 'malformed line', 'duplicate uid', 'invalid protocol'][event_id % 11 + 1] AS reasons
  FROM events WHERE event_id % 11 < 4 UNION ALL SELECT event_id::VARCHAR, 'duplicate uid' FROM events WHERE event_id % 11 = 2""")
def rejected_rows(spark, d):
    """What the job keeps apart in quarantine mode: bad values, torn lines, repeated uids, broken contracts."""
    folder = run_folder(spark, "quarantine")
    kind = F.col("event_id") % 11
    rows = _log_rows(spark, d)
    rows = rows.unionByName(rows.where(kind == 2))
    cells = _conn_cells()
    cells["orig_bytes"] = F.when(kind == 0, "oops").otherwise(cells["orig_bytes"].cast("string"))
    cells["proto"] = F.when(kind == 3, "sctp").otherwise(cells["proto"])
    line = _line([cells[c] for c in CONN])
    _conn_log(rows, f"{folder}/logs", F.when(kind == 1, F.concat(line, F.lit("\tmore"))).otherwise(line))
    jobs.feature_job(spark, f"{folder}/logs", "all", f"{folder}/features", "quarantine")
    return spark.read.parquet(f"{folder}/features_rejected").select("flow_id", F.array_join("violations", ";").alias("reasons"))


def _appender(folder: str):
    """Adds lines to log files where they lie, a task per file and a write per batch of lines."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = filesystem(folder)
        with ExitStack() as opened:
            logs = {}
            for batch in batches:
                for log in pc.unique(batch.column("log")).to_pylist():
                    if log not in logs:
                        logs[log] = opened.enter_context(files.open_append_stream(f"{place}/conn.{log}.log"))
                    lines = batch.filter(pc.equal(batch.column("log"), log)).column("line").to_pylist()
                    logs[log].write("".join(f"{line}\n" for line in lines).encode())
                yield batch.select(["log"])

    return add


@query("tailed_log_rows", """SELECT event_id::VARCHAR AS uid, '10.0.' || user_id // 256 || '.' || user_id % 256 AS src_ip,
    json_extract_string(props, '$.k') AS dst_port, floor(value)::BIGINT::VARCHAR AS orig_bytes FROM events""")
def tailed_log_rows(spark, d):
    """Logs that grow while a stream follows them: three times lines are added, and every line comes out once."""
    folder = run_folder(spark, "tail")
    files, place = filesystem(f"{folder}/logs")
    files.create_dir(place, recursive=True)
    cells = _conn_cells()
    rows = _log_rows(spark, d).select((F.col("event_id") % 4).cast("int").alias("log"), _line([cells[c] for c in CONN]).alias("line"),
                                      F.pmod(F.hash("event_id"), F.lit(3)).alias("turn"))
    for log in range(4):
        with files.open_output_stream(f"{place}/conn.{log}.log") as file:
            file.write("".join(f"{h[2]}\n" for h in _header(0, CONN)).encode())
    stream = ingest.tail_log(spark, f"{folder}/logs", CONN, f"{folder}/progress", max_rows=20_000)
    running = ingest.start_batches(stream, ingest.split_log(f"{folder}/rows", f"{folder}/dead"), f"{folder}/offsets", interval="0 seconds")
    try:
        for turn in range(3):
            new = rows.where(F.col("turn") == turn).select("log", "line").repartition(4, "log")
            new.mapInArrow(_appender(f"{folder}/logs"), "log int").write.format("noop").mode("overwrite").save()
            running.processAllAvailable()
    finally:
        running.stop()
    return read_table(spark, f"{folder}/rows").select(
        "uid", F.col("`id.orig_h`").alias("src_ip"), F.col("`id.resp_p`").alias("dst_port"), "orig_bytes")
