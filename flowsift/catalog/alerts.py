"""Queries of the alert table: search, statistics, correlation, kill chains."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from flowsift.catalog.base import NOW, ORACLE, micros, prop_k, query, run_folder, table
from flowsift.functions import scalar
from flowsift.operators import alerts as A
from flowsift.operators.ordering import first_in_groups, latest
from flowsift.sources import alert_table
from flowsift.streaming import metrics

MOMENT = datetime.fromisoformat(NOW)
LOOKBACK = timedelta(days=1)

CLASSES_SQL = """CASE event_type WHEN 'click' THEN 'ddos' WHEN 'view' THEN 'benign' WHEN 'error' THEN 'port_scan'
      WHEN 'signup' THEN 'c2_beaconing' ELSE 'exfiltration' END"""
ALERTS_SQL = f"""alerts AS (
  SELECT 'al-' || event_id AS id, epoch_us(ts) AS t, epoch_us(ts) + 1000000 * k AS arrived, user_id::VARCHAR AS src_ip,
    {CLASSES_SQL} AS threat_class, confidence, k,
    CASE WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'info' END AS severity,
    CASE WHEN k < 10 THEN 'kc-' || user_id || '-' || k % 2 END AS kill_chain_id
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k, (value % 101) / 100 AS confidence FROM events))"""
NOW_SQL = f"epoch_us(TIMESTAMP '{NOW}')"
DAY_SQL = "86400000000"


def alerts(spark, d, events=None):
    """Events seen as alerts; a tenth of them already belongs to a chain."""
    k, user = prop_k(), F.col("user_id").cast("string")
    events = table(spark, d, "events") if events is None else events
    events = events.withColumn("confidence", (F.col("value") % 101) / 100)
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("al-"), "event_id").alias("id"),
        F.timestamp_micros(micros("ts")).alias("timestamp"),
        F.timestamp_micros(micros("ts") + k.cast("bigint") * 1_000_000).alias("ingested_at"),
        F.col("event_id").cast("string").alias("flow_id"), user.alias("src_ip"),
        kind.alias("dst_ip"), F.lit(None).cast("int").alias("src_port"), k.alias("dst_port"), F.lit("tcp").alias("protocol"),
        F.col("value").alias("duration"),
        F.when(kind == "click", "ddos").when(kind == "view", "benign").when(kind == "error", "port_scan")
        .when(kind == "signup", "c2_beaconing").otherwise("exfiltration").alias("threat_class"),
        scalar.severity("confidence").alias("severity"), "confidence", F.lit(0.1).alias("anomaly_score"),
        F.when(k % 3 > 0, F.array(F.concat(F.lit("High packet-rate: "), k), kind)).alias("evidence"),
        F.lit("").alias("ja3_hash"), F.lit("").alias("ja4_hash"), F.lit(False).alias("is_quic"), F.lit(False).alias("quic_0rtt"),
        F.when(k < 10, F.concat(F.lit("kc-"), user, F.lit("-"), k % 2)).alias("kill_chain_id"),
    )


def _at(column: str, name: str = "t"):
    return F.unix_micros(column).alias(name)


@query("alert_search", f"""WITH {ALERTS_SQL} SELECT id, t, src_ip, threat_class, severity FROM alerts
  WHERE severity = 'high' AND threat_class = 'ddos' AND t BETWEEN {NOW_SQL} - 20 * {DAY_SQL} AND {NOW_SQL}""")
def alert_search(spark, d):
    hits = A.filter_alerts(alerts(spark, d), severity="high", threat_class="ddos", since=MOMENT - 20 * LOOKBACK, until=MOMENT)
    return hits.select("id", _at("timestamp"), "src_ip", "threat_class", "severity")


@query("alert_page", f"""WITH {ALERTS_SQL} SELECT id, t, severity FROM alerts WHERE severity = 'critical'
  ORDER BY t DESC, id LIMIT 25 OFFSET 50""")
def alert_page(spark, d):
    rows, _ = A.alert_page(alerts(spark, d), 3, 25, severity="critical")
    return rows.select("id", _at("timestamp"), "severity")


@query("alert_page_info", f"""WITH {ALERTS_SQL} SELECT count(*) AS total, 3 AS page, 25 AS page_size,
    greatest(ceil(count(*) / 25.0), 1)::BIGINT AS pages FROM alerts WHERE severity = 'critical'""")
def alert_page_info(spark, d):
    return A.alert_page(alerts(spark, d), 3, 25, severity="critical")[1]


@query("alert_lookup", f"WITH {ALERTS_SQL} SELECT id, t, src_ip, threat_class FROM alerts WHERE id = 'al-77'")
def alert_lookup(spark, d):
    return A.alert_by_id(alerts(spark, d), "al-77").select("id", _at("timestamp"), "src_ip", "threat_class")


@query("alert_fields", f"""WITH {ALERTS_SQL} SELECT id, t, 0 AS src_port, k AS dst_port, (CASE WHEN k % 3 > 0 THEN 2 ELSE 0 END)::INT AS reasons,
    src_ip, severity FROM alerts""")
def alert_fields(spark, d):
    return A.flatten_alerts(alerts(spark, d)).select(
        "id", _at("timestamp"), "src_port", "dst_port", F.size("evidence").alias("reasons"), "src_ip", "severity"
    )


@query("evidence_search", f"""WITH {ALERTS_SQL} SELECT id FROM alerts WHERE k % 3 > 0""")
def evidence_search(spark, d):
    return A.filter_alerts(alerts(spark, d), evidence="PACKET unseen").select("id")


WORDS = "the der license http"
WORD_PATTERN = r"[^\p{L}\p{N}_]+"


@query("text_search", f"""SELECT doc_id FROM documents
  WHERE list_has_any(regexp_split_to_array(lower(text), '{WORD_PATTERN}'), ['the', 'der', 'license', 'http'])""")
def text_search(spark, d):
    """Token search over whole documents."""
    return table(spark, d, "documents").filter(A.evidence_matches(F.col("text"), WORDS)).select("doc_id")


@query("text_search_part", "SELECT doc_id FROM documents WHERE contains(lower(text), 'icens')")
def text_search_part(spark, d):
    return table(spark, d, "documents").filter(A.evidence_matches(F.col("text"), "iCens", "substring")).select("doc_id")


RECENT_SQL = f"recent AS (SELECT * FROM alerts WHERE arrived >= {NOW_SQL} - {DAY_SQL})"


def _recent(spark, d):
    return A.recent(alerts(spark, d), MOMENT, 24)


@query("stats_total", f"WITH {ALERTS_SQL}, {RECENT_SQL} SELECT count(*) AS total_alerts FROM recent")
def stats_total(spark, d):
    return A.alert_stats(alerts(spark, d), MOMENT, 24)["total"]


@query("stats_by_class", f"WITH {ALERTS_SQL}, {RECENT_SQL} SELECT threat_class, count(*) AS n FROM recent GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def stats_by_class(spark, d):
    return A.count_by_class(_recent(spark, d), 20)


@query("stats_by_severity", f"WITH {ALERTS_SQL}, {RECENT_SQL} SELECT severity, count(*) AS n FROM recent GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def stats_by_severity(spark, d):
    return A.count_by_severity(_recent(spark, d), 10)


@query("stats_top_sources", f"WITH {ALERTS_SQL} SELECT src_ip, count(*) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def stats_top_sources(spark, d):
    return A.top_sources(alerts(spark, d))


# keeps means off exact halves of the second digit, which engines round differently
SHIFT = 0.00001234
BUCKET_SQL = "300000000"


@query("stats_timeline", f"""WITH {ALERTS_SQL}, {RECENT_SQL},
  g AS (SELECT unnest(range(({NOW_SQL} - {DAY_SQL}) // {BUCKET_SQL}, {NOW_SQL} // {BUCKET_SQL} + 1)) AS b),
  c AS (SELECT arrived // {BUCKET_SQL} AS b, count(*) AS n FROM recent GROUP BY 1)
  SELECT b * {BUCKET_SQL} AS bucket, coalesce(n, 0) AS n FROM g FULL JOIN c USING (b)""")
def stats_timeline(spark, d):
    return A.timeline(_recent(spark, d), MOMENT - LOOKBACK, MOMENT).select(_at("bucket", "bucket"), "n")


CORRELATED_SQL = f"""seen AS (SELECT * FROM alerts WHERE arrived >= {NOW_SQL} - {DAY_SQL} AND threat_class <> 'benign'),
  per AS (SELECT src_ip, count(DISTINCT threat_class) AS classes,
      arg_min(kill_chain_id, (arrived, id)) FILTER (kill_chain_id IS NOT NULL) AS old,
      arg_min(id, (arrived, id)) AS first_id FROM seen GROUP BY src_ip),
  made AS (SELECT s.id, s.src_ip, coalesce(old, 'kc-' || md5(s.src_ip || '|' || first_id)) AS kill_chain_id
    FROM seen s JOIN per USING (src_ip) WHERE classes >= 2 AND s.kill_chain_id IS NULL)"""


def _made(spark, d):
    return A.correlate(alerts(spark, d), MOMENT, LOOKBACK)


@query("correlate", f"WITH {ALERTS_SQL}, {CORRELATED_SQL} SELECT * FROM made")
def correlate(spark, d):
    return _made(spark, d)


@query("correlate_oldest", f"""WITH {ALERTS_SQL}, {CORRELATED_SQL.replace("<> 'benign')", "<> 'benign' ORDER BY arrived, id LIMIT 25)", 1)}
  SELECT * FROM made""")
def correlate_oldest(spark, d):
    """A cycle that looks at the 25 oldest alerts of the look-back only."""
    return A.correlate(alerts(spark, d), MOMENT, LOOKBACK, max_alerts=25)


def _tagged(spark, d):
    return A.write_back(alerts(spark, d), _made(spark, d))


TAGGED_SQL = "tagged AS (SELECT a.* REPLACE (coalesce(a.kill_chain_id, m.kill_chain_id) AS kill_chain_id) FROM alerts a LEFT JOIN made m USING (id))"


@query("chain_write_back", f"""WITH {ALERTS_SQL}, {CORRELATED_SQL}, {TAGGED_SQL} SELECT id, kill_chain_id FROM tagged""")
def chain_write_back(spark, d):
    return _tagged(spark, d).select("id", "kill_chain_id")


@query("chain_summary", f"""WITH {ALERTS_SQL}, {CORRELATED_SQL}, {TAGGED_SQL} SELECT kill_chain_id AS chain_id, arg_min(src_ip, (t, id)) AS src_ip,
    min(t) AS first_seen, max(t) AS last_seen, count(*) AS stage_count,
    CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)
      WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'info' END AS max_severity
  FROM tagged WHERE kill_chain_id IS NOT NULL AND t >= {NOW_SQL} - 15 * {DAY_SQL} GROUP BY 1""")
def chain_summary(spark, d):
    done = A.chain_summary(_tagged(spark, d), MOMENT - 15 * LOOKBACK)
    return done.select("chain_id", "src_ip", _at("first_seen", "first_seen"), _at("last_seen", "last_seen"), "stage_count", "max_severity")


STAGES_SQL = """stages AS (SELECT * FROM (SELECT kill_chain_id AS chain_id, id AS alert_id, t, threat_class, severity,
    row_number() OVER (PARTITION BY kill_chain_id ORDER BY t, id) AS stage FROM tagged WHERE kill_chain_id IS NOT NULL) WHERE stage <= 20)"""


@query("chain_stages", f"WITH {ALERTS_SQL}, {CORRELATED_SQL}, {TAGGED_SQL}, {STAGES_SQL} SELECT * FROM stages")
def chain_stages(spark, d):
    return A.chain_stages(_tagged(spark, d), limit=A.STAGE_LIMIT).select(
        "chain_id", "alert_id", _at("timestamp"), "threat_class", "severity", F.col("stage").cast("bigint").alias("stage")
    )


@query("kill_chains", f"""WITH {ALERTS_SQL}, {CORRELATED_SQL}, {TAGGED_SQL}, {STAGES_SQL},
  top AS (SELECT kill_chain_id AS chain_id, max(t) AS last_seen, count(*) AS stage_count FROM tagged WHERE kill_chain_id IS NOT NULL
    GROUP BY 1 ORDER BY last_seen DESC, chain_id LIMIT 100)
  SELECT chain_id, last_seen, stage_count, string_agg(alert_id, ',' ORDER BY stage) AS alerts,
    string_agg(threat_class, ',' ORDER BY stage) AS classes FROM top JOIN stages USING (chain_id) GROUP BY ALL""")
def kill_chains(spark, d):
    """The hundred chains seen last, each with its first twenty stages nested."""
    done = A.kill_chains(_tagged(spark, d), stages=A.STAGE_LIMIT, max_chains=100)
    return done.select(
        "chain_id", _at("last_seen", "last_seen"), "stage_count",
        F.array_join("stages.alert_id", ",").alias("alerts"), F.array_join("stages.threat_class", ",").alias("classes"),
    )


@query("stage_alerts", f"""WITH {ALERTS_SQL}, {CORRELATED_SQL}, {TAGGED_SQL}, {STAGES_SQL}
  SELECT chain_id, stage, id, tagged.t, confidence FROM stages JOIN tagged ON alert_id = id""")
def stage_alerts(spark, d):
    tagged = _tagged(spark, d)
    return A.stage_alerts(A.chain_stages(tagged, limit=A.STAGE_LIMIT), tagged).select(
        "chain_id", F.col("stage").cast("bigint").alias("stage"), "id", _at("timestamp"), "confidence"
    )


@query("first_orders", """SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank
    FROM orders) WHERE rank <= 3""")
def first_orders(spark, d):
    ranked = first_in_groups(table(spark, d, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 3)
    return ranked.select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("latest_points", "SELECT event_id, epoch_us(ts) AS t, value FROM events ORDER BY ts DESC LIMIT 30")
def latest_points(spark, d):
    return latest(table(spark, d, "events"), "ts", 30).select("event_id", micros("ts").alias("t"), "value")


@query("severity_levels", f"WITH {ALERTS_SQL} SELECT id, severity FROM alerts")
def severity_levels(spark, d):
    return alerts(spark, d).select("id", "severity")


@query("decisions", """WITH e AS (SELECT event_id, (value % 97) / 97 AS p, json_extract_string(props, '$.k')::INT / 100.0 AS raw, event_id % 7 AS c FROM events),
  s AS (SELECT *, least(greatest(raw / 0.8, 0), 1) AS anomaly, greatest(p, (1 - p) / 6) AS confidence FROM e)
  SELECT event_id, round(confidence, 4) AS confidence, round(anomaly, 4) AS anomaly_score,
    CASE WHEN cls = 'benign' AND confidence < 0.5 AND anomaly > 0.5 THEN 'unknown_anomaly' ELSE cls END AS service,
    CASE WHEN confidence <= 0.5 THEN 'unknown_anomaly' ELSE cls END AS library
  FROM (SELECT *, ['benign', 'c2_beaconing', 'ddos', 'dns_anomaly', 'exfiltration', 'malware_tls', 'port_scan'][
      CASE WHEN p >= (1 - p) / 6 THEN c + 1 WHEN c = 0 THEN 2 ELSE 1 END] AS cls FROM s)""")
def decisions(spark, d):
    """Class probabilities and an anomaly score to a verdict, under both policies."""
    k, c = prop_k(), F.col("event_id") % 7
    p = (F.col("value") % 97) / 97
    probs = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i == c, p).otherwise((1 - p) / 6))
    rows = table(spark, d, "events").select("event_id", probs.alias("probs"), scalar.anomaly_norm(k / 100.0).alias("anomaly"))
    verdict = scalar.decide("probs", "anomaly")
    return rows.select(
        "event_id", F.round(verdict["confidence"], 4).alias("confidence"), F.round("anomaly", 4).alias("anomaly_score"),
        verdict["threat_class"].alias("service"), scalar.decide("probs", "anomaly", policy="library")["threat_class"].alias("library"),
    )


@query("latency_bands", """SELECT CASE WHEN value * 3 < 100 THEN 'green' WHEN value * 3 < 500 THEN 'yellow' ELSE 'red' END AS band,
    count(*) AS n, round(sum(value) / 1048576, 6) AS megabytes FROM events GROUP BY 1""")
def latency_bands(spark, d):
    banded = table(spark, d, "events").groupBy(scalar.latency_band(F.col("value") * 3).alias("band"))
    return banded.agg(F.count(F.lit(1)).alias("n"), F.round(scalar.megabytes(F.sum("value")), 6).alias("megabytes"))


@query("event_times", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso FROM events""")
def event_times(spark, d):
    return table(spark, d, "events").select("event_id", scalar.iso_utc(micros("ts") / F.lit(1e6)).alias("iso"))


@query("throughput", f"""WITH e AS (SELECT epoch_us(ts) // 3600000000 AS h, event_id, ts, length(props) AS b, value FROM events)
  SELECT h * 3600000000 AS t, round(count(*) / 3600.0, 2) AS flows_per_sec, round(sum(b) / 3600.0, 2) AS bytes_per_sec,
    round(arg_max(value, (ts, event_id)), 2) AS pipeline_latency_ms, round(avg(value + {SHIFT}), 2) AS latency_ms_mean, count(*) AS window_flows FROM e GROUP BY h""")
def throughput(spark, d):
    """Tumbling windows of one hour over the event stream."""
    rows = table(spark, d, "events").select(
        F.timestamp_micros(micros("ts")).alias("event_time"), F.col("event_id").alias("flow_id"),
        F.length("props").alias("bytes"), (F.col("value") + SHIFT).alias("latency_ms"),
    )
    return metrics.throughput(rows, 3600).select(
        _at("ts"), "flows_per_sec", "bytes_per_sec", "pipeline_latency_ms", "latency_ms_mean", "window_flows"
    )


@query("queue_depth", """WITH e AS (SELECT event_type, event_id, json_extract_string(props, '$.k')::INT AS k FROM events)
  SELECT event_type, coalesce(greatest(max(event_id) - max(event_id) FILTER (k < 3), 0), -1) AS queue_depth FROM e GROUP BY 1""")
def queue_depth(spark, d):
    events = table(spark, d, "events")
    return metrics.queue_depth(events, events.filter(prop_k() < 3), "event_type", "event_id")


@query("publisher_counters", """WITH e AS (SELECT epoch_us(ts) // 86400000000 AS day, event_type, user_id FROM events)
  SELECT day * 86400000000 AS t, count(*) FILTER (event_type NOT IN ('error', 'view')) AS published, count(*) FILTER (event_type = 'view') AS dropped,
    count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS batches FROM e GROUP BY day""")
def publisher_counters(spark, d):
    kind = F.col("event_type")
    rows = table(spark, d, "events").select(
        F.timestamp_micros(micros("ts")).alias("event_time"), F.col("user_id").alias("batch_id"),
        F.when(kind == "error", "error").when(kind == "view", "dropped").otherwise("published").alias("outcome"),
    )
    return metrics.outcome_counters(rows, 86_400).select(_at("ts"), "published", "dropped", "errors", "batches")


# --- the alert table on disk ---


# a folder of the table spans a day, since events are spread thinly over thirty of them
SPAN = 24
SPAN_SQL = "arrived // 86400000000 * 24"


def _written(spark, d, name):
    folder = run_folder(spark, name)
    alert_table.write_alerts(alerts(spark, d), f"{folder}/alerts", hours=SPAN)
    return f"{folder}/alerts"


@query("table_write_back", f"""WITH {ALERTS_SQL}, {CORRELATED_SQL}, {TAGGED_SQL}
  SELECT id, {SPAN_SQL} AS hour, kill_chain_id FROM tagged""")
def table_write_back(spark, d):
    """A correlation cycle on the table by ingest time: only the folders with new chain ids are rewritten."""
    folder = _written(spark, d, "write_back")
    alert_table.correlate_table(spark, folder, MOMENT, LOOKBACK, hours=SPAN)
    return alert_table.read_alerts(spark, folder).select("id", "hour", "kill_chain_id")


@query("table_retention", f"""WITH {ALERTS_SQL} SELECT {SPAN_SQL} AS hour, count(*) AS n FROM alerts
  WHERE arrived // 86400000000 >= ({NOW_SQL} - 5 * {DAY_SQL}) // 86400000000 GROUP BY 1""")
def table_retention(spark, d):
    """Rows of the folders left once all that ended five days before the moment are dropped."""
    folder = _written(spark, d, "retention")
    alert_table.retain(spark, folder, MOMENT - 5 * LOOKBACK, hours=SPAN)
    return alert_table.read_alerts(spark, folder).groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


@query("feed_page", f"""WITH {ALERTS_SQL} SELECT id, t, severity FROM alerts ORDER BY t DESC, id LIMIT 25 OFFSET 600""")
def feed_page(spark, d):
    """Page 25 of the feed, read from the parts that hold it."""
    folder = run_folder(spark, "feed")
    alert_table.write_feed(alerts(spark, d), folder, 500)
    return alert_table.feed_page(spark, folder, 25, 25).select("id", _at("timestamp"), "severity")


@query("indexed_evidence", f"""WITH {ALERTS_SQL} SELECT id, t FROM alerts
  WHERE k % 3 > 0 AND threat_class = 'port_scan' AND arrived >= {NOW_SQL} - 10 * {DAY_SQL}""")
def indexed_evidence(spark, d):
    """Alerts of ten days whose evidence holds both words, by the word index."""
    folder = _written(spark, d, "evidence")
    alert_table.index_evidence(alerts(spark, d), f"{folder}_words", hours=SPAN)
    hits = alert_table.search(spark, folder, f"{folder}_words", "Error PACKET", "all", MOMENT - 10 * LOOKBACK, SPAN)
    return hits.select("id", _at("timestamp"))


def _indexed_documents(spark, d):
    folder = f"{run_folder(spark, 'words')}/words"
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(0).cast("bigint").alias("hour"))
    alert_table.write_postings(docs, folder, F.col("text"))
    return folder


@query("indexed_text_search", ORACLE["text_search"])
def indexed_text_search(spark, d):
    """The same as text_search from postings: the buckets of the four words are read."""
    return alert_table.find(spark, _indexed_documents(spark, d), WORDS).select(F.col("id").cast("bigint").alias("doc_id"))


@query("indexed_text_search_all", f"""SELECT doc_id FROM documents
  WHERE list_has_all(regexp_split_to_array(lower(text), '{WORD_PATTERN}'), ['the', 'of', 'and'])""")
def indexed_text_search_all(spark, d):
    """Documents with all words, rarest word first."""
    return alert_table.find(spark, _indexed_documents(spark, d), "the of AND", "all").select(F.col("id").cast("bigint").alias("doc_id"))
