"""Queries of the feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsift.catalog.base import DAY, FLOWS_SQL, ORACLE, flows, micros, prop_k, query, rounded, table
from flowsift.functions import evidence, scalar
from flowsift.operators import dns, enrich, rolling
from flowsift.sources import wire

W = DAY * 1_000_000
# means of whole microseconds often end in an exact half of the sixth digit, which engines
# round differently; both sides move off the half before rounding
SHIFT = 1.234567e-8
RANGE = f"ORDER BY t RANGE BETWEEN {W} PRECEDING AND CURRENT ROW"

SOURCE_SQL = f"""SELECT uid,
    count(*) OVER (PARTITION BY src {RANGE})::DOUBLE AS connection_frequency,
    count(DISTINCT dst || ':' || port) OVER (PARTITION BY src {RANGE})::DOUBLE AS fan_out,
    count(DISTINCT dst) OVER (PARTITION BY src {RANGE}) AS unique_dst_ips,
    count(DISTINCT port) OVER (PARTITION BY src {RANGE}) AS unique_dst_ports
  FROM flows"""
FAN_IN_SQL = f"SELECT uid, count(DISTINCT src) OVER (PARTITION BY dst {RANGE})::DOUBLE AS fan_in FROM flows"
ENTROPY_SQL = f"""SELECT uid, round(-sum(c / n * log2(c / n)) + 0, 6) + 0 AS src_ip_entropy FROM (
    SELECT uid, c, sum(c) OVER (PARTITION BY uid) AS n FROM (
      SELECT a.uid, b.dst, count(*)::DOUBLE AS c FROM flows a JOIN flows b
        ON a.src = b.src AND b.t BETWEEN a.t - {W} AND a.t GROUP BY a.uid, b.dst)) GROUP BY uid"""
INTERVALS_SQL = f"""SELECT uid,
    coalesce(round(avg(gap) OVER life + {SHIFT}, 6), 0) AS iat_mean,
    coalesce(round(stddev_pop(gap) OVER life + {SHIFT}, 5), 0) AS iat_std,
    coalesce(round(min(gap) OVER life, 6), 0) AS iat_min, coalesce(round(max(gap) OVER life, 6), 0) AS iat_max
  FROM (SELECT *, (t - lag(t) OVER (PARTITION BY src ORDER BY t)) / 1e6 AS gap FROM flows)
  WINDOW life AS (PARTITION BY src ORDER BY t ROWS UNBOUNDED PRECEDING)"""
PERIODICITY_SQL = f"""SELECT uid, CASE WHEN count(gap) = 0 THEN 0.0
      ELSE round(least(1.0 / greatest(stddev_pop(gap), 1e-9), 100.0), 9) END AS periodicity_score FROM (
    SELECT a.uid, (b.t - lag(b.t) OVER (PARTITION BY a.uid ORDER BY b.t)) / 1e6 AS gap
    FROM flows a JOIN flows b ON a.src = b.src AND b.t BETWEEN a.t - {W} AND a.t) GROUP BY uid"""


def _source(spark, d):
    return rolling.source_window(flows(spark, d), DAY, lifetime=False)


@query("rolling_source", f"WITH {FLOWS_SQL} {SOURCE_SQL}")
def rolling_source(spark, d):
    return _source(spark, d).select("uid", "connection_frequency", "fan_out", "unique_dst_ips", "unique_dst_ports")


@query("rolling_fan_in", f"WITH {FLOWS_SQL} {FAN_IN_SQL}")
def rolling_fan_in(spark, d):
    return rolling.destination_window(flows(spark, d), DAY).select("uid", "fan_in")


@query("rolling_entropy", f"WITH {FLOWS_SQL} {ENTROPY_SQL}")
def rolling_entropy(spark, d):
    return _source(spark, d).select("uid", rounded("src_ip_entropy"))


@query("rolling_periodicity", f"WITH {FLOWS_SQL} {PERIODICITY_SQL}")
def rolling_periodicity(spark, d):
    score = F.least("periodicity_score", F.lit(100.0))
    return _source(spark, d).select("uid", F.round(score, 9).alias("periodicity_score"))


def _interval_columns():
    some = F.col("iat_max") > 0
    return [
        *[F.when(some, F.round(F.col(c) + SHIFT, n)).otherwise(F.lit(0.0)).alias(c) for c, n in (("iat_mean", 6), ("iat_std", 5))],
        rounded("iat_min"), rounded("iat_max"),
    ]


@query("arrival_intervals", f"WITH {FLOWS_SQL} {INTERVALS_SQL}")
def arrival_intervals(spark, d):
    return rolling.lifetime_intervals(flows(spark, d)).select("uid", *_interval_columns())


@query("flow_windows", f"""WITH {FLOWS_SQL}, a AS ({SOURCE_SQL}), b AS ({FAN_IN_SQL}), c AS ({ENTROPY_SQL}),
  d AS ({INTERVALS_SQL}), e AS ({PERIODICITY_SQL})
  SELECT a.*, fan_in, src_ip_entropy, iat_mean, iat_std, iat_min, iat_max, periodicity_score
  FROM a JOIN b USING (uid) JOIN c USING (uid) JOIN d USING (uid) JOIN e USING (uid)""")
def flow_windows(spark, d):
    """The whole rolling feature set in two shuffles."""
    return _windows_rounded(rolling.flow_windows(flows(spark, d), DAY))


# so few rows to a task that users and event types are both cut into segments
SEGMENT_ROWS = 50


@query("flow_windows_sliced", ORACLE["flow_windows"])
def flow_windows_sliced(spark, d):
    """The same set where both keys are too large for one task."""
    return _windows_rounded(rolling.flow_windows(flows(spark, d), DAY, SEGMENT_ROWS))


def _windows_rounded(done):
    return done.select(
        "uid", "connection_frequency", "fan_out", "unique_dst_ips", "unique_dst_ports", "fan_in",
        rounded("src_ip_entropy"), *_interval_columns(),
        F.round(F.least("periodicity_score", F.lit(100.0)), 9).alias("periodicity_score"),
    )


def _ratio_sql(top: str, bottom: str) -> str:
    return f"round(CASE WHEN abs({bottom}) < 1e-9 THEN 0 ELSE {top} / ({bottom}) END + {SHIFT}, 5)"


@query("flow_rates", f"""SELECT l_orderkey, l_linenumber, l_partkey,
    {_ratio_sql('floor(l_quantity)', 'l_discount')} AS packets_per_sec,
    {_ratio_sql('floor(l_extendedprice)', 'l_discount')} AS bytes_per_sec,
    {_ratio_sql('floor(l_extendedprice)', '(l_suppkey + 1)')} AS outbound_inbound_ratio FROM lineitem""")
def flow_rates(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_discount").alias("duration"), F.floor("l_quantity").alias("orig_pkts"),
        F.floor("l_extendedprice").alias("orig_bytes"), F.col("l_suppkey").alias("resp_bytes"),
    )
    return enrich.with_rates(rows).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[F.round(F.col(c) + SHIFT, 5).alias(c) for c in ("packets_per_sec", "bytes_per_sec", "outbound_inbound_ratio")],
    )


@query("char_entropy", """WITH c AS (SELECT doc_id, ch, count(*)::DOUBLE AS n FROM (
      SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY doc_id, ch),
    s AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS total FROM c)
  SELECT doc_id, round(-sum(n / total * log2(n / total)) + 0, 6) + 0 AS entropy FROM s GROUP BY doc_id""")
def char_entropy(spark, d):
    return table(spark, d, "documents").select("doc_id", scalar.char_entropy("text").alias("entropy")).select(
        "doc_id", rounded("entropy")
    )


HOST = r"^https?://([^/:?#]*)"


@query("host_labels", rf"""SELECT page_id, h AS host,
    len(list_filter(string_split(h, '.'), lambda x: x <> ''))::INT AS labels FROM (
      SELECT page_id, regexp_extract(url, '{HOST}', 1) AS h FROM pages)""")
def host_labels(spark, d):
    host = F.regexp_extract("url", HOST, 1)
    return table(spark, d, "pages").select("page_id", host.alias("host"), scalar.label_count(host).alias("labels"))


@query("record_types", """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
  SELECT event_id, CASE k WHEN '1' THEN 'A' WHEN '28' THEN 'AAAA' WHEN '16' THEN 'TXT' WHEN '15' THEN 'MX' ELSE k END AS qtype FROM e""")
def record_types(spark, d):
    return table(spark, d, "events").select("event_id", scalar.dns_qtype(F.get_json_object("props", "$.k")).alias("qtype"))


VERSIONS = ["TLSv10", "tls 1.1", "TLSv1.2", "TLS_1_3", "TLS13", "TLSv1", "SSLv3", "-", ""]


@query("tls_versions", f"""SELECT p_partkey, CASE p_size % {len(VERSIONS)} WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3
    WHEN 3 THEN 4 WHEN 4 THEN 4 ELSE 0 END AS ordinal FROM part""")
def tls_versions(spark, d):
    spelled = F.element_at(F.array(*[F.lit(v) for v in VERSIONS]), (F.col("p_size") % len(VERSIONS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", scalar.tls_ordinal(spelled).alias("ordinal"))


@query("parsed_values", """WITH e AS (SELECT event_id, props, json_extract_string(props, '$.k')::INT AS k, value FROM events)
  SELECT event_id, k::DOUBLE AS number, CASE WHEN k % 7 = 0 THEN 0 WHEN k % 7 = 1 THEN NULL WHEN k % 7 = 2 THEN NULL ELSE k END::BIGINT AS whole,
    k % 7 IN (3, 4) AS flag, CASE WHEN k % 7 IN (0, 1) THEN '' ELSE 'v' || k END AS word FROM e""")
def parsed_values(spark, d):
    """Tolerant parsing of text values: numbers, counts, flags, words."""
    k = F.get_json_object("props", "$.k")
    kind = k.cast("int") % 7
    count = F.when(kind == 0, "-").when(kind == 1, "").when(kind == 2, F.concat(k, F.lit(".5"))).otherwise(F.concat(k, F.lit(".0")))
    flag = F.when(kind == 3, "T").when(kind == 4, " yes").when(kind == 5, "F")
    word = F.when(kind == 0, " - ").when(kind == 1, F.lit(None)).otherwise(F.concat(F.lit(" v"), k, F.lit("\t")))
    return table(spark, d, "events").select(
        "event_id", scalar.number_or(F.concat(F.lit(" "), k)).alias("number"), scalar.count_value(count).alias("whole"),
        scalar.truthy(flag).alias("flag"), scalar.text(word).alias("word"),
    )


@query("clean_addresses", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.' || user_id % 256 || '.7'
    WHEN 1 THEN '2001:db8::' || CASE WHEN user_id = 0 THEN '' ELSE lower(to_hex(user_id)) END
    WHEN 2 THEN 'host-' || user_id ELSE '' END AS address FROM events""")
def clean_addresses(spark, d):
    user, kind = F.col("user_id"), F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("10.0."), user % 256, F.lit(".7")))
        .when(kind == 1, F.concat(F.lit("2001:0DB8:0:0::"), F.hex(user)))
        .when(kind == 2, F.concat(F.lit("host-"), user)).otherwise(F.lit(" - "))
    )
    return table(spark, d, "events").select("event_id", scalar.clean_ip(raw).alias("address"))


GREASE = [0x0A0A + 0x1010 * i for i in range(16)]


@query("fingerprints", f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      list_filter([l_partkey % 65536, 2570, l_suppkey, 64250], lambda x: x NOT IN ({', '.join(map(str, GREASE))})) AS ciphers FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey,
    md5(concat_ws(',', (768 + l_linenumber)::VARCHAR, array_to_string(ciphers, '-'), '0-23', l_suppkey::VARCHAR, '0')) AS ja3,
    CASE WHEN l_partkey NOT IN ({', '.join(map(str, GREASE))}) THEN md5('771,' || l_partkey || ',') END AS ja3s FROM c""")
def fingerprints(spark, d):
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    whole = lambda *values: F.array(*[F.lit(v).cast("bigint") if isinstance(v, int) else v for v in values])
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        scalar.ja3(768 + F.col("l_linenumber"), whole(part % 65536, 2570, supplier, 64250), whole(0, 23, 6682),
                   whole(supplier), whole(0)).alias("ja3"),
        scalar.ja3s(F.lit(771), part).alias("ja3s"),
    )


@query("quic_candidates", """SELECT event_id::VARCHAR AS uid, TRUE AS is_quic, FALSE AS zero_rtt FROM events
  WHERE event_type IN ('click', 'view') AND json_extract_string(props, '$.k')::INT % 3 = 0""")
def quic_candidates(spark, d):
    conn = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("uid"), micros("ts").alias("ts"),
        F.when(F.col("event_type").isin("click", "view"), "UDP").otherwise("tcp").alias("protocol"),
        F.when(prop_k() % 3 == 0, 443).otherwise(80).alias("dst_port"),
    )
    return enrich.quic_flows(conn).select("uid", "is_quic", "zero_rtt")


def name_queries(spark, d):
    """Views and clicks seen as name queries of their user."""
    k = prop_k()
    name = F.concat_ws(".", F.concat(F.lit("h"), k), F.col("event_type"), F.concat(F.lit("u"), F.col("user_id")), F.lit("lab"))
    kind = F.element_at(F.array(*[F.lit(v) for v in ("1", "AAAA", "txt", "15", "99")]), (k % 5 + 1).cast("int"))
    return dns.dns_events(table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).select(
        F.concat(F.lit("s"), F.col("event_id") % 1000).alias("uid"), F.col("user_id").alias("src_ip"),
        (micros("ts") / F.lit(1e6)).cast("decimal(20,6)").alias("ts"),
        F.when(k % 11 == 0, "-").otherwise(name).alias("query"), kind.alias("qtype"),
    ), clean=scalar.clean_ipv4)


QUERIES_SQL = """q0 AS (SELECT event_id, 's' || event_id % 1000 AS sid, user_id, epoch_us(ts) AS t, json_extract_string(props, '$.k')::INT AS k,
      'h' || json_extract_string(props, '$.k') || '.' || event_type || '.u' || user_id || '.lab' AS name
    FROM events WHERE event_type IN ('view', 'click')),
  q AS (SELECT * FROM q0 WHERE k % 11 <> 0),
  ch AS (SELECT event_id, c, count(*)::DOUBLE AS n FROM (SELECT event_id, unnest(string_split(name, '')) AS c FROM q) GROUP BY event_id, c),
  tot AS (SELECT event_id, n, sum(n) OVER (PARTITION BY event_id) AS total FROM ch),
  ent AS (SELECT event_id, -sum(n / total * log2(n / total)) AS e FROM tot GROUP BY event_id),
  m AS (SELECT q.*, e FROM q JOIN ent USING (event_id))"""
DNS_SQL = """round(avg(e), 6) AS dns_query_entropy, round(avg(length(name)), 6) AS domain_length_mean,
    max(length(name))::DOUBLE AS domain_length_max, 4.0::DOUBLE AS subdomain_count,
    round(avg((k % 5 = 0)::INT), 6) AS dns_record_type_a_ratio, round(avg((k % 5 = 1)::INT), 6) AS dns_record_type_aaaa_ratio,
    round(avg((k % 5 = 2)::INT), 6) AS dns_record_type_txt_ratio, round(avg((k % 5 = 3)::INT), 6) AS dns_record_type_mx_ratio,
    count(*) AS dns_query_count"""


def dns_rounded(df, *keys):
    whole = ("domain_length_max", "subdomain_count", "dns_query_count")
    return df.select(*keys, *[F.col(c) if c in whole else rounded(c) for c in df.columns if c not in keys])


@query("dns_window", f"""WITH {QUERIES_SQL}, f AS (SELECT event_id::VARCHAR AS uid, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase')
  SELECT f.uid, {DNS_SQL} FROM f JOIN m ON m.user_id = f.user_id AND m.t BETWEEN f.t - {W} AND f.t GROUP BY f.uid""")
def dns_window(spark, d):
    """Purchases with the name queries of their user in the day before."""
    purchases = flows(spark, d).filter("dst_ip = 'purchase'")
    return dns_rounded(dns.dns_features(purchases, name_queries(spark, d), window_seconds=DAY), "uid")


@query("dns_window_sliced", ORACLE["dns_window"])
def dns_window_sliced(spark, d):
    """The same where a user's block of queries is too large for one task."""
    purchases = flows(spark, d).filter("dst_ip = 'purchase'")
    return dns_rounded(dns.dns_features(purchases, name_queries(spark, d), window_seconds=DAY, target_rows=5), "uid")


@query("dns_by_uid", f"WITH {QUERIES_SQL} SELECT sid AS uid, {DNS_SQL} FROM m GROUP BY sid")
def dns_by_uid(spark, d):
    return dns_rounded(dns.uid_dns(name_queries(spark, d)), "uid")


BLANKS_SQL = "e' \\t\\n\\r\\x0b\\x0c'"


@query("tls_first_values", f"""WITH c AS (SELECT conv_id::VARCHAR AS uid, turn, role, trim(text, {BLANKS_SQL}) AS v FROM conversations)
  SELECT uid, coalesce(arg_min(v, turn) FILTER (v NOT IN ('', '-')), '') AS ja3_hash,
    coalesce(arg_min(v, turn) FILTER (v NOT IN ('', '-') AND role = 'assistant'), '') AS ja3s_hash,
    arg_min(role, turn) AS cipher_suite, 3.0::DOUBLE AS tls_version, TRUE AS is_tls FROM c GROUP BY uid""")
def tls_first_values(spark, d):
    log = table(spark, d, "conversations").select(
        F.col("conv_id").alias("uid"), F.col("turn").alias("ts"), F.lit("TLSv1.2").alias("version"), F.col("role").alias("cipher"),
        F.col("text").alias("ja3"), F.when(F.col("role") == "assistant", F.col("text")).alias("ja3s"),
    )
    return enrich.tls_features(log).select("uid", "ja3_hash", "ja3s_hash", "cipher_suite", "tls_version", "is_tls")


@query("quic_sizes", """WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings)
  SELECT label::VARCHAR AS uid, bool_or(vec_id % 5 = 0) AS quic_0rtt,
    round(coalesce(avg(v) FILTER (v >= 0), 0), 6) AS quic_pkt_size_mean,
    round(coalesce(stddev_pop(v) FILTER (v >= 0), 0), 6) AS quic_pkt_size_std FROM e GROUP BY label""")
def quic_sizes(spark, d):
    log = table(spark, d, "embeddings").select(
        F.col("label").alias("uid"), F.when(F.col("vec_id") % 5 == 0, "T").otherwise("F").alias("zero_rtt"),
        F.col("embedding").cast("array<double>").alias("packet_sizes"),
    )
    return enrich.quic_features(log).select("uid", "quic_0rtt", rounded("quic_pkt_size_mean"), rounded("quic_pkt_size_std"))


def _side_logs(spark, d):
    """Clicks as TLS sessions, views as QUIC sessions."""
    events = table(spark, d, "events")
    uid = F.col("event_id").cast("string").alias("uid")
    tls = enrich.tls_features(events.filter("event_type = 'click'").select(
        uid, micros("ts").alias("ts"), F.lit("TLSv1.3").alias("version"), F.concat(F.lit("C"), prop_k()).alias("cipher")))
    quic = enrich.quic_features(events.filter("event_type = 'view'").select(
        uid, F.concat_ws(",", prop_k(), F.lit("10")).alias("packet_sizes")))
    return tls, quic


@query("enriched_flows", """SELECT event_id::VARCHAR AS uid, event_type = 'click' AS is_tls,
    CASE WHEN event_type = 'click' THEN 'C' || k ELSE '' END AS cipher_suite,
    CASE WHEN event_type = 'click' THEN 4.0 ELSE 0.0 END::DOUBLE AS tls_version, event_type = 'view' AS is_quic, FALSE AS quic_0rtt,
    CASE WHEN event_type = 'view' THEN (k + 10) / 2.0 ELSE 0.0 END::DOUBLE AS quic_pkt_size_mean,
    0::BIGINT AS dns_query_count, '' AS ja3_hash
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def enriched_flows(spark, d):
    return enrich.enrich(flows(spark, d), None, *_side_logs(spark, d)).select(
        "uid", "is_tls", "cipher_suite", "tls_version", "is_quic", "quic_0rtt", "quic_pkt_size_mean", "dns_query_count", "ja3_hash"
    )


def contract_rows(spark, d):
    """Feature rows of all events before the contract check, some broken on purpose."""
    k, value = prop_k(), F.col("value")
    events = table(spark, d, "events")
    shaped = events.select(
        F.col("event_id").cast("string").alias("uid"), (micros("ts") / F.lit(1e6)).alias("ts"),
        F.col("user_id").cast("string").alias("src_ip"), F.col("event_type").alias("dst_ip"), k.alias("dst_port"),
        F.when(k % 13 == 0, "sctp").when(k % 2 == 0, "tcp").otherwise("udp").alias("protocol"),
        (F.col("event_id") % 65536).cast("int").alias("src_port"),
        (value / 100).alias("duration"),
        F.when(k % 17 == 0, -1).otherwise(F.floor(value)).alias("orig_bytes"),
        F.floor(value / 2).alias("resp_bytes"), (k % 9).cast("bigint").alias("orig_pkts"), (k % 4).cast("bigint").alias("resp_pkts"),
    )
    features = rolling.flow_windows(enrich.with_rates(shaped), DAY)
    return enrich.enrich(features, None, *_side_logs(spark, d), validate=False)


@query("contract_violations", """WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)
  SELECT event_id::VARCHAR AS flow_id, concat_ws(';', CASE WHEN k % 17 = 0 THEN 'invalid orig_bytes' END,
      CASE WHEN k % 13 = 0 THEN 'invalid protocol' END) AS violations FROM e WHERE k % 17 = 0 OR k % 13 = 0""")
def contract_violations(spark, d):
    """Rows that break the durable contract, with their reasons."""
    _, bad = enrich.split_violations(enrich.to_contract(contract_rows(spark, d), "quarantine"))
    return bad.select("flow_id", F.concat_ws(";", F.array_sort("violations")).alias("violations"))


@query("wire_messages", """WITH e AS (SELECT event_id, event_id % 5 AS kind FROM events)
  SELECT CASE kind WHEN 0 THEN 'unicode_decode' WHEN 1 THEN 'json_decode' WHEN 2 THEN 'schema_mismatch' ELSE 'good' END AS outcome,
    count(*) AS n FROM e GROUP BY ALL""")
def wire_messages(spark, d):
    """Encodes rows, damages some of the messages, decodes all of them."""
    decoded = wire.decode(damaged_messages(flows(spark, d)))
    return decoded.groupBy(F.coalesce("error_class", F.lit("good")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("wire_rows", """SELECT event_id::VARCHAR AS flow_id, epoch_us(ts) / 1e6 AS ts, user_id::VARCHAR AS src_ip, event_type AS dst_ip,
    json_extract_string(props, '$.k')::INT AS dst_port, true AS is_tls, false AS is_quic, 0.0::DOUBLE AS iat_std, '' AS ja4_hash, NULL::VARCHAR AS label
  FROM events WHERE event_id % 5 > 2""")
def wire_rows(spark, d):
    """The messages that can be read, with defaults for the fields they leave out."""
    return wire.good_rows(wire.decode(damaged_messages(flows(spark, d)))).select(
        "flow_id", "ts", "src_ip", "dst_ip", "dst_port", "is_tls", "is_quic", "iat_std", "ja4_hash", "label")


@query("dead_letter_rows", """SELECT event_id::VARCHAR AS flow_id, user_id::VARCHAR AS sender,
    ['unicode_decode', 'json_decode', 'schema_mismatch'][event_id % 5 + 1] AS error_class, CASE event_id % 5 WHEN 1 THEN '{{{' ELSE '{"' END AS head
  FROM events WHERE event_id % 5 < 3""")
def dead_letter_rows(spark, d):
    """The messages that can't be read, each with its key and whole payload."""
    letters = wire.dead_letters(wire.decode(damaged_messages(flows(spark, d))))
    text = F.make_valid_utf8(F.col("value").cast("string"))
    return letters.select(
        F.regexp_extract(text, '"flow_id":"([0-9]+)"', 1).alias("flow_id"), F.col("key").cast("string").alias("sender"),
        "error_class", F.regexp_extract("raw", r'\{([{]+|")', 0).alias("head"),
    )


@query("encoded_messages", """SELECT user_id::VARCHAR AS sender, '{"uid":"' || event_id || '","src_ip":"' || user_id || '","dst_ip":"' || event_type
    || '","dst_port":' || coalesce(CASE WHEN k % 5 > 0 THEN k END::VARCHAR, 'null') || '}' AS body
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def encoded_messages(spark, d):
    """Keyed messages, nulls written out."""
    rows = flows(spark, d).withColumn("dst_port", F.when(F.col("dst_port") % 5 > 0, F.col("dst_port")))
    sent = wire.encode(rows, ["uid", "src_ip", "dst_ip", "dst_port"])
    return sent.select(F.col("key").cast("string").alias("sender"), F.col("value").cast("string").alias("body"))


def damaged_messages(rows):
    """(key, value) of flows as contract messages, three in five of them broken in some way."""
    values = {
        "flow_id": F.col("uid"), "protocol": F.lit("tcp"), "ja3_hash": F.lit(""), "ja3s_hash": F.lit(""), "is_tls": F.lit(True),
        **{c: F.col(c) for c in ("ts", "src_ip", "dst_ip", "dst_port")},
    }
    body = F.to_json(F.struct(*[values.get(c, F.lit(1)).alias(c) for c in wire.REQUIRED]))
    kind = F.col("uid").cast("bigint") % 5
    damaged = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("FF")), body.cast("binary")))
        .when(kind == 1, F.concat(F.lit("{{"), body).cast("binary"))
        .when(kind == 2, F.regexp_replace(body, '"dst_ip":"[a-z]+",', "").cast("binary"))
        .otherwise(body.cast("binary"))
    )
    return rows.select(F.col("src_ip").cast("binary").alias("key"), damaged.alias("value"))


@query("top_contributions", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c) DESC, i) AS rank FROM e)
  SELECT vec_id, rank::INT AS rank, 'f' || i AS feature, round(c, 6) AS contribution,
    'f' || i || ': ' || format('{:.4g}', c) || CASE WHEN c >= 0 THEN ' (supports prediction)' ELSE ' (opposes prediction)' END AS evidence
  FROM r WHERE rank <= 5""")
def top_contributions(spark, d):
    """The five strongest components of each vector, as evidence."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    names = [f"f{i}" for i in range(64)]
    top = vectors.select("vec_id", F.posexplode(evidence.top_contributions(F.col("e"), F.col("e"), 5, names)).alias("p", "item"))
    return top.select(
        "vec_id", (F.col("p") + 1).alias("rank"), F.col("item.feature").alias("feature"),
        F.round("item.contribution", 6).alias("contribution"), evidence.evidence_text(F.col("item")).alias("evidence"),
    )


@query("four_digit_numbers", "SELECT event_id, format('{:.4g}', value * 1000) AS short, format('{:.4g}', value / 100000) AS tiny FROM events")
def four_digit_numbers(spark, d):
    return table(spark, d, "events").select(
        "event_id", evidence.g4(F.col("value") * 1000).alias("short"), evidence.g4(F.col("value") / 100000).alias("tiny")
    )


@query("duplicate_keys", "SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return enrich.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey")
