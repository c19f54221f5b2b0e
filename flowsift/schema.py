"""Row contracts, column roles and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names, roles, classes and defaults of the row contract ---

DOUBLE, LONG, INT, BOOL, TEXT = "double", "bigint", "int", "boolean", "string"

FLOW_FIELDS = [
    ("flow_id", TEXT), ("ts", DOUBLE), ("src_ip", TEXT), ("dst_ip", TEXT),
    ("src_port", INT), ("dst_port", INT), ("protocol", TEXT), ("duration", DOUBLE),
    ("packets_per_sec", DOUBLE), ("bytes_per_sec", DOUBLE), ("outbound_inbound_ratio", DOUBLE),
    ("orig_bytes", LONG), ("resp_bytes", LONG), ("orig_pkts", LONG), ("resp_pkts", LONG),
    ("fan_out", DOUBLE), ("fan_in", DOUBLE), ("unique_dst_ips", LONG), ("unique_dst_ports", LONG),
    ("iat_mean", DOUBLE), ("iat_std", DOUBLE), ("iat_min", DOUBLE), ("iat_max", DOUBLE),
    ("connection_frequency", DOUBLE), ("src_ip_entropy", DOUBLE), ("periodicity_score", DOUBLE),
    ("dns_query_entropy", DOUBLE), ("domain_length_mean", DOUBLE), ("domain_length_max", DOUBLE),
    ("subdomain_count", DOUBLE), ("dns_record_type_a_ratio", DOUBLE),
    ("dns_record_type_aaaa_ratio", DOUBLE), ("dns_record_type_txt_ratio", DOUBLE),
    ("dns_record_type_mx_ratio", DOUBLE), ("dns_query_count", LONG),
    ("ja3_hash", TEXT), ("ja3s_hash", TEXT), ("tls_version", DOUBLE), ("cipher_suite", TEXT),
    ("cipher_suite_enc", INT), ("is_tls", BOOL), ("ja4_hash", TEXT),
    ("is_quic", BOOL), ("quic_0rtt", BOOL),
    ("quic_pkt_size_mean", DOUBLE), ("quic_pkt_size_std", DOUBLE), ("label", TEXT),
]

FEATURE_COLUMNS = [
    "packets_per_sec", "bytes_per_sec", "outbound_inbound_ratio",
    "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
    "fan_out", "fan_in", "unique_dst_ips", "unique_dst_ports",
    "iat_mean", "iat_std", "iat_min", "iat_max", "connection_frequency",
    "src_ip_entropy", "periodicity_score",
    "dns_query_entropy", "domain_length_mean", "domain_length_max", "subdomain_count",
    "dns_record_type_a_ratio", "dns_record_type_txt_ratio", "dns_query_count",
    "tls_version", "cipher_suite_enc", "is_tls", "ja4_hash_enc",
    "is_quic", "quic_0rtt", "quic_pkt_size_mean", "quic_pkt_size_std",
    "src_port", "dst_port", "duration",
]

BOOL_COLUMNS = ["is_tls", "is_quic", "quic_0rtt"]

# raw categorical column -> its model-only code
ENCODED_COLUMNS = {"ja4_hash": "ja4_hash_enc", "cipher_suite": "cipher_suite_enc"}

FILL_ZERO_COLUMNS = [
    "dns_query_entropy", "domain_length_mean", "domain_length_max", "subdomain_count",
    "dns_record_type_a_ratio", "dns_record_type_aaaa_ratio", "dns_record_type_txt_ratio",
    "dns_record_type_mx_ratio", "dns_query_count", "tls_version", "cipher_suite_enc",
    "ja4_hash_enc", "quic_pkt_size_mean", "quic_pkt_size_std",
    "iat_std", "iat_min", "iat_max", "periodicity_score",
]

# defaults of optional fields when a wire message leaves them out
WIRE_DEFAULTS = {
    "is_quic": False, "quic_0rtt": False, "quic_pkt_size_mean": 0.0, "quic_pkt_size_std": 0.0,
    "ja4_hash": "", "cipher_suite": "",
    "dns_query_entropy": 0.0, "domain_length_mean": 0.0, "domain_length_max": 0.0,
    "subdomain_count": 0.0, "dns_record_type_a_ratio": 0.0, "dns_record_type_aaaa_ratio": 0.0,
    "dns_record_type_txt_ratio": 0.0, "dns_record_type_mx_ratio": 0.0, "dns_query_count": 0,
    "iat_std": 0.0, "iat_min": 0.0, "iat_max": 0.0, "periodicity_score": 0.0, "label": None,
}

DNS_DEFAULTS = {
    "dns_query_entropy": 0.0, "domain_length_mean": 0.0, "domain_length_max": 0.0,
    "subdomain_count": 0.0, "dns_record_type_a_ratio": 0.0, "dns_record_type_aaaa_ratio": 0.0,
    "dns_record_type_txt_ratio": 0.0, "dns_record_type_mx_ratio": 0.0, "dns_query_count": 0,
}
TLS_DEFAULTS = {
    "ja3_hash": "", "ja3s_hash": "", "ja4_hash": "", "cipher_suite": "",
    "tls_version": 0.0, "is_tls": False,
}
QUIC_DEFAULTS = {
    "is_quic": False, "quic_0rtt": False, "quic_pkt_size_mean": 0.0, "quic_pkt_size_std": 0.0,
}

PROTOCOLS = ["tcp", "udp", "icmp"]

# alphabetical: the position is the model's class index
CLASSES = [
    "benign", "c2_beaconing", "ddos", "dns_anomaly", "exfiltration", "malware_tls", "port_scan",
]
UNKNOWN_ANOMALY = "unknown_anomaly"

SEVERITY_BANDS = [("critical", 0.90), ("high", 0.75), ("medium", 0.50)]
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "info": 1}

WINDOW_SECONDS = 60.0
EPSILON = 1e-9
PERIODICITY_CAP = 100.0
TOP_N_CATEGORIES = 50
IMBALANCE_RATIO = 0.10
F1_TARGET = 0.85

CONN_REQUIRED = [
    "uid", "ts", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p",
    "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
]
# fields whose "-" means zero, so it must survive the log reader
CONN_DASH_FIELDS = ["id.orig_p", "id.resp_p", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"]

DNS_ALIASES = {
    "uid": ["uid"], "src_ip": ["id.orig_h", "src_ip", "source_ip"],
    "ts": ["ts", "timestamp", "time"], "query": ["query", "qname"],
    "qtype": ["qtype_name", "qtype"],
}
TLS_ALIASES = {
    "uid": ["uid"], "version": ["version", "tls_version"], "cipher": ["cipher", "cipher_suite"],
    "ja3": ["ja3", "ja3_hash"], "ja3s": ["ja3s", "ja3s_hash"], "ja4": ["ja4", "ja4_hash"],
}
QUIC_ALIASES = {
    "uid": ["uid"], "zero_rtt": ["quic_0rtt", "0rtt", "zero_rtt", "is_0rtt"],
    "packet_sizes": ["packet_sizes", "pkt_sizes", "packet_size", "pkt_size"],
}

LABEL_REQUIRED = ["scenario", "attack_class", "src_ip", "dst_ip", "pcap"]
LABEL_FIELDS = ["scenario", "attack_class", "src_ip", "dst_ip", "description", "pcap"]

MANIFEST_FIELDS = [
    ("run_id", TEXT), ("attack_scenario", TEXT), ("profile", TEXT), ("pcap_path", TEXT),
    ("zeek_log_dir", TEXT), ("parquet_path", TEXT), ("seed", LONG),
    ("effective_generation_parameters", TEXT), ("pcap_packet_count", LONG),
    ("zeek_uid_count", LONG), ("parquet_row_count", LONG), ("duplicate_flow_id_count", LONG),
]

# --- Spark schemas built from the lists above ---


_TYPES = {
    DOUBLE: T.DoubleType(), LONG: T.LongType(), INT: T.IntegerType(), BOOL: T.BooleanType(),
    TEXT: T.StringType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def _struct(fields) -> T.StructType:
    """Built without a session, which parsing DDL text would need."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


FLOW_COLUMNS = [name for name, _ in FLOW_FIELDS]
FLOW_TYPES = dict(FLOW_FIELDS)
FLOW_SCHEMA = _struct(FLOW_FIELDS)
MANIFEST_SCHEMA = _struct(MANIFEST_FIELDS)
LABEL_SCHEMA = _struct([(name, TEXT) for name in LABEL_FIELDS])

ALERT_SCHEMA = _struct([
    ("id", TEXT), ("timestamp", "timestamp"), ("ingested_at", "timestamp"), ("flow_id", TEXT),
    ("src_ip", TEXT), ("dst_ip", TEXT), ("src_port", INT), ("dst_port", INT),
    ("protocol", TEXT), ("duration", DOUBLE), ("threat_class", TEXT), ("severity", TEXT),
    ("confidence", DOUBLE), ("anomaly_score", DOUBLE), ("evidence", "array<string>"),
    ("ja3_hash", TEXT), ("ja4_hash", TEXT), ("is_quic", BOOL), ("quic_0rtt", BOOL),
    ("kill_chain_id", TEXT),
])
RESULT_COLUMNS = [
    "flow_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "threat_class", "confidence", "anomaly_score", "evidence", "latency_ms", "consumer_ts",
]
