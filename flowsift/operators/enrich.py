"""TLS and QUIC aggregates per uid, enrichment joins, and the durable row contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scalar import (
    clean_ip, count_of, count_value, event_time, number, number_of, number_or, packet_sizes, required, safe_divide,
    text, tls_ordinal, truthy, truthy_number,
)
from flowsift.schema import (
    CONN_REQUIRED, DNS_DEFAULTS, FLOW_COLUMNS, FLOW_TYPES, PROTOCOLS, QUIC_ALIASES,
    QUIC_DEFAULTS, TLS_ALIASES, TLS_DEFAULTS,
)
from flowsift.sources.columns import optional, resolve

VIOLATIONS = "violations"


def first_text(value: Column, order: Column) -> Column:
    """First non-empty text of a group in the given order, '' when there is none."""
    cleaned = text(value)
    return F.coalesce(F.min_by(F.when(cleaned != "", cleaned), F.when(cleaned != "", order)), F.lit(""))


def tls_features(log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per uid: first non-empty fingerprint, version and cipher.

    order: columns that give the row order of the log; by default the position columns the
    log reader adds, else ts.
    """
    found = resolve(log, TLS_ALIASES, ["uid"])
    by = F.struct(*[F.col(c) for c in order or _position(log)])
    first = {name: first_text(optional(found[name]), by) for name in ("version", "cipher", "ja3", "ja3s", "ja4")}
    return log.groupBy(text(found["uid"]).alias("uid")).agg(
        first["ja3"].alias("ja3_hash"),
        first["ja3s"].alias("ja3s_hash"),
        first["ja4"].alias("ja4_hash"),
        tls_ordinal(first["version"]).cast("double").alias("tls_version"),
        first["cipher"].alias("cipher_suite"),
        F.lit(True).alias("is_tls"),
    )


def _position(log: DataFrame) -> list[str]:
    named = [c for c in ("_file", "_block", "_line") if c in log.columns]
    return named or [c for c in log.columns if c in ("ts", "timestamp", "time")] or log.columns[:1]


def quic_features(log: DataFrame) -> DataFrame:
    """Per uid: any 0-RTT, mean and population deviation of the packet sizes of all its rows."""
    found = resolve(log, QUIC_ALIASES, ["uid"])
    zero_rtt, raw_sizes = found["zero_rtt"], found["packet_sizes"]
    kind = None if zero_rtt is None else log.select(zero_rtt).schema[0].dataType.typeName()
    early = (
        F.lit(False) if zero_rtt is None
        else truthy_number(zero_rtt) if kind in ("double", "float", "integer", "long")
        else truthy(zero_rtt)
    )
    listed = raw_sizes is not None and log.select(raw_sizes).schema[0].dataType.typeName() == "array"
    if raw_sizes is None:
        sizes = F.array().cast("array<double>")
    elif listed:
        sizes = F.filter(F.transform(raw_sizes, lambda v: number(v)), lambda v: v >= 0)
    else:
        sizes = packet_sizes(raw_sizes)
    rows = log.select(
        text(found["uid"]).alias("uid"), early.alias("_early"), F.explode_outer(sizes).alias("_size")
    )
    return rows.groupBy("uid").agg(
        F.lit(True).alias("is_quic"),
        F.bool_or("_early").alias("quic_0rtt"),
        F.coalesce(F.avg("_size"), F.lit(0.0)).alias("quic_pkt_size_mean"),
        F.coalesce(F.stddev_pop("_size"), F.lit(0.0)).alias("quic_pkt_size_std"),
    )


def quic_flows(conn: DataFrame) -> DataFrame:
    """Flows that look like QUIC from the connection log alone: UDP to port 443."""
    return conn.filter((F.lower("protocol") == "udp") & (F.col("dst_port") == 443)).select(
        "uid", "ts", F.lit(True).alias("is_quic"), F.lit(False).alias("zero_rtt")
    )


def normalise_conn(log: DataFrame, mode: str = "strict", ip=clean_ip) -> DataFrame:
    """Typed flows from a text connection log.

    mode "strict": a bad value ends the job. mode "quarantine": every row stays and carries
    the array column `violations`, empty for good rows.
    """
    missing = [c for c in CONN_REQUIRED if c not in log.columns]
    if missing:
        raise ValueError("conn log is missing required columns: " + ", ".join(missing))
    counts = {
        "src_port": "id.orig_p", "dst_port": "id.resp_p", "orig_bytes": "orig_bytes",
        "resp_bytes": "resp_bytes", "orig_pkts": "orig_pkts", "resp_pkts": "resp_pkts",
    }
    raw = {name: F.col(f"`{name}`") for name in log.columns}
    proto = F.lower(F.trim(F.coalesce(raw["proto"].cast("string"), F.lit("")))) if "proto" in raw else F.lit("")
    parsed = {"ts": number(raw["ts"]), **{name: count_value(raw[source]) for name, source in counts.items()}}
    if mode == "strict":
        parsed = {name: required(value, f"invalid required value: {name}") for name, value in parsed.items()}
    names = ["uid", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "duration", "orig_bytes",
             "resp_bytes", "orig_pkts", "resp_pkts"]
    selected = [c.alias(n) for n, c in zip(names, _typed(raw, parsed, proto, ip))]
    if mode == "strict":
        return log.select(*selected)
    # the reader's mark of lines that don't fit their header
    torn = F.col("_malformed") if "_malformed" in log.columns else F.lit(False)
    found = log.select(*selected, torn.alias("_torn"))
    bad = F.filter(
        F.array(F.when(F.col("_torn"), F.lit("malformed line")),
                *[F.when(F.col(name).isNull(), F.lit(f"invalid {name}")) for name in parsed]),
        lambda v: v.isNotNull(),
    )
    return found.withColumn(VIOLATIONS, bad).drop("_torn")


def _typed(raw, parsed, proto, ip) -> list[Column]:
    return [
        F.coalesce(raw["uid"].cast("string"), F.lit("")), parsed["ts"], ip(raw["id.orig_h"]), ip(raw["id.resp_h"]),
        parsed["src_port"].cast("int"), parsed["dst_port"].cast("int"), proto,
        F.greatest(number_or(raw["duration"]), F.lit(0.0)),
        *[parsed[c] for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")],
    ]


def mark_duplicates(flows: DataFrame, key: str = "uid") -> DataFrame:
    """Adds a violation to every row whose key other rows without violations have too."""
    twice = duplicate_keys(flows.filter(F.size(VIOLATIONS) == 0), key).select(F.col(key).alias("_key"))
    return flows.join(twice, F.col(key) == F.col("_key"), "left").withColumn(
        VIOLATIONS, F.when(F.col("_key").isNotNull() & (F.size(VIOLATIONS) == 0), F.array(F.lit(f"duplicate {key}")))
        .otherwise(F.col(VIOLATIONS))).drop("_key")


def with_rates(flows: DataFrame) -> DataFrame:
    return flows.select(
        "*",
        safe_divide("orig_pkts", "duration").alias("packets_per_sec"),
        safe_divide("orig_bytes", "duration").alias("bytes_per_sec"),
        safe_divide("orig_bytes", F.col("resp_bytes") + 1.0).alias("outbound_inbound_ratio"),
    )


def duplicate_keys(df: DataFrame, key: str = "uid") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def assert_unique(df: DataFrame, key: str = "uid", what: str = "rows") -> None:
    """One extra aggregation; at most five examples come to the driver."""
    examples = duplicate_keys(df, key).limit(5).collect()
    if examples:
        raise ValueError(f"{what} contain duplicate {key}: " + ", ".join(str(r[0]) for r in examples))


def enrich(flows: DataFrame, dns: DataFrame | None = None, tls: DataFrame | None = None,
           quic: DataFrame | None = None, validate: bool = True) -> DataFrame:
    """Left-joins per-uid features; one row per flow, defaults where nothing matched.

    Each side is unique per uid by construction, so no join multiplies rows; all of them
    share the hash(uid) partitioning of the flows.
    """
    if validate:
        assert_unique(flows, "uid", "flows")
    out = flows
    for side, defaults in ((dns, DNS_DEFAULTS), (tls, TLS_DEFAULTS), (quic, QUIC_DEFAULTS)):
        if side is None:
            out = out.select("*", *[_default(c, v).alias(c) for c, v in defaults.items()])
            continue
        joined = out.join(side.select("uid", *defaults), "uid", "left")
        out = joined.select(
            *[F.col(c) for c in out.columns],
            *[F.coalesce(F.col(c).cast(FLOW_TYPES[c]), _default(c, v)).alias(c) for c, v in defaults.items()],
        )
    return out


def _default(name: str, value) -> Column:
    return F.lit(value).cast(FLOW_TYPES[name])


def to_contract(rows: DataFrame, mode: str = "strict") -> DataFrame:
    """The durable 47-column row, typed and checked.

    mode "quarantine" keeps bad rows and adds `violations`; see split_violations.
    """
    if "uid" not in rows.columns:
        raise ValueError("feature rows are missing uid")
    extra = {"cipher_suite_enc": F.lit(0), "label": F.lit(None).cast("string"), "flow_id": F.col("uid")}
    have = {c: F.col(c) for c in rows.columns}
    have.update({c: v for c, v in extra.items() if c == "flow_id" or c not in have})
    missing = [c for c in FLOW_COLUMNS if c not in have]
    if missing:
        raise ValueError("feature rows are missing required fields: " + ", ".join(missing))

    problems, typed = [], []
    for name in FLOW_COLUMNS:
        kind, value = FLOW_TYPES[name], have[name]
        is_bool = name in rows.columns and rows.schema[name].dataType.typeName() == "boolean"
        if name == "label":
            out = F.when(value.isNotNull(), text(value))
        elif kind == "string":
            out = text(value)
        elif kind == "boolean":
            out = F.coalesce(value, F.lit(False)) if is_bool else truthy(value)
        elif kind in ("int", "bigint"):
            out = (count_of(rows, name) if name in rows.columns else value).cast(kind)
            problems.append(F.when(out.isNull(), F.lit(f"invalid {name}")))
        else:
            out = number_of(rows, name)
            problems.append(F.when(out.isNull(), F.lit(f"invalid {name}")))
        typed.append(out.alias(name))
    for name in ("flow_id", "src_ip", "dst_ip", "protocol"):
        problems.append(F.when(text(have[name]) == "", F.lit(f"invalid {name}")))
    problems.append(F.when(~have["protocol"].isin(*PROTOCOLS), F.lit("invalid protocol")))
    found = F.array_distinct(F.filter(F.array(*problems), lambda v: v.isNotNull()))

    checked = rows.select(*typed, found.alias(VIOLATIONS))
    if mode == "quarantine":
        return checked
    # a filter holds whatever columns are read later
    refused = F.raise_error(F.concat(F.lit("feature row rejected: "), F.array_join(VIOLATIONS, ", "))).cast("boolean")
    return checked.filter(F.when(F.size(VIOLATIONS) > 0, refused).otherwise(F.lit(True))).drop(VIOLATIONS)


def split_violations(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the violations column, rejected rows with it)."""
    return checked.filter(F.size(VIOLATIONS) == 0).drop(VIOLATIONS), checked.filter(F.size(VIOLATIONS) > 0)


def with_event_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_time", event_time("ts"))
