"""DNS statistics per flow: events of the source shortly before it, or events of its uid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scalar import char_entropy, clean_ip, dns_qtype, label_count, number, required, text, ticks
from flowsift.operators.running import per_temperature, plan_slices, running
from flowsift.schema import DNS_ALIASES, WINDOW_SECONDS
from flowsift.sources.columns import optional, resolve

MICROS = 1_000_000
# per-event measures and how they fold
MEASURES = {
    "_queries": "sum", "_entropy": "sum", "_length": "sum", "_labels": "sum",
    "_a": "sum", "_aaaa": "sum", "_txt": "sum", "_mx": "sum", "_longest": "max",
}


def dns_events(log: DataFrame, clean=clean_ip, mode: str = "quarantine") -> DataFrame:
    """(uid, src_ip, ts, query, qtype) from any log that carries the aliased columns.

    Addresses get the canonical form that flows have. mode "strict": a bad time ends the job; else it
    is null, and the event counts for its uid only.
    """
    found = resolve(log, DNS_ALIASES, ["uid", "src_ip", "ts", "query"])
    return log.select(
        text(found["uid"]).alias("uid"),
        clean(found["src_ip"]).alias("src_ip"),
        (required(number(found["ts"]), "invalid required value: dns ts") if mode == "strict"
         else number(found["ts"])).alias("ts"),
        text(found["query"]).alias("query"),
        dns_qtype(optional(found["qtype"])).alias("qtype"),
    )


def measured(events: DataFrame) -> DataFrame:
    """One row per non-blank query, measured once, before any copying or shuffling."""
    one = F.lit(1).cast("bigint")

    def is_type(name: str) -> Column:
        return (F.col("qtype") == name).cast("bigint")

    return events.filter("query <> ''").select(
        "uid", "src_ip", ticks("ts").alias("_t"),
        one.alias("_queries"),
        char_entropy("query").alias("_entropy"),
        F.length("query").cast("bigint").alias("_length"),
        label_count("query").cast("bigint").alias("_labels"),
        is_type("A").alias("_a"), is_type("AAAA").alias("_aaaa"),
        is_type("TXT").alias("_txt"), is_type("MX").alias("_mx"),
        F.length("query").cast("bigint").alias("_longest"),
    )


def _features() -> list[Column]:
    n = F.col("_queries")

    def per_query(total: str) -> Column:
        return F.when(n > 0, F.col(total) / n).otherwise(F.lit(0.0))

    return [
        per_query("_entropy").alias("dns_query_entropy"),
        per_query("_length").alias("domain_length_mean"),
        F.coalesce(F.col("_longest").cast("double"), F.lit(0.0)).alias("domain_length_max"),
        per_query("_labels").alias("subdomain_count"),
        per_query("_a").alias("dns_record_type_a_ratio"),
        per_query("_aaaa").alias("dns_record_type_aaaa_ratio"),
        per_query("_txt").alias("dns_record_type_txt_ratio"),
        per_query("_mx").alias("dns_record_type_mx_ratio"),
        F.coalesce(n, F.lit(0)).cast("bigint").alias("dns_query_count"),
    ]


def features_of_measures(folded: DataFrame) -> DataFrame:
    """uid and its statistics from folded measures."""
    return folded.select("uid", *_features())


def source_window_dns(flows: DataFrame, events: DataFrame, window_seconds: float = WINDOW_SECONDS,
                      target_rows: int | None = None) -> DataFrame:
    """Per flow uid: statistics of the source's queries with 0 <= flow.ts - query.ts <= window.

    No pairs are formed. Time is cut into blocks one window long, so the window ending at a
    flow is the tail of the previous block plus the head of the flow's own block. Each flow
    asks two questions: the running fold up to its ts in its own block, and the fold from
    ts - window to the end of the previous block (the same scan, run backwards). Folds only
    add up, so float sums lose nothing and max needs no special case. Rows are keyed by
    (source, block): a busy source spreads over its blocks, and a block above the row target
    is sliced further. Flows without queries do not appear in the result.
    """
    window = round(window_seconds * MICROS)
    block = F.floor(F.col("_t") / F.lit(window))
    measures = [F.col(c) for c in MEASURES]
    blank = [F.lit(None).cast("double" if c == "_entropy" else "bigint").alias(c) for c in MEASURES]

    queries = measured(events)
    # the head scan runs forward, the tail scan backward: position orders both ascending
    asked_of = F.explode(F.array(
        F.struct(F.lit("head").alias("_scan"), F.col("_t").alias("_at")),
        F.struct(F.lit("tail").alias("_scan"), (-F.col("_t")).alias("_at")),
    ))
    event_rows = queries.select(
        "src_ip", block.alias("_block"), *measures, asked_of.alias("_x")
    ).select("src_ip", "_block", "_x.*", F.lit(0).alias("_asks"), F.lit(None).cast("string").alias("uid"), *MEASURES)

    flow_at = flows.select("uid", "src_ip", ticks("ts").alias("_t"))
    question = F.explode(F.array(
        F.struct(block.alias("_block"), F.lit("head").alias("_scan"), F.col("_t").alias("_at")),
        F.struct((block - 1).alias("_block"), F.lit("tail").alias("_scan"),
                 (F.lit(window) - F.col("_t")).alias("_at")),
    ))
    flow_rows = flow_at.select("uid", "src_ip", question.alias("_x")).select(
        "src_ip", "_x.*", F.lit(1).alias("_asks"), F.col("uid").cast("string").alias("uid"), *blank
    )
    rows = event_rows.unionByName(flow_rows)

    keys = ["src_ip", "_block", "_scan"]
    folds = {f"_r{c}": (kind, F.col(c)) for c, kind in MEASURES.items()}
    slicing = plan_slices(rows, keys, "_at", target_rows)
    scanned = per_temperature(
        rows, slicing, lambda part, cut: running(part, keys, ["_at", "_asks"], folds, cut)
    )
    answered = scanned.filter("_asks = 1 and _r_queries > 0")
    merged = answered.groupBy("uid").agg(
        *[(F.max if kind == "max" else F.sum)(f"_r{c}").alias(c) for c, kind in MEASURES.items()]
    )
    return features_of_measures(merged)


def uid_dns(events: DataFrame) -> DataFrame:
    """Per non-blank uid: statistics of all queries with that uid, whatever their time."""
    totals = measured(events).filter("uid <> ''").groupBy("uid").agg(
        *[(F.max if kind == "max" else F.sum)(c).alias(c) for c, kind in MEASURES.items()]
    )
    return features_of_measures(totals)


def dns_features(flows: DataFrame, events: DataFrame, mode: str = "source_window",
                 window_seconds: float = WINDOW_SECONDS, target_rows: int | None = None) -> DataFrame:
    """Per-uid DNS statistics.

    mode "source_window": the source's queries in the window before the flow.
    mode "uid_first": queries with the flow's uid; flows without uid fall back to the window.
    """
    if mode == "source_window":
        return source_window_dns(flows, events, window_seconds, target_rows)
    if mode == "uid_first":
        blank = flows.filter("uid = ''")
        return uid_dns(events).unionByName(source_window_dns(blank, events, window_seconds, target_rows))
    raise ValueError(f"unknown DNS mode: {mode}")


