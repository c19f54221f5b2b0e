"""Alert table: building, searching, statistics, correlation into kill chains.

`now` and `since` are always parameters, so a result depends on the data alone.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scalar import event_time, severity_name, severity_rank
from flowsift.operators.joins import lookup_join
from flowsift.operators.ordering import first_in_groups, page, page_info
from flowsift.schema import ALERT_SCHEMA

BUCKET_SECONDS = 300
STAGE_LIMIT = 20
LOOKBACK = timedelta(minutes=10)

STAGE_FIELDS = [
    "alert_id", "timestamp", "threat_class", "severity", "confidence", "dst_ip", "dst_port", "evidence",
]


def to_alerts(scored: DataFrame, ingested_at: Column) -> DataFrame:
    """Alert rows of every verdict that is not benign.

    The id is a hash of the flow id, so writing a flow twice yields the same alert.
    """
    made = {
        "id": F.concat(F.lit("al-"), F.md5("flow_id")),
        "timestamp": event_time("ts"),
        "ingested_at": ingested_at,
        "evidence": F.coalesce(F.col("evidence"), F.array().cast("array<string>")),
        "kill_chain_id": F.lit(None),
    }
    return scored.filter("threat_class <> 'benign'").select(
        *[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ALERT_SCHEMA.fields]
    )


def flatten_alerts(alerts: DataFrame) -> DataFrame:
    """The twenty public fields; a missing evidence list is empty, a missing port 0."""
    return alerts.select(
        *[f.name for f in ALERT_SCHEMA.fields if f.name not in ("evidence", "dst_port", "src_port")],
        F.coalesce("src_port", F.lit(0)).alias("src_port"),
        F.coalesce("dst_port", F.lit(0)).alias("dst_port"),
        F.coalesce(F.col("evidence"), F.array().cast("array<string>")).alias("evidence"),
    )


def tokens(value: Column) -> Column:
    """Case-folded words: runs of letters, digits and underscores."""
    words = F.split(F.lower(value), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: w != "")


def evidence_matches(document: Column, query: str, mode: str = "token") -> Column:
    """mode "token": any word of the query occurs; "substring": the query occurs as text."""
    if mode == "token":
        return F.arrays_overlap(tokens(document), tokens(F.lit(query)))
    if mode == "substring":
        return F.contains(F.lower(document), F.lower(F.lit(query)))
    raise ValueError(f"unknown evidence mode: {mode}")


def filter_alerts(alerts: DataFrame, severity: str | None = None, threat_class: str | None = None,
                  src_ip: str | None = None, since: datetime | None = None, until: datetime | None = None,
                  evidence: str | None = None, evidence_mode: str = "token") -> DataFrame:
    """All given conditions hold; both time bounds are inclusive.

    Plain comparisons on plain columns, so they reach the Parquet scan.
    """
    out = alerts
    for column, wanted in (("severity", severity), ("threat_class", threat_class), ("src_ip", src_ip)):
        if wanted is not None:
            out = out.filter(F.col(column) == wanted)
    if since is not None:
        out = out.filter(F.col("timestamp") >= F.lit(since))
    if until is not None:
        out = out.filter(F.col("timestamp") <= F.lit(until))
    if evidence:
        out = out.filter(evidence_matches(F.concat_ws(" ", "evidence"), evidence, evidence_mode))
    return out


def alert_page(alerts: DataFrame, number: int = 1, size: int = 20, **conditions) -> tuple[DataFrame, DataFrame]:
    """(rows newest first, one row of totals)."""
    hits = filter_alerts(alerts, **conditions)
    return page(hits, [F.desc("timestamp"), F.asc("id")], number, size), page_info(hits, number, size)


def alert_by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    """The alert, or no row."""
    return alerts.filter(F.col("id") == alert_id)


def _counts(alerts: DataFrame, column: str, limit: int | None) -> DataFrame:
    counted = alerts.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column))
    return counted.limit(limit) if limit else counted


def count_by_class(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    return _counts(alerts, "threat_class", limit)


def count_by_severity(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    return _counts(alerts, "severity", limit)


def top_sources(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return _counts(alerts, "src_ip", limit)


def recent(alerts: DataFrame, now: datetime, hours: float = 1.0) -> DataFrame:
    """The look-back of the statistics goes by ingestion time."""
    return alerts.filter(F.col("ingested_at") >= F.lit(now - timedelta(hours=hours)))


def timeline(alerts: DataFrame, since: datetime, now: datetime,
             bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Alerts per bucket of ingestion time, empty buckets from since to now included."""
    step = F.lit(bucket_seconds)
    start = F.floor(F.unix_seconds(F.col("ingested_at")) / step) * step
    counts = alerts.groupBy(start.alias("_start")).agg(F.count(F.lit(1)).alias("n"))

    def edge(moment: datetime) -> Column:
        return F.floor(F.unix_seconds(F.lit(moment).cast("timestamp")) / step) * step

    spark = alerts.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(edge(since), edge(now), step)).alias("_start"))
    # a full join: alerts outside [since, now] still get their bucket
    return grid.join(counts, "_start", "full").select(
        F.timestamp_seconds("_start").alias("bucket"), F.coalesce("n", F.lit(0)).alias("n")
    )


def alert_stats(alerts: DataFrame, now: datetime, hours: float = 1.0) -> dict[str, DataFrame]:
    hits = recent(alerts, now, hours)
    return {
        "total": hits.agg(F.count(F.lit(1)).alias("total_alerts")),
        "by_threat_class": count_by_class(hits),
        "by_severity": count_by_severity(hits),
        "timeline": timeline(hits, now - timedelta(hours=hours), now),
        "top_src_ips": top_sources(hits),
    }


def correlate(alerts: DataFrame, now: datetime, lookback: timedelta = LOOKBACK,
              min_classes: int = 2, max_alerts: int | None = None) -> DataFrame:
    """(id, src_ip, kill_chain_id) of the alerts that get a chain id in this cycle.

    A source whose alerts of the look-back show enough different classes forms a chain. Its
    oldest existing id is kept; a new one is a hash of the source and its first alert, so a
    repeated cycle gives the same id. Sources are summed up map-side; what is joined back is
    one row per chain. max_alerts looks at the oldest alerts of the look-back only; by default
    all count.
    """
    seen = alerts.filter(
        (F.col("ingested_at") >= F.lit(now - lookback))
        & (F.col("threat_class") != "benign")
        & (F.coalesce(F.col("src_ip"), F.lit("")) != "")
    ).select("id", "src_ip", "threat_class", "kill_chain_id", "ingested_at")
    if max_alerts:
        seen = seen.orderBy("ingested_at", "id").limit(max_alerts)
    tagged = F.coalesce(F.col("kill_chain_id"), F.lit("")) != ""
    arrival = F.struct("ingested_at", "id")
    per_source = seen.groupBy("src_ip", "threat_class").agg(
        F.min(F.when(tagged, F.struct("ingested_at", "id", "kill_chain_id"))).alias("_tag"),
        F.min(arrival).alias("_first"),
    ).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("_classes"), F.min("_tag").alias("_tag"), F.min("_first").alias("_first")
    )
    fresh = F.concat(F.lit("kc-"), F.md5(F.concat_ws("|", "src_ip", "_first.id")))
    chains = per_source.filter(F.col("_classes") >= min_classes).select(
        "src_ip", F.coalesce(F.col("_tag.kill_chain_id"), fresh).alias("_chain")
    )
    untagged = seen.filter(~tagged).select("id", "src_ip")
    return lookup_join(untagged, chains, "src_ip", "inner", row_id="id").select(
        "id", "src_ip", F.col("_chain").alias("kill_chain_id")
    )


def write_back(alerts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Alerts with newly assigned chain ids; existing ids stay."""
    new = assignments.select("id", F.col("kill_chain_id").alias("_new"))
    joined = alerts.join(new, "id", "left")
    kept = F.when(F.coalesce(F.col("kill_chain_id"), F.lit("")) != "", F.col("kill_chain_id"))
    return joined.select(
        *[F.coalesce(kept, F.col("_new")).alias(c) if c == "kill_chain_id" else F.col(c) for c in alerts.columns]
    )


def chained(alerts: DataFrame, since: datetime | None) -> DataFrame:
    """Alerts of a chain; the look-back of chains goes by event time."""
    tagged = alerts.filter(F.col("kill_chain_id").isNotNull())
    return tagged if since is None else tagged.filter(F.col("timestamp") >= F.lit(since))


def chain_stages(alerts: DataFrame, since: datetime | None = None, limit: int | None = None) -> DataFrame:
    """The stages of each chain in time order, one row per stage; only the first `limit` if given."""
    ranked = first_in_groups(
        chained(alerts, since), ["kill_chain_id"], [F.asc("timestamp"), F.asc("id")], limit, "stage"
    )
    return ranked.withColumnRenamed("kill_chain_id", "chain_id").withColumnRenamed("id", "alert_id")


def chain_summary(alerts: DataFrame, since: datetime | None = None, min_stages: int = 1) -> DataFrame:
    """One row per chain over all its alerts: no stage is left out of count or severity."""
    return chained(alerts, since).groupBy(F.col("kill_chain_id").alias("chain_id")).agg(
        F.min_by("src_ip", F.struct("timestamp", "id")).alias("src_ip"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("stage_count"),
        severity_name(F.max(severity_rank("severity"))).alias("max_severity"),
    ).filter(F.col("stage_count") >= min_stages)


def kill_chains(alerts: DataFrame, since: datetime | None = None, stages: int | None = None,
                max_chains: int | None = None, min_stages: int = 1) -> DataFrame:
    """Chains, latest activity first, each with its stages as a nested list, or the first ones if capped.

    A chain that may outgrow one row is better read as rows of chain_stages.
    """
    summary = chain_summary(alerts, since, min_stages)
    first = chain_stages(alerts, since, stages).groupBy("chain_id").agg(
        F.array_sort(F.collect_list(F.struct("stage", *STAGE_FIELDS))).alias("_staged")
    )
    nested = F.transform("_staged", lambda s: F.struct(*[s[f].alias(f) for f in STAGE_FIELDS]))
    out = summary.join(first, "chain_id").select(*summary.columns, nested.alias("stages"))
    order = [F.desc("last_seen"), F.asc("chain_id")]
    return out.orderBy(*order).limit(max_chains) if max_chains else out.orderBy(*order)


def stage_alerts(stages: DataFrame, alerts: DataFrame) -> DataFrame:
    """Drill-down: the full alert behind each stage."""
    return stages.select("chain_id", "stage", "alert_id").join(alerts, F.col("alert_id") == F.col("id")).drop("alert_id")
