"""The alert table on disk: alerts by ingest hour, an index of evidence words, and a feed cut into pages.

Alerts lie under hour=H/batch=N (hours since 1970, UTC; where alerts are few, a folder can span several hours and
goes by its first: `hours`, the same for all who write and read a table), so a repeated batch leaves the same files, a look-back
reads its hours only, write-back rewrites the hours whose alerts changed, and retention drops folders.
Postings (word, hour, id) lie under bucket=B/day=D/batch=N, sorted by word: a search reads the buckets of its words,
and of these the row groups that may hold them; days keep the number of small files low. The feed is range partitioned in page order with the rows before each
part, so any page is read from the parts it overlaps.

Defined results: alerts without an ingest time lie under an hour of their own, which look-backs and
retention leave alone; alerts without evidence have no postings; repeated rows stay rows of their own.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from flowsift.operators.alerts import LOOKBACK, correlate, tokens, write_back
from flowsift.operators.steps import stored
from flowsift.schema import ALERT_SCHEMA
from flowsift.streaming.store import drop_numbers_below

BUCKETS = 16
PART_ROWS = 100_000
MAX_PARTS = 2_000
PLACES = [StructField("hour", LongType()), StructField("batch", LongType())]
TABLE_SCHEMA = StructType([*ALERT_SCHEMA.fields, *PLACES])
POSTING_SCHEMA = StructType([StructField("token", StringType()), StructField("id", StringType()),
                             StructField("hour", LongType()), StructField("bucket", IntegerType()),
                             StructField("day", LongType()), StructField("batch", LongType())])
INDEX_SCHEMA = "part int, before bigint, n bigint"


def hour_of(time: str | Column, hours: int = 1) -> Column:
    return (F.floor(F.unix_seconds(time) / (3600 * hours)) * hours).cast("bigint")


def _hour(moment: datetime, spark: SparkSession, hours: int) -> int:
    """The hour of a moment, read in the session's zone like every other literal."""
    return spark.range(1).select(hour_of(F.lit(moment).cast("timestamp"), hours)).first()[0]


def _write(rows: DataFrame, folder: str, places: list[str], order: list[str]) -> None:
    # rebalanced, so a busy hour is split over tasks and a quiet one is one file
    (rows.hint("rebalance", *places).sortWithinPartitions(*places, *order).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*places).parquet(folder))


def _typed() -> list[Column]:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in ALERT_SCHEMA.fields]


def write_alerts(alerts: DataFrame, folder: str, batch: int = 0, hours: int = 1) -> None:
    """Adds the alerts of a batch, or puts them in place of what the same batch wrote to these hours before."""
    placed = alerts.select(
        *_typed(), hour_of("ingested_at", hours).alias("hour"), F.lit(batch).cast("bigint").alias("batch"))
    _write(placed, folder, ["hour", "batch"], ["id"])


def read_alerts(spark: SparkSession, folder: str, since: datetime | None = None, hours: int = 1) -> DataFrame:
    """Alerts with their hour and batch; since: those ingested from then on, from the hours that may hold them."""
    rows = spark.read.schema(TABLE_SCHEMA).parquet(folder)
    if since is None:
        return rows
    return rows.filter((F.col("hour") >= _hour(since, spark, hours)) & (F.col("ingested_at") >= F.lit(since)))


def correlate_table(spark: SparkSession, folder: str, now: datetime, lookback: timedelta = LOOKBACK,
                    min_classes: int = 2, hours: int = 1) -> list[int]:
    """A correlation cycle on the table: rewrites the hours whose alerts got a chain id and returns them."""
    recent = read_alerts(spark, folder, now - lookback, hours)
    assigned = stored(correlate(recent, now, lookback, min_classes), "assigned")
    # hours of a look-back, few by its length
    changed = [r[0] for r in recent.join(assigned, "id", "left_semi").select("hour").distinct().collect()]
    if changed:
        touched = spark.read.schema(TABLE_SCHEMA).parquet(folder).filter(F.col("hour").isin(changed))
        # kept elsewhere first: rows are never in the table's own files alone while those are replaced
        _write(stored(write_back(touched, assigned), "touched"), folder, ["hour", "batch"], ["id"])
    return sorted(changed)


def retain(spark: SparkSession, folder: str, since: datetime, postings: str | None = None, hours: int = 1) -> int:
    """Drops the hours that ended before `since`, and the days of the postings that did; returns how many hours.

    Postings of a day's dropped hours stay until the day is over; a search meets no alert for them.
    """
    least = _hour(since, spark, hours)
    if postings:
        for bucket in range(BUCKETS):
            drop_numbers_below(spark, f"{postings}/bucket={bucket}", "day", least // 24)
    return len(drop_numbers_below(spark, folder, "hour", least))


def bucket_of(token: str | Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def write_postings(rows: DataFrame, folder: str, text: Column, batch: int = 0) -> None:
    """One row per word and (id, hour) of rows; a batch written again replaces what it wrote before."""
    words = rows.select(F.explode(F.array_distinct(tokens(text))).alias("token"), F.col("id").cast("string").alias("id"),
                        "hour", F.lit(batch).cast("bigint").alias("batch"))
    placed = words.withColumn("bucket", bucket_of("token")).withColumn("day", F.floor(F.col("hour") / 24).cast("bigint"))
    _write(placed.select(*POSTING_SCHEMA.names), folder, ["bucket", "day", "batch"], ["token", "id"])


def index_evidence(alerts: DataFrame, folder: str, batch: int = 0, hours: int = 1) -> None:
    placed = alerts.withColumn("hour", hour_of("ingested_at", hours))
    write_postings(placed, folder, F.concat_ws(" ", "evidence"), batch)


def find(spark: SparkSession, postings: str, query: str, match: str = "any", since: datetime | None = None,
         hours: int = 1) -> DataFrame:
    """(hour, id) of the rows that hold any word of the query, or all of them; a query without words finds none.

    For all words, the rarest one's rows are narrowed by the next rare one's.
    """
    if match not in ("any", "all"):
        raise ValueError(f"unknown match: {match}")
    # one row: the query's own words and their buckets
    asked = spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("token")).select(
        "token", bucket_of("token").alias("bucket")).collect()
    held = spark.read.schema(POSTING_SCHEMA).parquet(postings)
    if since is not None:
        least = _hour(since, spark, hours)
        held = held.filter((F.col("day") >= least // 24) & (F.col("hour") >= least))
    if not asked:
        return held.filter("false").select("hour", "id")

    def of(some) -> DataFrame:
        return held.filter(F.col("bucket").isin([r["bucket"] for r in some]) & F.col("token").isin([r["token"] for r in some]))

    if match == "any":
        return of(asked).select("hour", "id").distinct()
    counts = {r["token"]: r["n"] for r in of(asked).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    rarest = sorted(asked, key=lambda r: (counts.get(r["token"], 0), r["token"]))
    found = of(rarest[:1]).select("hour", "id").distinct()
    for r in rarest[1:]:
        met = of([r]).select(F.col("hour").alias("_hour"), F.col("id").alias("_id"))
        found = found.join(met, F.col("hour").eqNullSafe(F.col("_hour")) & (F.col("id") == F.col("_id")), "left_semi")
    return found


def search(spark: SparkSession, folder: str, postings: str, query: str, match: str = "any",
           since: datetime | None = None, hours: int = 1) -> DataFrame:
    """The alerts whose evidence holds the words; hours without a hit are not read where the hits are few."""
    hits = find(spark, postings, query, match, since, hours).select(F.col("hour").alias("_hour"), F.col("id").alias("_id"))
    # null hours meet too; the plain comparison of the hours is what prunes them
    rows = read_alerts(spark, folder, since, hours)
    timed = rows.join(hits, (F.col("hour") == F.col("_hour")) & (F.col("id") == F.col("_id")), "left_semi")
    if since is not None:
        return timed
    untimed = hits.filter("_hour IS NULL")
    return timed.unionByName(rows.filter("hour IS NULL").join(untimed, F.col("id") == F.col("_id"), "left_semi"))


def write_feed(alerts: DataFrame, folder: str, part_rows: int = PART_ROWS) -> None:
    """A snapshot of the alerts in page order, newest first, in parts of about part_rows rows; of larger ones where
    that would be more than MAX_PARTS, since each part is a task, a folder and a hundred sampled rows on the driver."""
    spark = alerts.sparkSession
    order = [F.desc("timestamp"), F.asc("id")]
    parts = min(MAX_PARTS, max(1, math.ceil(alerts.count() / part_rows)))
    (alerts.select(*_typed()).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
     .write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows"))
    counts = _feed(spark, folder).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row per part, that is, a hundred-thousandth of the rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.select("part", before.cast("bigint").alias("before"), "n").write.mode("overwrite").parquet(f"{folder}/index")


def _feed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(StructType([*ALERT_SCHEMA.fields, StructField("part", IntegerType())])).parquet(f"{folder}/rows")


def feed_page(spark: SparkSession, folder: str, number: int = 1, size: int = 20) -> DataFrame:
    """A page of the feed; only the parts that hold its rows are read."""
    if number < 1:
        raise ValueError("page starts at 1")
    if not 1 <= size <= 100:
        raise ValueError("page size is 1 to 100")
    first = (number - 1) * size
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
    # parts that overlap the page: at most as many as it has rows
    met = index.filter((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).collect()
    skipped = first - min((r["before"] for r in met), default=first)
    rows = _feed(spark, folder).filter(F.col("part").isin([r["part"] for r in met])).drop("part")
    return rows.orderBy(F.desc("timestamp"), F.asc("id")).offset(skipped).limit(size)
