"""Exact order statistics, histograms and pages without sorting everything in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

BINS = 1024


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bins that never fall while the value rises; low and high never share one.

    What lies outside, infinities and NaN among it, has bins of its own. Halves keep the span finite.
    """
    span = high * 0.5 - low * 0.5
    inside = (F.floor((value * 0.5 - F.lit(low * 0.5)) / F.lit(span) * F.lit(float(bins))).cast("int") if span > 0
              else F.when(value > F.lit(low), F.lit(bins)).otherwise(F.lit(0)))
    return (F.when(F.isnan(value), F.lit(bins + 2)).when(value > F.lit(high), F.lit(bins + 1))
            .when(value < F.lit(low), F.lit(-1)).otherwise(inside))


def _at_ranks(values: DataFrame, ranks: list[int], low: float, high: float, bins: int) -> dict[int, float]:
    """The value at each rank (from 0) of column `_v`, by counts that narrow down.

    A round counts the rows of each bin, keeps the bins that hold a rank, and cuts those anew between
    their own least and greatest value, until one value is left. Rows never move: each task sends on
    at most bins + 4 counts per rank, and so does a round to the driver.
    """
    found: dict[int, float] = {}
    ranges, first = [(low, high, 0, sorted(set(ranks)))], True
    while ranges:
        place = F.lit(None).cast("struct<part:int,bin:int>")
        for part, (a, b, _, _) in enumerate(ranges):
            within = F.lit(True) if first else F.col("_v").between(F.lit(a), F.lit(b))
            here = F.struct(F.lit(part).alias("part"), _bin(F.col("_v"), a, b, bins).alias("bin"))
            place = F.when(within, here).otherwise(place)
        counts = values.select("_v", place.alias("_p")).filter(F.col("_p").isNotNull()).groupBy("_p").agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect()
        narrower = []
        for part, (_, _, before, wanted) in enumerate(ranges):
            for row in sorted((r for r in counts if r["_p"]["part"] == part), key=lambda r: r["_p"]["bin"]):
                inside = [r for r in wanted if before <= r < before + row["n"]]
                if inside and (row["low"] == row["high"] or math.isnan(row["low"])):
                    found.update(dict.fromkeys(inside, row["low"]))
                elif inside:
                    narrower.append((row["low"], row["high"], before, inside))
                before += row["n"]
        ranges, first = narrower, False
    return found


def _look(df: DataFrame, column: str, quantiles: list[float], bins: int | None) -> tuple[Row, list[float | None]]:
    """Count, sum and ends of a column, and its linearly interpolated percentiles."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    finite = F.when(F.abs("_v") < F.lit(math.inf), F.col("_v"))
    ends = values.agg(
        F.count("_v").alias("rows"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.sum("_v").alias("sum"),
        F.min(finite).alias("low"), F.max(finite).alias("high")).first()
    if not ends["rows"]:
        return ends, [None] * len(quantiles)
    positions = [q * (ends["rows"] - 1) for q in quantiles]
    ranks = [edge(p) for p in positions for edge in (math.floor, math.ceil)]
    at = _at_ranks(values, ranks, ends["low"] or 0.0, ends["high"] or 0.0, bins or BINS)
    return ends, [
        at[math.floor(p)] if p == math.floor(p)
        else at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in positions]


def exact_quantiles(df: DataFrame, column: str, quantiles: list[float], bins: int | None = None) -> DataFrame:
    """(quantile, value): linearly interpolated percentiles, exact; the table is read once per round."""
    _, values = _look(df, column, quantiles, bins)
    return df.sparkSession.createDataFrame(
        list(zip(map(float, quantiles), values)), "quantile double, value double")


def score_summary(df: DataFrame, column: str, threshold_quantile: float = 0.99, bins: int | None = None) -> DataFrame:
    """One row: rows, min, max, mean, median and the alert threshold of a score."""
    ends, (median, threshold) = _look(df, column, [0.5, threshold_quantile], bins)
    mean = ends["sum"] / ends["rows"] if ends["rows"] else None
    return df.sparkSession.createDataFrame(
        [(ends["rows"], ends["min"], ends["max"], mean, median, threshold)],
        "rows bigint, min double, max double, mean double, median double, threshold double")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, rows) of equal-width bins from min to max, empty bins included.

    The maximum falls into the last bin.
    """
    spark = df.sparkSession
    span = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    low, high = span.first()  # one row
    width = ((high - low) / bins) if low is not None else 0.0
    number = F.floor((F.col(column) - F.lit(low)) / F.lit(width)) if width else F.lit(0)
    bin_no = F.least(F.greatest(number.cast("int"), F.lit(0)), F.lit(bins - 1))
    counts = df.filter(F.col(column).isNotNull()).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("rows"),
    )


def first_in_groups(df: DataFrame, keys: list[str], order: list[Column], limit: int | None,
                    rank: str = "rank") -> DataFrame:
    """The first rows of each group, or all without a limit, with their rank.

    The bound on the rank reaches the map side, where each task keeps its own best rows per
    group, so a large group never meets in one place.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    frame = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(frame))
    return ranked if limit is None else ranked.filter(F.col(rank) <= limit)


def latest(df: DataFrame, time_column: str, limit: int, tie: str | None = None) -> DataFrame:
    """The last rows by time, oldest first."""
    order = [F.desc(time_column), *([F.desc(tie)] if tie else [])]
    back = [F.asc(time_column), *([F.asc(tie)] if tie else [])]
    return df.orderBy(*order).limit(limit).orderBy(*back)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page in the given order: a distributed top-k, no global ranking."""
    if number < 1:
        raise ValueError("page starts at 1")
    if not 1 <= size <= 100:
        raise ValueError("page size is 1 to 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row: total rows, the page asked for, and the number of pages (at least one)."""
    pages = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(size)), F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.lit(number).alias("page"),
        F.lit(size).alias("page_size"), pages.cast("bigint").alias("pages"),
    )
