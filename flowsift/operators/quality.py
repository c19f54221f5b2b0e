"""Checks on labels, feature rows and file inventories, reported as rows.

Every check yields (check, severity, subject, message), so reports union and filter freely.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsift.schema import (
    CLASSES, ENCODED_COLUMNS, FEATURE_COLUMNS, FLOW_COLUMNS, FLOW_TYPES, IMBALANCE_RATIO, LABEL_REQUIRED,
)
from flowsift.sources.tail import filesystem

FINDING = "check string, severity string, subject string, message string"
MODEL_ONLY = ["ja4_hash_enc"]
INT_COLUMNS = [c for c, kind in FLOW_TYPES.items() if kind in ("int", "bigint")]
FLOAT_COLUMNS = [c for c, kind in FLOW_TYPES.items() if kind == "double"]


def _finding(check: str, severity: str, subject: Column, message: Column) -> list[Column]:
    return [
        F.lit(check).alias("check"), F.lit(severity).alias("severity"),
        subject.cast("string").alias("subject"), message.alias("message"),
    ]


def _static(df: DataFrame, found: list[tuple[str, str, str, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame(found, FINDING)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def check_labels(labels: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """Label files: readable, complete, named after their scenario, of a known class."""
    broken = F.col("_corrupt").isNotNull()
    problems = [
        F.when(broken, F.lit("not valid JSON")),
        *[F.when(~broken & F.col(c).isNull(), F.lit(f"missing field: {c}")) for c in LABEL_REQUIRED],
        F.when(~broken & (F.col("scenario") != F.col("stem")),
               F.concat(F.lit("scenario differs from file name: "), F.col("scenario"))),
        F.when(~broken & F.col("attack_class").isNotNull() & ~F.col("attack_class").isin(*classes),
               F.concat(F.lit("unknown class: "), F.col("attack_class"))),
    ]
    found = F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull()))
    return labels.select("stem", found.alias("_m")).select(*_finding("labels", "error", F.col("stem"), F.col("_m")))


def missing_and_extra(columns: list[str], expected: list[str]) -> tuple[list[str], list[str]]:
    return [c for c in expected if c not in columns], [c for c in columns if c not in expected]


def _column_findings(columns: list[str], expected: list[str], subject: str) -> list[tuple[str, str, str, str]]:
    missing, extra = missing_and_extra(columns, [c for c in expected if c != "label"])
    repeated = sorted({c for c in columns if columns.count(c) > 1})
    found = [("columns", "error", subject, f"missing required columns: {c}") for c in missing]
    found += [("columns", "error", subject, f"unexpected model-only column: {c}") for c in extra if c in MODEL_ONLY]
    found += [("columns", "warning", subject, f"extra column: {c}") for c in extra if c not in MODEL_ONLY + ["label", "scenario"]]
    return found + [("columns", "error", subject, f"duplicate column names: {c}") for c in repeated]


def check_columns(df: DataFrame, expected: list[str] = FLOW_COLUMNS, subject: str = "features") -> DataFrame:
    """Schema against the durable contract; reads no data."""
    return _static(df, _column_findings(df.columns, expected, subject))


def check_files(spark: SparkSession, roots: list[str], expected: list[str] = FLOW_COLUMNS) -> DataFrame:
    """Schema of each Parquet file below the roots on its own, named by folder and file.

    Files are listed as rows, and tasks read their footers: neither plan nor driver grows with them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(roots).select("path")

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in FINDING.split(", ")]
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                place, name = filesystem(path)
                with place.open_input_file(name) as file:
                    columns = pq.read_schema(file).names
                found += _column_findings(columns, expected, "/".join(path.split("/")[-2:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.string()) for k in range(len(names))], names=names)

    return files.mapInArrow(footers, FINDING)


def check_raw_columns(df: DataFrame) -> list[str]:
    """Model columns a raw frame lacks, not counting those derived later."""
    derived = set(ENCODED_COLUMNS.values())
    return [c for c in FEATURE_COLUMNS if c not in derived and c not in df.columns]


def bad_numbers(df: DataFrame, columns: list[str]) -> list[Column]:
    """Count expressions of null, NaN or infinite values per column."""
    return [
        F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c)
        for c in columns
    ]


def check_rows(df: DataFrame, require_label: bool = False, subject: str = "features",
               classes: list[str] = CLASSES, key: str = "flow_id") -> DataFrame:
    """Values of a feature frame: one pass for the counters, one shuffle for duplicate ids."""
    columns = df.columns
    if len(set(columns)) < len(columns):
        return check_columns(df, subject=subject)  # ambiguous names cannot be queried
    floats = [c for c in FLOAT_COLUMNS if c in columns]
    ints = [c for c in INT_COLUMNS if c in columns]
    counters = [F.count(F.lit(1)).alias("_rows"), *bad_numbers(df, floats)]
    counters += [F.count_if(F.col(c).isNull() | (F.col(c) < 0)).alias(c) for c in ints]
    totals = df.agg(*counters)
    messages = [
        F.when(F.col("_rows") == 0, F.lit("dataframe is empty")),
        *[F.when(F.col(c) > 0, F.concat(F.lit(f"non-finite {c}: "), F.col(c).cast("string"))) for c in floats],
        *[F.when(F.col(c) > 0, F.concat(F.lit(f"invalid non-negative integer {c}: "), F.col(c).cast("string"))) for c in ints],
    ]
    found = F.explode(F.filter(F.array(*messages), lambda m: m.isNotNull()))
    parts = [
        check_columns(df, subject=subject),
        totals.select(found.alias("_m")).select(*_finding("values", "error", F.lit(subject), F.col("_m"))),
    ]
    if key in columns:
        repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(
            F.count(F.lit(1)).alias("_ids"), F.sum(F.col("_n") - 1).alias("_extra")
        ).filter("_ids > 0")
        text = F.format_string(f"duplicate {key} values: %d ids, %d extra rows", "_ids", "_extra")
        parts.append(repeated.select(*_finding("duplicates", "error", F.lit(subject), text)))
    if "label" in columns:
        known = F.coalesce(F.col("label").isin(*classes), F.lit(not require_label) & F.col("label").isNull())
        wrong = df.filter(~known).groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
        text = F.concat(F.lit("invalid labels: "), F.coalesce("label", F.lit("<none>")))
        parts.append(wrong.select(*_finding("labels", "error", F.lit(subject), text)))
    elif require_label:
        parts.append(_static(df, [("labels", "error", subject, "missing required columns: label")]))
    return union_all(parts)


def bad_model_values(rows: DataFrame, columns: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """(column, bad) for model columns that hold null, NaN or infinity; empty when clean."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError("model rows are missing columns: " + ", ".join(missing))
    wide = rows.agg(*bad_numbers(rows, columns))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in columns]))
    return wide.select(pairs.alias("_p")).select("_p.*").filter("bad > 0")


def consistency(files: DataFrame, labels: DataFrame, kind: str) -> DataFrame:
    """Both directions between file stems and label stems: unlabelled, missing, matched."""
    left, right = files.select("stem").distinct(), labels.select("stem").distinct()
    return union_all([
        left.join(right, "stem", "left_anti").select(
            *_finding(f"{kind}-label", "error", F.col("stem"), F.lit(f"{kind} has no label"))),
        right.join(left, "stem", "left_anti").select(
            *_finding(f"{kind}-label", "warning", F.col("stem"), F.lit(f"label has no {kind}"))),
        left.join(right, "stem", "left_semi").select(
            *_finding(f"{kind}-label", "ok", F.col("stem"), F.lit("matched"))),
    ])


def class_balance(rows: DataFrame, classes: list[str] = CLASSES, label: str = "label",
                  threshold: float = IMBALANCE_RATIO) -> DataFrame:
    """(class, rows, percent, ratio, status) for every known class.

    Shares are of all rows, ratios of the largest class. One count per class crosses the
    shuffle; the window sees those counts only.
    """
    counts = rows.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    sized = counts.select(
        "class", "_n", F.max("_n").over(everything).alias("_max"), F.sum("_n").over(everything).alias("_total")
    )
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    joined = grid.join(sized, "class", "left")
    n = F.coalesce("_n", F.lit(0))
    ratio = F.coalesce(F.col("_n") / F.col("_max"), F.lit(0.0))
    return joined.select(
        "class", n.alias("rows"),
        F.coalesce(F.col("_n") * 100.0 / F.col("_total"), F.lit(0.0)).alias("percent"),
        ratio.alias("ratio"),
        F.when(n == 0, "MISSING").when(ratio < threshold, "IMBALANCED").otherwise("OK").alias("status"),
    )


def run_integrity(rows: DataFrame, run: str, key: str) -> DataFrame:
    """(run, rows, distinct ids, duplicates): ids are counted once per run before the sum."""
    per_id = rows.groupBy(run, key).agg(F.count(F.lit(1)).alias("_n"))
    return per_id.groupBy(run).agg(
        F.sum("_n").alias("rows"),
        F.count(key).alias("distinct_ids"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicates"),
    )


def summary(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, passed."""
    errors = F.count_if(F.col("severity") == "error")
    return findings.agg(
        errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        (errors == 0).alias("passed"),
    )
