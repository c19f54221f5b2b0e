"""Feature Parquet, label JSON, run manifest and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowsift.operators.joins import lookup_join
from flowsift.schema import CLASSES, FLOW_COLUMNS, LABEL_SCHEMA, MANIFEST_SCHEMA


def file_stem(path) -> Column:
    """File name without directory and extension."""
    value = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(F.url_decode(value), r"([^/]+?)(\.[^./]+)?$", 1)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files: the six fields, the file stem and the text of broken files."""
    schema = StructType([*LABEL_SCHEMA.fields, StructField("_corrupt", StringType())])
    return (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(path)
        .select("*", file_stem("_metadata.file_path").alias("stem"))
    )


def scenario_classes(labels: DataFrame) -> DataFrame:
    """scenario -> label for labels of a known class, one row per scenario."""
    known = labels.filter(F.col("scenario").isNotNull() & F.col("attack_class").isin(*CLASSES))
    return known.groupBy("scenario").agg(F.min("attack_class").alias("label"))


def unknown_classes(labels: DataFrame) -> DataFrame:
    return labels.filter(~F.coalesce(F.col("attack_class").isin(*CLASSES), F.lit(False)))


def read_features(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Feature rows with their scenario.

    The scenario is the partition column when the data was written by write_features, else
    the file stem.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.parquet(path) if isinstance(path, str) else reader.parquet(*path)
    if "scenario" in rows.columns:
        return rows
    return rows.select("*", file_stem("_metadata.file_path").alias("scenario"))


def read_benign(spark: SparkSession, directory: str, glob: str = "benign_*.parquet") -> DataFrame:
    return read_features(spark, directory, glob).withColumn("label", F.lit("benign"))


def evaluation_rows(spark: SparkSession, path, label: str | None = None,
                    classes: DataFrame | None = None) -> DataFrame:
    """One file or a directory to evaluate: a given label for all rows, else the scenario's,
    else the label the rows carry."""
    rows = read_features(spark, path)
    if label is not None:
        return rows.withColumn("label", F.lit(label))
    return rows if classes is None else attach_labels(rows, classes)[0]


def attach_labels(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the label of their scenario, scenarios without a label and their row counts).

    classes holds one row per scenario; its size is measured before it is broadcast.
    """
    known = classes.select("scenario", F.col("label").alias("_class"))
    labelled = lookup_join(rows, known, "scenario", "inner").select(
        *[c for c in rows.columns if c != "label"], F.col("_class").alias("label")
    )
    skipped = rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("rows")).join(known, "scenario", "left_anti")
    return labelled, skipped


def drop_unknown(rows: DataFrame, classes: list[str] = CLASSES) -> tuple[DataFrame, DataFrame]:
    """(rows of known labels, counts of the dropped labels)."""
    known = F.coalesce(F.col("label").isin(*classes), F.lit(False))
    return rows.filter(known), rows.filter(~known).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("header", True).csv(path)


def attach_runs(rows: DataFrame, manifest: DataFrame, path_column: str = "_path") -> DataFrame:
    """Adds run_id and attack_scenario by the Parquet file a row came from.

    A manifest path matches the file it names, or a file whose path ends with it (relative paths); a file
    that was moved matches by its name if no other run has a file of that name.
    """
    def plain(path: str) -> Column:
        return F.concat(F.lit("/"), F.regexp_replace(F.url_decode(F.col(path)), r"^([A-Za-z][\w+.-]*:)?/*(\./)*", ""))

    runs = manifest.select(
        file_stem("parquet_path").alias("_stem"), plain("parquet_path").alias("_named"), "run_id", "attack_scenario"
    ).withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("_stem")))
    keyed = rows.withColumn("_stem", file_stem(path_column)).withColumn("_from", plain(path_column))
    met = lookup_join(keyed, runs, "_stem", "inner").filter(
        F.col("_from").endswith(F.col("_named")) | (F.col("_same") == 1))
    return met.drop("_stem", "_named", "_from", "_same")


def inventory(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    """Stems of the files in a directory; only listings are read, never contents."""
    files = spark.read.format("binaryFile").load(f"{directory}/{glob}")
    return files.select(file_stem("path").alias("stem"), F.col("length"))


def write_features(rows: DataFrame, scenario: str, directory: str, mode: str = "overwrite") -> None:
    """Durable columns only, in contract order, under scenario=<name>/."""
    if not scenario or not scenario.strip():
        raise ValueError("scenario must not be empty")
    (
        rows.select(*FLOW_COLUMNS).withColumn("scenario", F.lit(scenario))
        .write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy("scenario").parquet(directory)
    )
