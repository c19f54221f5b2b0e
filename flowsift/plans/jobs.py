"""Batch jobs: log directory to feature Parquet, training, evaluation, data checks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.operators import classify, encode, evaluate, isolation, quality
from flowsift.operators.dns import dns_events, dns_features
from flowsift.operators.enrich import (
    assert_unique, enrich, mark_duplicates, normalise_conn, quic_features, tls_features, to_contract, with_rates,
)
from flowsift.operators.ordering import histogram, score_summary
from flowsift.operators.rolling import flow_windows
from flowsift.operators.steps import stored
from flowsift.plans.score import Models, score
from flowsift.schema import CLASSES, FEATURE_COLUMNS, WINDOW_SECONDS
from flowsift.sources import tables, zeek


def conn_features(flows: DataFrame, window_seconds: float = WINDOW_SECONDS,
                  target_rows: int | None = None) -> DataFrame:
    """Rates and rolling statistics of typed flows."""
    return flow_windows(with_rates(flows), window_seconds, target_rows)


def feature_rows(conn_log: DataFrame, dns_log: DataFrame | None = None, tls_log: DataFrame | None = None,
                 quic_log: DataFrame | None = None, mode: str = "strict", dns_mode: str = "source_window",
                 window_seconds: float = WINDOW_SECONDS, target_rows: int | None = None) -> DataFrame:
    """Log tables to contract rows. In quarantine mode rejected rows keep `violations`; rows of the
    connection log that can't become features at all are given by rejected_flows."""
    if mode == "quarantine":
        return _rows_of(accepted(marked_flows(conn_log)), dns_log, tls_log, quic_log, mode, dns_mode, window_seconds, target_rows)
    return _rows_of(normalise_conn(conn_log, mode), dns_log, tls_log, quic_log, mode, dns_mode, window_seconds, target_rows)


def _rows_of(flows: DataFrame, dns_log, tls_log, quic_log, mode: str, dns_mode: str, window_seconds: float = WINDOW_SECONDS,
             target_rows: int | None = None) -> DataFrame:
    if mode == "strict":
        assert_unique(flows, "uid", "flows")  # on the narrow flows, not on the finished features
    features = conn_features(flows, window_seconds, target_rows)
    dns = None if dns_log is None else dns_features(
        flows.select("uid", "ts", "src_ip"), dns_events(dns_log, mode=mode), dns_mode, window_seconds, target_rows
    )
    tls = None if tls_log is None else tls_features(tls_log)
    quic = None if quic_log is None else quic_features(quic_log)
    return to_contract(enrich(features, dns, tls, quic, validate=False), mode)


def marked_flows(conn_log: DataFrame) -> DataFrame:
    """Typed flows with their `violations`. Both steps are written: a filter on violations would else take the
    parsing of every cell along, to each reader of the flows."""
    return stored(mark_duplicates(stored(normalise_conn(conn_log, "quarantine"), "typed")), "flows")


def accepted(marked: DataFrame) -> DataFrame:
    return marked.filter(F.size("violations") == 0).drop("violations")


def rejected_flows(conn_log: DataFrame) -> DataFrame:
    """Rows of the connection log with their `violations`: torn lines, bad values, repeated uids."""
    return marked_flows(conn_log).filter(F.size("violations") > 0)


def feature_job(spark: SparkSession, log_dir: str, scenario: str, output_dir: str, mode: str = "strict",
                dns_mode: str = "source_window") -> None:
    """conn.log is required; dns, ssl and quic logs are used when present."""
    conn = zeek.read_conn_log(spark, f"{log_dir}/conn.log", mode)
    others = {name: _if_present(spark, f"{log_dir}/{name}.log", mode) for name in ("dns", "ssl", "quic")}
    if mode == "quarantine":
        marked = marked_flows(conn)
        checked = stored(_rows_of(accepted(marked), others["dns"], others["ssl"], others["quic"], mode, dns_mode), "checked")
        rejected = checked.filter(F.size("violations") > 0).unionByName(
            marked.filter(F.size("violations") > 0).withColumnRenamed("uid", "flow_id"), allowMissingColumns=True)
        rejected.write.mode("overwrite").parquet(f"{output_dir}_rejected/scenario={scenario}")
        rows = accepted(checked)
    else:
        rows = feature_rows(conn, others["dns"], others["ssl"], others["quic"], mode, dns_mode)
    tables.write_features(rows, scenario, output_dir)


def _if_present(spark: SparkSession, path: str, mode: str) -> DataFrame | None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    return zeek.read_log(spark, path, mode=mode) if exists else None


@dataclass
class TrainConfig:
    classes: list[str] = field(default_factory=lambda: list(CLASSES))
    train: float = 0.70
    validation: float = 0.15
    seed: int = 42
    trials: int = 20
    params: dict | None = None  # given: no search
    boosted: bool = False  # short for family="per_class"
    family: str = "forest"  # or "per_class": one boosted ensemble per class, or "softmax": boosted for all classes at once
    space: dict | None = None

    def __post_init__(self):
        if self.boosted and self.family == "forest":
            self.family = "per_class"
        if self.family not in classify.SPACES:
            raise ValueError(f"unknown model family: {self.family}")


def train_job(rows: DataFrame, output_dir: str, config: TrainConfig | None = None) -> dict[str, DataFrame]:
    """Split by scenario, fit codes on train, search, refit on train + val, report on test.

    rows: labelled contract rows with `scenario`. Artifacts go to output_dir. Without test
    rows the report is on the training rows.
    """
    config = config or TrainConfig()
    known, _ = tables.drop_unknown(rows, config.classes)
    assignment = encode.group_split(known, train=config.train, validation=config.validation, seed=config.seed)
    assignment.write.mode("overwrite").parquet(f"{output_dir}/split")
    assignment = rows.sparkSession.read.parquet(f"{output_dir}/split")
    parts = {name: encode.take_split(known, assignment, name) for name in ("train", "val", "test")}

    encode.fit_encoders(parts["train"]).coalesce(1).write.mode("overwrite").parquet(f"{output_dir}/encoders")
    encoders = rows.sparkSession.read.parquet(f"{output_dir}/encoders")
    # every trial reads the model rows again, so they are prepared once
    ready = {}
    for name, part in parts.items():
        path = f"{output_dir}/rows/split={name}"
        encode.model_rows(part, encoders, ["label", "scenario"]).write.mode("overwrite").parquet(path)
        ready[name] = rows.sparkSession.read.parquet(path)

    params, found = config.params, None
    if params is None:
        params, found = classify.search(
            encode.with_weights(ready["train"]), ready["val"], classes=config.classes, trials=config.trials,
            seed=config.seed, space=config.space, family=config.family,
        )
    final_rows = encode.with_weights(ready["train"].unionByName(ready["val"]))
    model = classify.fit(config.family, final_rows, classes=config.classes, params=params, seed=config.seed)
    classify.save(model, rows.sparkSession, f"{output_dir}/classifier")

    tested = ready["train"] if ready["test"].isEmpty() else ready["test"]
    pairs = evaluate.pair_counts(classify.predict(model, tested, classes=config.classes))
    pairs.coalesce(1).write.mode("overwrite").parquet(f"{output_dir}/pairs")
    pairs = rows.sparkSession.read.parquet(f"{output_dir}/pairs")
    _write_json(rows.sparkSession, f"{output_dir}/training", {
        "classes": config.classes, "features": FEATURE_COLUMNS, "params": params, "validation_macro_f1": found,
        "family": config.family,
    })
    return {
        "split": encode.split_report(known, assignment),
        "report": evaluate.report(pairs, config.classes),
        "confusion": evaluate.confusion(pairs, config.classes),
        "below_target": evaluate.below_target(pairs, config.classes),
    }


def train_anomaly_job(benign: DataFrame, output_dir: str, encoders: DataFrame | None = None,
                      trees: int = isolation.TREES, sample: int = isolation.SAMPLE, seed: int = isolation.SEED,
                      contamination: float = 0.01) -> dict[str, DataFrame]:
    """Fit on benign rows; the threshold is the 99th percentile of their own scores."""
    lacking = quality.check_raw_columns(benign)
    if lacking:
        raise ValueError("benign rows are missing columns: " + ", ".join(lacking))
    spark = benign.sparkSession
    ready = encode.model_rows(benign, encoders, ["flow_id"])
    bad = quality.bad_model_values(ready).collect()  # at most one row per feature
    if bad:
        raise ValueError("benign rows hold invalid values: " + ", ".join(r["column"] for r in bad))
    isolation.fit(ready, FEATURE_COLUMNS, "flow_id", trees, sample, seed).coalesce(1).write.mode(
        "overwrite").parquet(f"{output_dir}/forest")
    forest = isolation.load(spark.read.parquet(f"{output_dir}/forest"))
    isolation.with_score(ready, forest, FEATURE_COLUMNS).select("flow_id", "raw_score").write.mode(
        "overwrite").parquet(f"{output_dir}/benign_scores")
    scores = spark.read.parquet(f"{output_dir}/benign_scores")
    summary = score_summary(scores, "raw_score", isolation.THRESHOLD_QUANTILE)
    threshold = summary.first()["threshold"]
    _write_json(spark, f"{output_dir}/forest_meta", {
        "threshold": threshold, "feature_columns": FEATURE_COLUMNS, "contamination": contamination,
        "n_estimators": trees, "random_state": seed,
    })
    return {"summary": summary, "histogram": histogram(scores, "raw_score", 50)}


def _write_json(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def load_models(spark: SparkSession, model_dir: str, forest_dir: str | None = None) -> Models:
    meta = read_json(spark, f"{model_dir}/training")
    # models saved before there were families say whether they were boosted
    family = meta.get("family") or ("per_class" if meta["boosted"] else "forest")
    return Models(
        classifier=classify.load(family, spark, f"{model_dir}/classifier", len(meta["classes"])),
        forest=isolation.load(spark.read.parquet(f"{forest_dir or model_dir}/forest")),
        encoders=spark.read.parquet(f"{model_dir}/encoders"),
        classes=tuple(meta["classes"]),
    )


def evaluate_job(rows: DataFrame, models: Models, samples: int = 3) -> dict[str, DataFrame]:
    """Report, confusion matrix, flags and a few explained rows for labelled rows."""
    classes = list(models.classes)
    known, dropped = tables.drop_unknown(rows, classes)
    ready = encode.model_rows(known, models.encoders, ["label"])
    pairs = evaluate.pair_counts(classify.predict(models.classifier, ready, classes=classes))
    return {
        "dropped": dropped,
        "distribution": evaluate.class_distribution(known),
        "report": evaluate.report(pairs, classes),
        "confusion": evaluate.confusion(pairs, classes),
        "below_target": evaluate.below_target(pairs, classes),
        "samples": score(known.orderBy("flow_id").limit(samples), models),
    }


def check_job(spark: SparkSession, labels_dir: str, features_dir: str, captures_dir: str | None = None) -> DataFrame:
    """All findings over labels, captures, feature files and class balance."""
    labels = tables.read_labels(spark, labels_dir)
    rows = tables.read_features(spark, features_dir)
    found = [quality.check_labels(labels), quality.check_files(spark, [features_dir]), quality.check_rows(rows)]
    stems = rows.select(F.col("scenario").alias("stem")).distinct()
    found.append(quality.consistency(stems, labels, "features"))
    if captures_dir:
        found.append(quality.consistency(tables.inventory(spark, captures_dir, "*.pcap"), labels, "capture"))
    labelled, _ = tables.attach_labels(rows, tables.scenario_classes(labels))
    balance = quality.class_balance(labelled).filter("status <> 'OK'")
    found.append(balance.select(
        F.lit("balance").alias("check"), F.lit("warning").alias("severity"), F.col("class").alias("subject"),
        F.format_string("%s: %d rows", "status", "rows").alias("message"),
    ))
    return quality.union_all(found)
