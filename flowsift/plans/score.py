"""Scoring: model rows to verdicts, severity and evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.evidence import evidence_texts, top_contributions
from flowsift.functions.scalar import anomaly_norm, decide, severity
from flowsift.operators.classify import TreePaths, attribution_column, paths_of, predict
from flowsift.operators.encode import model_rows, strict_model_rows
from flowsift.operators.isolation import Forest, with_score
from flowsift.schema import CLASSES, FEATURE_COLUMNS

CARRIED = [
    "flow_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "duration",
    "ja3_hash", "ja4_hash", "is_quic", "quic_0rtt", "bytes",
]


@dataclass
class Models:
    """Everything scoring needs; sizes are fixed by the model parameters."""

    classifier: object
    forest: Forest
    encoders: DataFrame | None
    paths: TreePaths | None = None
    classes: tuple[str, ...] = tuple(CLASSES)

    def __post_init__(self):
        if self.paths is None:
            self.paths = paths_of(self.classifier, len(self.classes))


def score(rows: DataFrame, models: Models, top_k: int = 5, policy: str = "service",
          anomaly_info: bool = False) -> DataFrame:
    """Adds threat_class, confidence, anomaly_score, severity and evidence to the flow fields.

    The evidence explains the class the classifier chose, also where the verdict became an
    unknown anomaly. policy "library" keeps the raw isolation score. A model value that is null or not
    finite ends the job.
    """
    classes = list(models.classes)
    carried = F.struct(*[c for c in CARRIED if c in rows.columns])
    model = strict_model_rows(model_rows(rows.withColumn("_flow", carried), models.encoders, ["_flow"]))
    probable = predict(models.classifier, model, FEATURE_COLUMNS, classes)
    isolated = with_score(probable, models.forest, FEATURE_COLUMNS, "_raw")
    anomaly = anomaly_norm("_raw") if policy == "service" else F.col("_raw")
    judged = isolated.withColumn("_anomaly", anomaly).withColumn(
        "_verdict", decide("probabilities", "_anomaly", classes, policy)
    )
    explained = judged.withColumn(
        "_moved", attribution_column(models.paths, FEATURE_COLUMNS, "class_index")
    )
    values = F.array(*[F.col(c) for c in FEATURE_COLUMNS])
    # named before the flow fields unfold, since some model columns share their names
    explained = explained.withColumn("_why", evidence_texts(top_contributions(values, F.col("_moved"), top_k)))
    level = severity("_verdict.confidence")
    if anomaly_info:
        level = F.when(F.col("_verdict.threat_class") == "unknown_anomaly", "info").otherwise(level)
    return explained.select(
        "_flow.*",
        F.col("_verdict.threat_class").alias("threat_class"),
        F.round("_verdict.confidence", 4).alias("confidence"),
        F.round("_anomaly", 4).alias("anomaly_score"),
        level.alias("severity"),
        F.col("_why").alias("evidence"),
    )
