"""Classification report, confusion matrix and class counts from (label, predicted) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.schema import CLASSES, F1_TARGET


def pair_counts(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """The only pass over the data: rows per (label, predicted)."""
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def class_scores(pairs: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """(class, precision, recall, f1, support); undefined ratios are 0."""
    names = F.array(*[F.lit(c) for c in classes])
    sides = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("_actual"), F.lit(0).cast("bigint").alias("_said")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("_actual"), F.col("n").alias("_said")),
    ))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    counted = pairs.select(hit.alias("_hit"), sides.alias("_s")).select("_s.*", "_hit").groupBy("class").agg(
        F.sum("_actual").alias("_actual"), F.sum("_said").alias("_said"), (F.sum("_hit") / 2).alias("_hits")
    )
    grid = pairs.sparkSession.range(1).select(F.explode(names).alias("class"))
    full = grid.join(counted, "class", "left").na.fill(0, ["_actual", "_said", "_hits"])
    precision, recall = _ratio(F.col("_hits"), F.col("_said")), _ratio(F.col("_hits"), F.col("_actual"))
    scored = full.select("class", precision.alias("precision"), recall.alias("recall"), F.col("_actual").alias("support"))
    both = F.col("precision") + F.col("recall")
    return scored.select(
        "class", "precision", "recall", _ratio(2 * F.col("precision") * F.col("recall"), both).alias("f1"), "support"
    )


def report(pairs: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """Per-class scores, then accuracy, macro avg and weighted avg rows.

    Each class row also counts towards the three summary rows: plainly for the macro average,
    by its support for the weighted one. Accuracy is the recall weighted by support.
    """
    measures = ["precision", "recall", "f1"]
    weight = {"macro avg": F.lit(1.0), "weighted avg": F.col("support"), "accuracy": F.col("support")}

    def part(name: Column, factor: Column, shown: list[Column]) -> Column:
        values = [value.alias(m) for m, value in zip(measures, shown)]
        return F.struct(name.alias("class"), factor.cast("double").alias("_w"), *values)

    own = [F.col(m) for m in measures]
    parts = [part(F.col("class"), F.lit(1.0), own)]
    parts += [part(F.lit(n), w, [F.col("recall")] * 3 if n == "accuracy" else own) for n, w in weight.items()]
    rows = class_scores(pairs, classes).select("support", F.explode(F.array(*parts)).alias("_p"))
    return rows.select("support", "_p.*").groupBy("class").agg(
        *[_ratio(F.sum(F.col(m) * F.col("_w")), F.sum("_w")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )


def macro_f1(pairs: DataFrame, classes: list[str] = CLASSES) -> float:
    """Over the classes that occur in the data, as the search objective."""
    row = class_scores(pairs, classes).filter("support > 0").agg(F.avg("f1")).first()
    return float(row[0] or 0.0)


def below_target(pairs: DataFrame, classes: list[str] = CLASSES, target: float = F1_TARGET) -> DataFrame:
    return class_scores(pairs, classes).filter((F.col("support") > 0) & (F.col("f1") < target))


def confusion(pairs: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    counted = pairs.groupBy("label").pivot("predicted", classes).agg(F.sum("n"))
    grid = pairs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    return grid.join(counted, "label", "left").na.fill(0)


def class_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label))


def group_labels(rows: DataFrame, group: str = "scenario", label: str = "label") -> DataFrame:
    """One label per group: the smallest, so the choice does not depend on row order."""
    return rows.groupBy(group).agg(F.min(label).alias(label))
