"""Categorical codes, model input, class weights and group splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.functions.scalar import number_of, text, truthy
from flowsift.operators.joins import lookup_join
from flowsift.operators.running import per_temperature, plan_slices, running
from flowsift.schema import (
    BOOL_COLUMNS, ENCODED_COLUMNS, FEATURE_COLUMNS, FILL_ZERO_COLUMNS, PERIODICITY_CAP, TOP_N_CATEGORIES,
)


def fit_frequency(rows: DataFrame, column: str, top_n: int = TOP_N_CATEGORIES) -> DataFrame:
    """(column, value, code): the top_n most frequent values, coded from 1; ties by value."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(text(column).alias("value")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    order = [F.desc("_n"), F.asc("value")]
    # ranks top_n rows only: the limit runs first, as a distributed top-k
    ranked = counts.orderBy(*order).limit(top_n).withColumn("code", F.row_number().over(Window.orderBy(*order)))
    return ranked.select(F.lit(column).alias("column"), "value", "code")


def fit_encoders(rows: DataFrame, top_n: int = TOP_N_CATEGORIES) -> DataFrame:
    """The code table of every categorical column present."""
    parts = [fit_frequency(rows, c, top_n) for c in ENCODED_COLUMNS if c in rows.columns]
    if not parts:
        raise ValueError("no categorical column to fit")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def apply_codes(rows: DataFrame, encoders: DataFrame, column: str, output: str) -> DataFrame:
    """Adds the code of a value, 0 for unknown. Never fits."""
    codes = encoders.filter(F.col("column") == column).select(
        F.col("value").alias("_value"), F.col("code").alias("_code")
    )
    keyed = rows.drop(output).withColumn("_value", text(column))
    joined = lookup_join(keyed, codes, "_value", "left")
    return joined.withColumn(output, F.coalesce("_code", F.lit(0)).cast("int")).drop("_value", "_code")


def apply_encoders(rows: DataFrame, encoders: DataFrame | None) -> DataFrame:
    out = rows
    for raw, code in ENCODED_COLUMNS.items():
        if encoders is not None and raw in out.columns:
            out = apply_codes(out, encoders, raw, code)
        elif raw in out.columns or code not in out.columns:
            out = out.withColumn(code, F.lit(0))
    return out


def _flag(rows: DataFrame, name: str) -> Column:
    if rows.schema[name].dataType.typeName() == "boolean":
        return F.coalesce(F.col(name).cast("int"), F.lit(0))
    return truthy(name).cast("int")


def model_rows(rows: DataFrame, encoders: DataFrame | None, keep: list[str] = (), cap: bool = True,
               zero_missing: bool = False) -> DataFrame:
    """The 36 model columns as doubles in order, after `keep`.

    Optional groups are zero-filled, flags become 0/1, periodicity is capped: the same step
    for training and serving. zero_missing: a column that is not there, or null, counts as 0,
    for requests that leave fields out.
    """
    coded = apply_encoders(rows, encoders)
    if zero_missing:
        coded = coded.select("*", *[F.lit(0.0).alias(c) for c in FEATURE_COLUMNS if c not in coded.columns])
    missing = [c for c in FEATURE_COLUMNS if c not in coded.columns]
    if missing:
        raise ValueError("model input is missing columns: " + ", ".join(missing))

    def value(name: str) -> Column:
        if name in BOOL_COLUMNS:
            return _flag(coded, name).cast("double")
        out = number_of(coded, name)
        if zero_missing or name in FILL_ZERO_COLUMNS:
            out = F.coalesce(out, F.lit(0.0))
        return F.least(out, F.lit(PERIODICITY_CAP)) if cap and name == "periodicity_score" else out

    return coded.select(*keep, *[value(c).alias(c) for c in FEATURE_COLUMNS])


def strict_model_rows(rows: DataFrame) -> DataFrame:
    """Ends the job on a null or non-finite model value.

    One sum tells whether all are fine: it is 0 if they are. The names come from one look through an array, as a check
    per column makes a method so long that Java interprets it row by row.
    """
    def off(name: str) -> Column:
        return F.col(name) - F.col(name)

    named = F.array(*[F.struct(F.lit(c).alias("name"), off(c).alias("off")) for c in FEATURE_COLUMNS])
    bad = F.filter(named, lambda v: F.coalesce(v["off"] != 0, F.lit(True)))
    refused = F.raise_error(F.concat(F.lit("invalid model value: "), F.get(bad, F.lit(0))["name"])).cast("boolean")
    fine = reduce(lambda a, b: a + b, map(off, FEATURE_COLUMNS)) == 0
    others = [c for c in rows.columns if c not in FEATURE_COLUMNS]
    return rows.filter(F.when(fine, F.lit(True)).otherwise(refused)).select(*others, *FEATURE_COLUMNS)


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, weight): N / (K * n), the usual balanced weights."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes = Window.partitionBy(F.lit(0))  # one row per class
    share = F.sum("_n").over(classes) / (F.count(F.lit(1)).over(classes) * F.col("_n"))
    return counts.select(label, share.alias("weight"))


def with_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    return lookup_join(rows, class_weights(rows, label), label, "inner")


def group_order(group, seed: int) -> Column:
    """A fixed pseudo-random number of a group name."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def group_split(rows: DataFrame, group: str = "scenario", label: str = "label", train: float = 0.70,
                validation: float = 0.15, seed: int = 42, target_rows: int | None = None) -> DataFrame:
    """(group, label, split): whole groups go to train, val or test, class by class.

    One group of a class: train. Two: train and val. More: rounded shares, at least one each
    for train and val, the rest for test.
    """
    groups = rows.groupBy(group).agg(F.min(label).alias(label)).withColumn("_order", group_order(group, seed))
    ranked = per_temperature(
        groups, plan_slices(groups, [label], "_order", target_rows),
        lambda part, cut: running(part, [label], ["_order", group], {"_rank": ("sum", F.lit(1).cast("bigint"))}, cut),
    )
    sizes = groups.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    sized = lookup_join(ranked, sizes, label, "inner")
    n_train = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(train)))
    n_val = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(validation)))
    rank = F.col("_rank")
    split = (
        F.when((F.col("_n") <= 2) & (rank == 1), "train").when(F.col("_n") <= 2, "val")
        .when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")
    )
    return sized.select(group, label, split.alias("split"))


def take_split(rows: DataFrame, assignment: DataFrame, name: str, group: str = "scenario") -> DataFrame:
    """Rows whose group belongs to the named split."""
    wanted = assignment.filter(F.col("split") == name).select(group)
    return lookup_join(rows, wanted, group, "left_semi")


def split_report(rows: DataFrame, assignment: DataFrame, group: str = "scenario", label: str = "label") -> DataFrame:
    """(split, label, groups, rows) with subtotals; a null label is the total of its split."""
    per_group = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    return assignment.join(per_group, group).rollup("split", label).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("_rows").alias("rows")
    )


def leaked_groups(assignment: DataFrame, group: str = "scenario") -> DataFrame:
    """Groups found in more than one split: empty when the split is sound."""
    sides = {s: assignment.filter(F.col("split") == s).select(group) for s in ("train", "val", "test")}
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    out = None
    for a, b in pairs:
        both = sides[a].intersect(sides[b]).select(group, F.lit(f"{a}/{b}").alias("splits"))
        out = both if out is None else out.unionByName(both)
    return out
