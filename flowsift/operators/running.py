"""Running aggregates per key that stay balanced when one key holds much of the data.

A window function puts a whole key into one task. Here keys above a row target are cut
into time slices: each slice is scanned on its own, the totals of the slices before it are
added as a carry. All aggregates used are associative, so the result is exact for any cut.

    cold keys:  shuffle(key)        -> window
    hot keys:   shuffle(key, slice) -> window  +  join(carry per key and slice)

Slices are equi-depth in the order column, so a slice of one key holds about the row
target whatever the key's own distribution is, a burst inside one minute included.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# a quarter of a million rows of whole flows take a task about 250 MB
TARGET_ROWS = 1_000_000
MAX_SLICES = 10_000
SLICE = "_slice"
KEY = "_key"


@dataclass(frozen=True)
class Slicing:
    """Hot keys (at most MAX_SLICES rows), the cut points of the order column and how many rows were counted."""

    keys: list[str]
    hot: DataFrame
    order_col: str
    splits: list[float] = field(default_factory=list)
    rows: int = 0

    def assign(self, df: DataFrame) -> DataFrame:
        """Adds the slice number of the order column."""
        if not self.splits:
            return df.withColumn(SLICE, F.lit(0))
        position = "_slice_position"
        cut = Bucketizer(
            splits=[-math.inf, *self.splits, math.inf], inputCol=position, outputCol=SLICE
        )
        placed = cut.transform(df.withColumn(position, F.col(self.order_col).cast("double"))).drop(position)
        # whole numbers: a double key would be normalized and shuffled a second time
        return placed.withColumn(SLICE, F.col(SLICE).cast("int"))


def plan_slices(df: DataFrame, keys: list[str], order_col: str,
                target_rows: float | None = None) -> Slicing | None:
    """Finds keys too large for one task; None when there are none.

    Runs up to three column-pruned passes when the plan is built: a count, a count per key
    (combined map-side; no key above the target unless the table is), and quantiles of the
    order column over hot rows. What comes to the driver is bounded by MAX_SLICES rows.
    """
    target = target_rows or TARGET_ROWS
    if target == math.inf:
        return None  # the caller knows that no key is too large
    narrow = df.select(*keys, order_col)
    total = narrow.count()
    if total <= target:
        return None
    limit = max(target, math.ceil(total / MAX_SLICES))
    counts = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    found = counts.collect()  # fewer than total / limit <= MAX_SLICES rows
    if not found:
        return None
    hot = df.sparkSession.createDataFrame([row[:-1] for row in found], narrow.select(*keys).schema)
    slices = min(MAX_SLICES, math.ceil(sum(row["_rows"] for row in found) / limit) + 1)
    rows = narrow.join(F.broadcast(hot), _same_keys(narrow, hot, keys), "left_semi")
    quantiles = rows.withColumn(order_col, F.col(order_col).cast("double")).approxQuantile(
        order_col, [i / slices for i in range(1, slices)], 0.25 / slices
    )
    return Slicing(keys, hot, order_col, sorted(set(quantiles)), total)


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def split_hot(df: DataFrame, slicing: Slicing | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys)."""
    if slicing is None:
        return df, None
    hot = F.broadcast(slicing.hot)
    match = _same_keys(df, slicing.hot, slicing.keys)
    return df.join(hot, match, "left_anti"), df.join(hot, match, "left_semi")


def per_temperature(df: DataFrame, slicing: Slicing | None, apply) -> DataFrame:
    """Runs apply(rows, slicing) on cold keys without and on hot keys with slices."""
    cold, hot = split_hot(df, slicing)
    done = apply(cold, None)
    return done if hot is None else done.unionByName(apply(hot, slicing))


FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def combine(kind: str, carry: Column, local: Column) -> Column:
    """Folds of two adjacent stretches as one; a side without rows is null."""
    if kind == "sum":
        return F.coalesce(carry + local, local, carry)
    return F.greatest(carry, local) if kind == "max" else F.least(carry, local)


def running(df: DataFrame, keys: list[str], order: list[str],
            folds: dict[str, tuple[str, Column]], slicing: Slicing | None = None) -> DataFrame:
    """Adds running folds over (keys; order), the current row included.

    folds: output column -> ("sum" | "max" | "min", input expression). With slicing, the
    first order column must be the one the slices cut.
    """
    if slicing is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[FOLDS[k](c).over(frame).alias(n) for n, (k, c) in folds.items()])

    sliced = _sliced(df, keys, slicing)
    frame = Window.partitionBy(KEY, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[FOLDS[k](c).over(frame).alias(f"_l_{n}") for n, (k, c) in folds.items()])
    totals = sliced.groupBy(KEY, SLICE).agg(*[FOLDS[k](c).alias(f"_t_{n}") for n, (k, c) in folds.items()])
    before = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        KEY, SLICE, *[FOLDS[k](F.col(f"_t_{n}")).over(before).alias(f"_b_{n}") for n, (k, _) in folds.items()]
    )
    return local.join(carry, [KEY, SLICE], "left").select(
        *df.columns,
        *[combine(k, F.col(f"_b_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in folds.items()],
    )


def _sliced(df: DataFrame, keys: list[str], slicing: Slicing) -> DataFrame:
    """Rows shuffled by (key, slice): the window, the totals and the carry join share this.

    The key is one struct, which compares equal also where a part of it is null.
    """
    return slicing.assign(df).withColumn(KEY, F.struct(*keys)).repartition(KEY, SLICE)


def neighbours(df: DataFrame, keys: list[str], order: list[str], names: tuple[str, str],
               slicing: Slicing | None = None) -> DataFrame:
    """Adds the first order column of the rows before and after, under the two names."""
    t = order[0]
    prev_name, next_name = names
    if slicing is None:
        frame = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", F.lag(t).over(frame).alias(prev_name), F.lead(t).over(frame).alias(next_name))

    sliced = _sliced(df, keys, slicing)
    frame = Window.partitionBy(KEY, SLICE).orderBy(*order)
    local = sliced.select("*", F.lag(t).over(frame).alias("_lag"), F.lead(t).over(frame).alias("_lead"))
    edges = sliced.groupBy(KEY, SLICE).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    along = Window.partitionBy(KEY).orderBy(SLICE)
    carry = edges.select(
        KEY, SLICE, F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after")
    )
    return local.join(carry, [KEY, SLICE], "left").select(
        *df.columns,
        F.coalesce("_lag", "_before").alias(prev_name),
        F.coalesce("_lead", "_after").alias(next_name),
    )
