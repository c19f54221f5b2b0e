"""Rolling statistics of sources and destinations where keys are too large for one task: a segmented scan.

Both sides of a flow are rows of one table, keyed by (side, address), so one plan serves all windows. Hot keys
are cut into time slices (see `running.plan_slices`), and a segment is a key's slice; a cold key is one
segment. What a segment needs to know of the others comes in as a few rows or one summary:

    edges    (key, kind, value, slice): first and last time of a value in a segment. The last one before and
             the first one after become border rows of the segment, where lag and lead find them.
    counts   (key, value, slice): what enters and leaves in a segment, summed up over earlier segments; one
             opening row per value that the segment mentions.
    totals   (key, slice): every running fold of a segment at once, folded over earlier segments.

Edges and counts name only values that occur in the segment, so they never outgrow the rows. All folds are sums,
minima and maxima of whole numbers, so any cut gives the same result. One step is written (the marks with what
each adds): totals and the final scan both read it.

Every shuffle has as many partitions as the rows ask for, not as the session sets, and rows are dealt out before they
are grouped: groups are nearly as many as rows, so a grouping inside the scan's tasks would hold all of a task's rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.operators.running import FOLDS, KEY, SLICE, Slicing, combine, plan_slices
from flowsift.operators.steps import stored

SOURCE, DESTINATION = "source", "destination"
_ORDER = ["_t", "uid"]
_SWEEP = ["_t", "_leaves", "uid"]
# halves, or marks, of a shuffle's partition on average
PARTITION_ROWS = 100_000
_KINDS = {"self": (), "port": ("dst_port",), "pair": ("_value", "dst_port")}


def halves(flows: DataFrame) -> DataFrame:
    """Two narrow rows per timed flow: _key (side, address), _value (the other address), dst_port, _t, uid."""
    def half(side: str, key: str, value: str, port: Column) -> Column:
        return F.struct(F.struct(F.lit(side).alias("side"), F.col(key).alias("address")).alias(KEY),
                        F.col(value).alias("_value"), port.alias("dst_port"))

    port = flows.schema["dst_port"].dataType
    both = F.array(half(SOURCE, "src_ip", "dst_ip", F.col("dst_port")),
                   half(DESTINATION, "dst_ip", "src_ip", F.lit(None).cast(port)))
    return flows.select("uid", "_t", F.explode(both).alias("_half")).select("uid", "_t", "_half.*")


def plan_segments(flows: DataFrame, target_rows: int | None = None) -> Slicing | None:
    """Hot keys of both sides together; None where every key fits into a task."""
    return plan_slices(halves(flows), [KEY], "_t", target_rows)


def partitions(rows: DataFrame, slicing: Slicing, each: int = 1) -> int:
    """Partitions for so many rows per half, at least one per core."""
    return max(math.ceil(each * slicing.rows / PARTITION_ROWS), rows.sparkSession.sparkContext.defaultParallelism)


def _sliced(rows: DataFrame, slicing: Slicing) -> DataFrame:
    """Adds the slice of `_t`; cold keys (`_hot` false) have one."""
    placed = slicing.assign(rows)
    return placed.withColumn(SLICE, F.when(F.col("_hot"), F.col(SLICE)).otherwise(0))


def _with_heat(rows: DataFrame, slicing: Slicing) -> DataFrame:
    hot = F.broadcast(slicing.hot.select(KEY, F.lit(True).alias("_hot")))  # at most MAX_SLICES rows
    return rows.join(hot, KEY, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))


def _borders(rows: DataFrame, parts: int) -> DataFrame:
    """For each value of a segment: its last time before the segment and its first one after it, as rows.

    rows: dealt by segment."""
    def kind(name: str, columns: tuple) -> Column:
        return F.struct(F.lit(name).alias("_kind"), *(
            (F.col(c) if c in columns else F.lit(None).cast(rows.schema[c].dataType)).alias(c)
            for c in ("_value", "dst_port")))

    of_sources = rows.where(F.col("_hot") & (F.col(f"{KEY}.side") == SOURCE))
    values = of_sources.select(KEY, SLICE, "_t", F.explode(F.array(*(kind(*k) for k in _KINDS.items()))).alias("_k"))
    same = [KEY, "_kind", "_value", "dst_port"]
    edges = values.select(KEY, SLICE, "_t", "_k.*").groupBy(*same, SLICE).agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last")).repartition(parts, *same)
    along = Window.partitionBy(*same).orderBy(SLICE)
    met = edges.withColumn("_times", F.array(F.lag("_last").over(along), F.lead("_first").over(along)))
    return met.select(*same, SLICE, F.explode(F.filter("_times", lambda t: t.isNotNull())).alias("_t"))


def _neighbours(rows: DataFrame, borders: DataFrame, parts: int) -> DataFrame:
    """Rows with the times of the same value before and after: prev_self, next_self, prev_port and so on."""
    met = rows.withColumn("_kind", F.lit(None).cast("string")).unionByName(borders, allowMissingColumns=True)
    out = met.repartition(parts, KEY, SLICE)
    for name, columns in _KINDS.items():
        applies = F.col("_kind").isNull() | (F.col("_kind") == name)
        along = Window.partitionBy(KEY, SLICE, F.struct(applies, *columns)).orderBy(*_ORDER)
        out = out.withColumns({f"prev_{name}": F.lag("_t").over(along), f"next_{name}": F.lead("_t").over(along)})
    return out.where("_kind is null").drop("_kind")


def _changes(placed: DataFrame, window: int, slicing: Slicing, square_type: str) -> DataFrame:
    """Two marks per half: entering at _t and leaving at _t + window, with what each adds to the folds."""
    def inside(gap: Column, sign: int) -> list[Column]:
        kept = F.coalesce(F.when(gap <= window, gap), F.lit(0)).cast("bigint")
        wide = kept if square_type == "bigint" else kept.cast("decimal(19,0)")
        return [(kept * sign).alias("_gap"), (wide * wide * F.lit(sign)).cast(square_type).alias("_square")]

    def new(name: str) -> Column:
        return F.when(F.col("_t") - F.col(f"prev_{name}") <= window, 0).otherwise(1).cast("bigint")

    def gone(name: str) -> Column:
        return F.when(F.col(f"next_{name}") - F.col("_t") <= window, 0).otherwise(-1).cast("bigint")

    behind, ahead = F.col("_t") - F.col("prev_self"), F.col("next_self") - F.col("_t")
    marks = F.array(
        F.struct(F.lit(0).alias("_leaves"), F.col("_t").alias("_t"), F.lit(1).alias("_sign"), new("port").alias("_port"),
                 new("pair").alias("_pair"), *inside(behind, 1), behind.alias("_life")),
        F.struct(F.lit(1).alias("_leaves"), (F.col("_t") + window).alias("_t"), F.lit(-1).alias("_sign"),
                 gone("port").alias("_port"), gone("pair").alias("_pair"), *inside(ahead, -1),
                 F.lit(None).cast("bigint").alias("_life")))
    return _sliced(placed.select(KEY, "_hot", "uid", "_value", F.explode(marks).alias("_m")).select(
        KEY, "_hot", "uid", "_value", "_m.*"), slicing)


def _openings(rows: DataFrame, window: int, slicing: Slicing, parts: int) -> DataFrame:
    """For each value that a segment mentions: how many flows with it are in the window when it begins."""
    ends = F.array(F.struct(F.col("_t").alias("_t"), F.lit(1).alias("_sign")),
                   F.struct((F.col("_t") + window).alias("_t"), F.lit(-1).alias("_sign")))
    marks = _sliced(rows.where("_hot").select(KEY, "_hot", "_value", F.explode(ends).alias("_m")).select(
        KEY, "_hot", "_value", "_m.*"), slicing)
    counts = marks.repartition(parts, KEY, "_value", SLICE).groupBy(KEY, "_value", SLICE).agg(
        F.sum("_sign").alias("_n")).repartition(parts, KEY, "_value")
    earlier = Window.partitionBy(KEY, "_value").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(KEY, SLICE, "_value", F.sum("_n").over(earlier).cast("int").alias("_sign")).where("_sign > 0")


def _folds(c_log_c, fraction) -> dict[str, tuple[str, Column]]:
    """Running folds of a key over its marks, from the running count of each value."""
    count, sign = F.col("_n_value"), F.col("_sign")
    now, before = c_log_c(count), c_log_c(count - sign)
    first, last = (sign > 0) & (count == 1), (sign < 0) & (count == 0)
    life = F.col("_life")
    square = (life.cast("decimal(19,0)") * life.cast("decimal(19,0)")).cast("decimal(38,0)")
    return {
        "_n": ("sum", sign.cast("bigint")),
        "_values": ("sum", F.when(first, 1).when(last, -1).otherwise(0).cast("bigint")),
        "_pairs": ("sum", F.col("_pair")), "_ports": ("sum", F.col("_port")),
        "_log_whole": ("sum", F.floor(now) - F.floor(before)), "_log_part": ("sum", fraction(now) - fraction(before)),
        "_window_gap": ("sum", F.col("_gap")), "_window_square": ("sum", F.col("_square")),
        "_gaps": ("sum", F.when(F.col("_leaves") == 0, life.isNotNull().cast("bigint"))), "_gap_sum": ("sum", life),
        "_gap_squares": ("sum", square), "_gap_min": ("min", life), "_gap_max": ("max", life),
    }


def segmented_folds(flows: DataFrame, window: int, slicing: Slicing, c_log_c, fraction) -> DataFrame:
    """uid with `source` and `destination`, structs of every running fold at the flow's own time.

    flows: uid (unique), _t, src_ip, dst_ip, dst_port. c_log_c and fraction: how entropy sums are kept whole.
    """
    square_type = "bigint" if window * window < 2**63 else "decimal(38,0)"
    few, many = partitions(flows, slicing), partitions(flows, slicing, 2)
    rows = _sliced(_with_heat(halves(flows), slicing), slicing).repartition(few, KEY, SLICE)
    placed = _neighbours(rows, _borders(rows, few), few)
    marks = _changes(placed, window, slicing, square_type).withColumn("_opens", F.lit(0))
    openings = _openings(rows, window, slicing, many).withColumn("_opens", F.lit(1))
    met = marks.unionByName(openings, allowMissingColumns=True).repartition(many, KEY, SLICE)
    along = Window.partitionBy(KEY, SLICE, "_value").orderBy(F.desc("_opens"), *_SWEEP).rowsBetween(
        Window.unboundedPreceding, 0)
    counted = met.withColumn("_n_value", F.sum("_sign").over(along)).where("_opens = 0")
    folds = _folds(c_log_c, fraction)
    steps = stored(counted.select(KEY, SLICE, "_hot", *_SWEEP, *(step.alias(n) for n, (_, step) in folds.items())))

    totals = steps.where("_hot").groupBy(KEY, SLICE).agg(*(FOLDS[k](n).alias(n) for n, (k, _) in folds.items()))
    earlier = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(KEY, SLICE, *(FOLDS[k](n).over(earlier).alias(f"_before{n}") for n, (k, _) in folds.items()))
    along = Window.partitionBy(KEY, SLICE).orderBy(*_SWEEP).rowsBetween(Window.unboundedPreceding, 0)
    local = steps.repartition(many, KEY, SLICE).select(
        KEY, SLICE, "uid", "_leaves", *(FOLDS[k](n).over(along).alias(f"_here{n}") for n, (k, _) in folds.items()))
    whole = local.where("_leaves = 0").join(carry, [KEY, SLICE], "left").select(
        "uid", F.col(f"{KEY}.side").alias("_side"),
        F.struct(*(combine(k, F.col(f"_before{n}"), F.col(f"_here{n}")).alias(n) for n, (k, _) in folds.items())).alias("_f"))
    of = lambda side: F.first(F.when(F.col("_side") == side, F.col("_f")), True).alias(side)
    return whole.repartition(many, "uid").groupBy("uid").agg(of(SOURCE), of(DESTINATION))


def segmented_sums(marks: DataFrame, narrow: DataFrame, step: str, order: list[str], slicing: Slicing,
                   parts: int) -> DataFrame:
    """Adds _sum, the running sum of `step` of a key in the given order, whose first column is `_t`.

    narrow: the same marks without what they carry; the sums of whole segments are taken from it.
    """
    cut = lambda rows: _sliced(_with_heat(rows, slicing), slicing)
    totals = cut(narrow).where("_hot").groupBy(KEY, SLICE).agg(F.sum(step).alias("_total"))
    earlier = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(KEY, SLICE, F.sum("_total").over(earlier).alias("_before_sum"))
    along = Window.partitionBy(KEY, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut(marks).repartition(parts, KEY, SLICE).withColumn("_here_sum", F.sum(step).over(along))
    return local.join(carry, [KEY, SLICE], "left").withColumn(
        "_sum", combine("sum", F.col("_before_sum"), F.col("_here_sum"))).drop("_before_sum", "_here_sum", "_hot", SLICE)
