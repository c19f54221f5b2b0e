"""Trailing-window and lifetime statistics of each flow's source and destination.

Rows are ordered by (ts, uid) inside a key. The window of a row is closed: rows up to and
including window_seconds older count, later rows with the same ts do not.

Counts, distinct counts and entropy come from a sweep: every flow enters at ts and leaves
after ts + window, and running sums over these marks replace any per-row look at the window.
A value becomes distinct where its last occurrence is more than a window away, and stops
being so where its next one is; both are known from the neighbouring rows of that value.
Everything summed is a whole number (microseconds, counts, fixed-point logs), so nothing
drifts and slices of a hot key add up exactly. Cost is n log n whatever the window holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scalar import ticks
from flowsift.operators.running import KEY, Slicing, neighbours, per_temperature, plan_slices, running
from flowsift.operators.segments import DESTINATION, SOURCE, partitions, plan_segments, segmented_folds, segmented_sums
from flowsift.schema import EPSILON, WINDOW_SECONDS

MICROS = 1_000_000
ORDER = ["_t", "uid"]
SWEEP = ["_t", "_leaves", "uid"]
_FRACTION_BITS = 36
# columns of flows that windows read, and the one that holds all others
_READ, _REST = ["uid", "ts", "src_ip", "dst_ip", "dst_port"], "_rest"


def _marks(df: DataFrame, window: int, keep: list[str], payload: list[str], on_enter: dict, on_leave: dict) -> DataFrame:
    """Two rows per flow: entering at _t and leaving at _t + window.

    The payload rides only on the entering row.
    """
    def mark(leaves: int, t: Column, extra: dict) -> Column:
        return F.struct(
            F.lit(leaves).alias("_leaves"),
            t.alias("_t"),
            F.lit(1 - 2 * leaves).alias("_sign"),
            *[(F.col(c) if not leaves else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in payload],
            *[value.alias(name) for name, value in extra.items()],
        )

    both = F.array(mark(0, F.col("_t"), on_enter), mark(1, F.col("_t") + F.lit(window), on_leave))
    return df.select(*keep, F.explode(both).alias("_mark")).select(*keep, "_mark.*")


def _appears(before: str, window: int) -> Column:
    """1 where the value was not in the window yet."""
    return F.when(F.col("_t") - F.col(before) <= window, 0).otherwise(1).cast("bigint")


def _vanishes(after: str, window: int) -> Column:
    """-1 where the value leaves the window with this flow."""
    return F.when(F.col(after) - F.col("_t") <= window, 0).otherwise(-1).cast("bigint")


def _c_log_c(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def _fraction(value: Column) -> Column:
    return F.floor((value - F.floor(value)) * F.lit(float(1 << _FRACTION_BITS)) + 0.5)


def _spread(count: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from exact whole-number sums."""
    wide = "decimal(38,0)"
    n, s = count.cast("decimal(18,0)"), total.cast("decimal(19,0)")
    scaled = (n * squares.cast(wide)).cast(wide) - (s * s).cast(wide)
    return F.sqrt(scaled.cast("double")) / count


def destination_window(flows: DataFrame, window_seconds: float = WINDOW_SECONDS,
                       target_rows: int | None = None) -> DataFrame:
    """Adds fan_in: distinct sources that reached the flow's destination in the window."""
    window = round(window_seconds * MICROS)
    timed = flows.withColumn("_t", ticks("ts"))
    payload = [c for c in flows.columns if c not in ("uid", "dst_ip")]

    def sweep(rows: DataFrame, slicing: Slicing | None) -> DataFrame:
        if slicing is None:
            # one shuffle serves both windows below
            rows = rows.repartition("dst_ip")
        placed = neighbours(rows, ["dst_ip", "src_ip"], ORDER, ("_before", "_after"), slicing)
        marks = _marks(
            placed, window, ["uid", "dst_ip"], payload,
            {"_step": _appears("_before", window)}, {"_step": _vanishes("_after", window)},
        )
        summed = running(marks, ["dst_ip"], SWEEP, {"_sources": ("sum", F.col("_step"))}, slicing)
        return summed.filter("_leaves = 0").select(
            *flows.columns, F.col("_sources").cast("double").alias("fan_in")
        )

    return per_temperature(timed, plan_slices(timed, ["dst_ip"], "_t", target_rows), sweep)


def lifetime_intervals(flows: DataFrame, target_rows: int | None = None) -> DataFrame:
    """Adds iat and iat_mean/std/min/max over all earlier flows of the source."""
    timed = flows.withColumn("_t", ticks("ts"))
    slicing = plan_slices(timed, ["src_ip"], "_t", target_rows)
    done = per_temperature(timed, slicing, _lifetime)
    return done.select(
        *flows.columns, _seconds(F.col("_t") - F.col("prev__t")).alias("iat"), *_lifetime_columns()
    )


def _lifetime(rows: DataFrame, slicing: Slicing | None) -> DataFrame:
    placed = neighbours(rows, ["src_ip"], ORDER, ("prev__t", "next__t"), slicing)
    return running(placed, ["src_ip"], ORDER, _gap_folds(), slicing)


def _gap_folds() -> dict[str, tuple[str, Column]]:
    """Running sums of the gaps between a source's flows; squares are exact whole numbers."""
    gap = F.col("_t") - F.col("prev__t")
    square = (gap.cast("decimal(19,0)") * gap.cast("decimal(19,0)")).cast("decimal(38,0)")
    return {
        "_gaps": ("sum", gap.isNotNull().cast("bigint")),
        "_gap_sum": ("sum", gap),
        "_gap_squares": ("sum", square),
        "_gap_min": ("min", gap),
        "_gap_max": ("max", gap),
    }


def _seconds(micros: Column) -> Column:
    return micros / F.lit(float(MICROS))


def _lifetime_columns() -> list[Column]:
    n = F.col("_gaps")
    some = n > 0
    spread = _spread(n, F.col("_gap_sum"), F.col("_gap_squares"))
    values = {
        "iat_mean": _seconds(F.col("_gap_sum") / n),
        "iat_std": _seconds(spread),
        "iat_min": _seconds(F.col("_gap_min")),
        "iat_max": _seconds(F.col("_gap_max")),
    }
    return [F.when(some, v).otherwise(F.lit(0.0)).alias(name) for name, v in values.items()]


_LIFETIME = ["_gaps", "_gap_sum", "_gap_squares", "_gap_min", "_gap_max"]


def source_window(flows: DataFrame, window_seconds: float = WINDOW_SECONDS,
                  target_rows: int | None = None, lifetime: bool = True, parts: int | None = None) -> DataFrame:
    """Adds every source-keyed statistic.

    fan_out, unique_dst_ips, unique_dst_ports, connection_frequency, src_ip_entropy and
    periodicity_score over the trailing window; iat_* over the lifetime of the source.
    Cold sources need one shuffle, into `parts` if given: hash(src_ip) also satisfies the finer (src_ip, dst) keys.
    """
    window = round(window_seconds * MICROS)
    timed = flows.withColumn("_t", ticks("ts"))
    # gaps inside a window add up to at most the window, so their squares to its square
    square_type = "bigint" if window * window < 2**63 else "decimal(38,0)"

    def sweep(rows: DataFrame, slicing: Slicing | None) -> DataFrame:
        if slicing is None:
            rows = _by_source(rows, parts)
        gaps = ("prev__t", "next__t")
        placed = _lifetime(rows, slicing) if lifetime else neighbours(rows, ["src_ip"], ORDER, gaps, slicing)
        placed = neighbours(placed, ["src_ip", "dst_port"], ORDER, ("_port_before", "_port_after"), slicing)
        placed = neighbours(placed, ["src_ip", "dst_ip", "dst_port"], ORDER, ("_pair_before", "_pair_after"), slicing)

        def inside(gap: Column, sign: int) -> dict[str, Column]:
            kept = F.coalesce(F.when(gap <= window, gap), F.lit(0)).cast("bigint")
            wide = kept.cast(square_type) if square_type == "bigint" else kept.cast("decimal(19,0)")
            return {"_gap": kept * F.lit(sign), "_square": (wide * wide * F.lit(sign)).cast(square_type)}

        marks = _marks(
            placed, window, ["uid", "src_ip", "dst_ip"],
            [c for c in flows.columns if c not in ("uid", "src_ip", "dst_ip")] + (_LIFETIME if lifetime else []),
            {
                "_port": _appears("_port_before", window), "_pair": _appears("_pair_before", window),
                **inside(F.col("_t") - F.col("prev__t"), 1),
            },
            {
                "_port": _vanishes("_port_after", window), "_pair": _vanishes("_pair_after", window),
                **inside(F.col("next__t") - F.col("_t"), -1),
            },
        )
        sign, count = ("sum", F.col("_sign")), F.col("_n_ip")
        step = running(marks, ["src_ip", "dst_ip"], SWEEP, {"_n_ip": sign}, slicing)
        first = (F.col("_sign") > 0) & (count == 1)
        last = (F.col("_sign") < 0) & (count == 0)
        now, before = _c_log_c(count), _c_log_c(count - F.col("_sign"))
        step = running(
            step, ["src_ip"], SWEEP,
            {
                "_n": sign,
                "_values": ("sum", F.when(first, 1).when(last, -1).otherwise(0).cast("bigint")),
                "_pairs": ("sum", F.col("_pair")),
                "_ports": ("sum", F.col("_port")),
                "_log_whole": ("sum", F.floor(now) - F.floor(before)),
                "_log_part": ("sum", _fraction(now) - _fraction(before)),
                "_window_gap": ("sum", F.col("_gap")),
                "_window_square": ("sum", F.col("_square")),
            },
            slicing,
        )
        return step.filter("_leaves = 0")

    done = per_temperature(timed, plan_slices(timed, ["src_ip"], "_t", target_rows), sweep)
    return done.select(*flows.columns, *_source_columns(lifetime))


def _by_source(rows: DataFrame, parts: int | None) -> DataFrame:
    return rows.repartition(parts, "src_ip") if parts else rows.repartition("src_ip")


def _source_columns(lifetime: bool = True) -> list[Column]:
    """Features out of the running folds of a source."""
    n = F.col("_n")
    logs = F.col("_log_whole") + F.col("_log_part") / F.lit(float(1 << _FRACTION_BITS))
    entropy = F.greatest(F.log2(n.cast("double")) - logs / n, F.lit(0.0))
    spread = _seconds(_spread(n - 1, F.col("_window_gap"), F.col("_window_square")))
    periodicity = F.when(n > 1, F.lit(1.0) / F.greatest(spread, F.lit(EPSILON))).otherwise(F.lit(0.0))
    return [
        F.col("_pairs").cast("double").alias("fan_out"),
        F.col("_values").alias("unique_dst_ips"),
        F.col("_ports").alias("unique_dst_ports"),
        *(_lifetime_columns() if lifetime else []),
        n.cast("double").alias("connection_frequency"),
        entropy.alias("src_ip_entropy"),
        periodicity.alias("periodicity_score"),
    ]


def flow_windows(flows: DataFrame, window_seconds: float = WINDOW_SECONDS,
                 target_rows: int | None = None) -> DataFrame:
    """Source and destination statistics of flows(uid, ts, src_ip, dst_ip, dst_port, ...).

    Where every key fits into a task: two shuffles of the flows, no join, the destination sweep carries the row
    on to the source sweep. Where every source does: the other way round, and destinations are swept in slices.
    Else a segmented scan over narrow rows of both sides, joined by uid, which has to be unique then.
    What the windows don't read rides through their sorts as one column, which a leaving mark lacks as a whole.
    """
    rest = [c for c in flows.columns if c not in _READ]
    if not rest:
        return _flow_windows(flows, window_seconds, target_rows)
    done = _flow_windows(flows.select(*_READ, F.struct(*rest).alias(_REST)), window_seconds, target_rows)
    return done.select(*[F.col(c) if c in _READ else F.col(_REST)[c].alias(c) for c in flows.columns],
                       *[c for c in done.columns if c not in (*_READ, _REST)])


def _flow_windows(flows: DataFrame, window_seconds: float, target_rows: int | None) -> DataFrame:
    timed = flows.withColumn("_t", ticks("ts"))
    slicing = plan_segments(timed, target_rows)
    if slicing is None:
        cold = destination_window(flows, window_seconds, math.inf)
        return source_window(cold, window_seconds, math.inf)
    window = round(window_seconds * MICROS)
    if slicing.hot.where(F.col(f"{KEY}.side") == SOURCE).isEmpty():
        return _sliced_destinations(timed, flows.columns, window_seconds, slicing)
    narrow = timed.select("uid", "_t", "src_ip", "dst_ip", "dst_port")
    folds = segmented_folds(narrow, window, slicing, _c_log_c, _fraction)
    of_source = folds.select("uid", F.col(f"{DESTINATION}._values").alias("_fan_in"), f"{SOURCE}.*")
    return flows.join(of_source, "uid").select(
        *flows.columns, F.col("_fan_in").cast("double").alias("fan_in"), *_source_columns())


def _sliced_destinations(timed: DataFrame, columns: list[str], window_seconds: float, slicing: Slicing) -> DataFrame:
    """flow_windows where only destinations are hot.

    A source's flows to one destination lie with the source, so its sweep tells where a source appears at a
    destination and vanishes again. Rows then go to slices of their destination, where that is summed up. What earlier
    slices add up to comes from the same marks of narrow rows.
    """
    window = round(window_seconds * MICROS)
    parts = partitions(timed, slicing)

    def marks(rows: DataFrame, payload: list[str]) -> DataFrame:
        key = F.struct(F.lit(DESTINATION).alias("side"), F.col("dst_ip").alias("address")).alias(KEY)
        return _marks(rows.select("*", key), window, ["uid", KEY], payload,
                      {"_step": _appears("_before", window)}, {"_step": _vanishes("_after", window)})

    def met(rows: DataFrame) -> DataFrame:
        return neighbours(_by_source(rows, parts), ["src_ip", "dst_ip"], ORDER, ("_before", "_after"))

    swept = source_window(met(timed).drop("_t"), window_seconds, math.inf, parts=parts).withColumn("_t", ticks("ts"))
    carried = [c for c in swept.columns if c not in ("uid", "_t", "_before", "_after")]
    summed = segmented_sums(marks(swept, carried), marks(met(timed.select("uid", "_t", "src_ip", "dst_ip")), []),
                            "_step", SWEEP, slicing, parts)
    statistics = [c for c in carried if c not in columns]
    return summed.filter("_leaves = 0").select(
        *columns, F.col("_sum").cast("double").alias("fan_in"), *statistics)
