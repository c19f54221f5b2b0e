"""Stream features of large batches: state by buckets, busy destinations in slices."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from flowsift.streaming import windows
from flowsift.streaming.features import ROCKS, STORE, keyed_features, split_features, start_features, with_keyed_state
from flowsift.streaming.store import batch_numbers, read_table
from tests.test_rolling import FLOWS, brute, compare, make_flows


def table(rows):
    columns = zip(*rows)
    at = {"uid": pa.string(), "ts": pa.float64(), "src_ip": pa.string(), "dst_ip": pa.string(), "dst_port": pa.int32(), "note": pa.string()}
    made = pa.table({n: pa.array(c, t) for (n, t), c in zip(at.items(), columns)})
    return made.append_column("_t", pa.array([round(r[1] * 1e6) for r in rows], pa.int64()))


def moved(rows, cuts, width, forget=None):
    """All rows through the operator's arithmetic, in turns that end at the cuts."""
    recent = sums = None
    found, steps, low = [], [], -1
    for cut in cuts:
        ready = table(rows).filter((pc.field("_t") > low) & (pc.field("_t") <= cut))
        done, left, recent, sums = windows.move_on(ready, recent, sums, cut, width, forget)
        found, steps = found + done.to_pylist(), steps + left.to_pylist()
        low = cut
    return found, steps


@pytest.mark.parametrize("wide", [1 << 22, 1])
def test_arrays_equal_brute_force(monkeypatch, wide):
    """Over five turns, with sums of logarithms in 64 bits and without that bound."""
    monkeypatch.setattr(windows, "_WIDE", wide)
    rows = make_flows(400, 8)
    cuts = [1_700_000_000_000_000 + 100_000_000 * k for k in range(1, 6)]
    found, steps = moved(rows, cuts, 60_000_000)
    marks = sorted([(s["_t"], 1, "", s["dst_ip"], s["_step"], None) for s in steps]
                   + [(r["_t"], 0, r["uid"], r["dst_ip"], r["_step"], r) for r in found], key=lambda m: m[:3])
    inside = dict.fromkeys({m[3] for m in marks}, 0)
    for _, _, _, target, step, row in marks:
        inside[target] += step
        if row:
            row["fan_in"] = inside[target]
    compare(found, brute(rows, 60.0))
    assert {r["uid"]: r["note"] for r in found} == {r[0]: r[5] for r in rows}
    # nothing is open one window after the last flow
    assert all(n == 0 for n in inside.values()) and len(steps) == sum(r["_step"] for r in found)


def test_nulls_are_values_and_long_gaps_are_exact():
    rows = [("a", 1.0, None, None, None, "x"), ("b", 2.0, None, None, 5, None), ("c", 3.0, None, "d", None, None)]
    found, _ = moved(rows, [10_000_000], 60_000_000)
    last = {r["uid"]: r for r in found}["c"]
    assert (last["unique_dst_ips"], last["unique_dst_ports"], last["fan_out"]) == (2, 2, 3.0)
    # gaps of about four months whose deviation is a microsecond
    at = np.cumsum([0] + [10 ** 13 + k % 2 * 2 for k in range(40)])
    rows = [(f"u{k:02d}", t / 1e6, "s", "d", 1, "") for k, t in enumerate(at.tolist())]
    found, _ = moved(rows, [int(at[20]), int(at[-1])], 10 ** 15)
    last = max(found, key=lambda r: r["uid"])
    assert last["iat_std"] == pytest.approx(1e-6) and last["periodicity_score"] == pytest.approx(1e6)


def test_busy_destination_is_cut_and_state_is_by_buckets(spark, tmp_path):
    """One destination has nearly all flows of many sources: its steps are summed in slices, its flows aren't state."""
    draw, source, root = random.Random(4), str(tmp_path / "flows"), str(tmp_path / "out")
    rows = sorted(((f"u{k:05d}", 1000.0 + round(draw.random() * 300, 6), f"s{draw.randint(0, 40)}", draw.choice(["d"] * 9 + [None]), 1, "")
                   for k in range(2000)), key=lambda r: (r[1], r[0]))
    for k in range(4):
        spark.createDataFrame(rows[500 * k:500 * k + 500], FLOWS).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(None, 5000.0, None, None, None, None)], FLOWS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", 1).parquet(source)
    before = spark.conf.get(STORE, None)
    query = with_keyed_state(keyed_features(stream, 60.0, 1.0), split_features(root, 40), f"{root}/state", True, "0 seconds", {STORE: ROCKS})
    query.awaitTermination()
    assert query.exception() is None and spark.conf.get(STORE, None) == before
    compare(read_table(spark, f"{root}/features").collect(), brute(rows, 60.0))
    # some values per bucket and batch, though 500 flows come and go
    updated = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators]
    assert updated and max(updated) < 41 * 6
    # what is open after the last batch is nothing
    assert read_table(spark, f"{root}/open").where(F.col("batch") == batch_numbers(spark, f"{root}/open")[-1]).count() == 0


@pytest.mark.parametrize("nested", [False, True])
def test_other_columns_stay_as_they_are(spark, tmp_path, nested):
    """Whole numbers beside nulls, not-a-number beside null, old times and lists, of flows in time and of late ones."""
    source, root = str(tmp_path / "flows"), str(tmp_path / "out")
    kept = {"big": "CASE WHEN id % 2 = 0 THEN 9007199254740993 + id END", "odd": "CASE id % 3 WHEN 0 THEN double('NaN') WHEN 1 THEN 1.5D END",
            "old": "timestamp'1500-01-01 01:02:03.000004'", "money": "CASE WHEN id % 2 = 0 THEN 12345678901234567890.12BD END"}
    if nested:
        kept |= {"many": "CASE WHEN id % 2 = 0 THEN array(id, null) END", "named": "map('a', id, 'b', null)",
                 "both": "named_struct('x', id, 'y', CASE WHEN id % 2 = 0 THEN 'y' END)"}
    flows = spark.range(40).selectExpr("cast(id as string) uid", "1000.0D + id ts", "'s' src_ip", "'d' dst_ip", "cast(id % 3 as int) dst_port",
                                       *(f"{e} AS {n}" for n, e in kept.items()))
    flows.coalesce(1).write.parquet(source)
    end = flows.limit(1).select(*(F.lit(5000.0 if c == "ts" else None).cast(flows.schema[c].dataType).alias(c) for c in flows.columns))
    end.coalesce(1).write.mode("append").parquet(source)
    late = flows.limit(9).withColumn("ts", F.expr("CASE WHEN dst_port = 0 THEN ts WHEN dst_port = 1 THEN double('NaN') END"))
    late.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    start_features(stream, root, 60.0, 1.0, once=True).awaitTermination()

    def text(df):
        return sorted(r.t for r in df.select(F.to_json(F.struct(*flows.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("t")).collect())

    assert text(read_table(spark, f"{root}/features")) == text(flows)
    assert text(read_table(spark, f"{root}/late")) == text(late)


def test_flow_at_the_watermark_leaves(spark, tmp_path):
    """Sources in other buckets included, so that a destination meets all steps up to the watermark."""
    source, root = str(tmp_path / "flows"), str(tmp_path / "out")
    rows = [(f"u{k}", 1000.0, f"s{k}", "d", 1, "") for k in range(9)] + [("end", 1001.0, "t", "d", 1, "")]
    spark.createDataFrame(rows, FLOWS).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(FLOWS).parquet(source)
    start_features(stream, root, 60.0, 1.0, once=True).awaitTermination()
    got = {r.uid: r.fan_in for r in read_table(spark, f"{root}/features").collect()}
    assert got == {f"u{k}": k + 1.0 for k in range(9)}
