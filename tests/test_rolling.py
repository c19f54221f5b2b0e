import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowsift.functions.scalar import ticks
from flowsift.operators import running as R
from flowsift.operators import segments
from flowsift.operators.rolling import destination_window, flow_windows, lifetime_intervals, source_window
from flowsift.operators.segments import plan_segments

FLOWS = "uid string, ts double, src_ip string, dst_ip string, dst_port int, note string"


def make_flows(n, seed, hot="a"):
    """Ties in ts, one source with most rows, a burst."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        second = rng.choice([rng.randint(0, 400), round(rng.random() * 400, 6), 200 + rng.randint(0, 5)])
        rows.append((f"u{i:05d}", 1700000000.0 + second, rng.choice(hot * 4 + "bc") + "s",
                     f"d{rng.randint(0, 4)}", rng.randint(1, 3), f"n{i}"))
    rng.shuffle(rows)
    return rows


def deviation(values):
    return (sum((v - sum(values) / len(values)) ** 2 for v in values) / len(values)) ** 0.5 if len(values) > 1 else 0.0


def brute(rows, window):
    sources, targets, gaps = defaultdict(list), defaultdict(list), defaultdict(list)
    out = {}
    for uid, ts, src, dst, port, _ in sorted(rows, key=lambda r: (round(r[1] * 1e6), r[0])):
        t = round(ts * 1e6)
        if sources[src]:
            gaps[src].append((t - sources[src][-1][0]) / 1e6)
        sources[src].append((t, dst, port))
        targets[dst].append((t, src))
        near = [e for e in sources[src] if t - e[0] <= window * 1e6]
        n = len(near)
        share = [c / n for c in Counter(e[1] for e in near).values()]
        inner = [(b[0] - a[0]) / 1e6 for a, b in zip(near, near[1:])]
        life = gaps[src]
        out[uid] = dict(
            fan_out=len({e[1:] for e in near}),
            fan_in=len({e[1] for e in targets[dst] if t - e[0] <= window * 1e6}),
            unique_dst_ips=len(share), unique_dst_ports=len({e[2] for e in near}),
            connection_frequency=n, src_ip_entropy=-sum(p * math.log2(p) for p in share),
            periodicity_score=1 / max(deviation(inner), 1e-9) if inner else 0.0,
            iat_mean=sum(life) / len(life) if life else 0.0, iat_std=deviation(life),
            iat_min=min(life, default=0.0), iat_max=max(life, default=0.0),
        )
    return out


def compare(got, expected):
    assert len(got) == len(expected)
    for row in got:
        for name, value in expected[row["uid"]].items():
            if name == "periodicity_score":  # cancellation in the plain float model
                assert min(row[name], 1e5) == pytest.approx(min(value, 1e5), rel=1e-5), (row["uid"], name)
            else:
                assert row[name] == pytest.approx(value, rel=1e-7, abs=1e-7), (row["uid"], name)


@pytest.mark.parametrize("window", [60.0, 4000.0])
def test_windows_match_brute_force(spark, window):
    rows = make_flows(500, 3)
    got = flow_windows(spark.createDataFrame(rows, FLOWS).repartition(4), window).collect()
    compare(got, brute(rows, window))
    assert {r["uid"]: r["note"] for r in got} == {r[0]: r[5] for r in rows}


@pytest.mark.parametrize("window", [60.0, 4000.0])
def test_hot_keys_are_cut_into_segments_and_agree(spark, window):
    """Both keys hot: one source and every destination hold more rows than a task takes."""
    rows = make_flows(300, 5)
    df = spark.createDataFrame(rows, FLOWS).repartition(4)
    plan = plan_segments(df.withColumn("_t", ticks("ts")), 40)
    assert plan is not None and len(plan.splits) >= 5
    assert {r._key.side for r in plan.hot.collect()} == {"source", "destination"}
    got = flow_windows(df, window, target_rows=40).collect()
    compare(got, brute(rows, window))
    assert {r["uid"]: r["note"] for r in got} == {r[0]: r[5] for r in rows}


def test_a_burst_inside_one_window_is_cut(spark):
    """All flows of one source inside a second, all of them to ports of their own."""
    rows = [(f"u{k:03d}", 1700000000.0 + k / 1000, "s", f"d{k % 3}", k, "") for k in range(200)]
    rows += [(f"v{k}", 1700000000.0 + 30 * k, "t", "d0", 1, "") for k in range(5)]
    compare(flow_windows(spark.createDataFrame(rows, FLOWS), 60.0, target_rows=20).collect(), brute(rows, 60.0))


def test_segments_with_null_keys(spark):
    rows = [(f"u{k:03d}", 1000.0 + k, None if k % 2 else "s", None if k % 3 else "d", None if k % 5 else 7, "") for k in range(120)]
    df = spark.createDataFrame(rows, FLOWS)
    cold, hot = ({r.uid: r for r in flow_windows(df, 10.0, n).collect()} for n in (None, 10))
    assert cold.keys() == hot.keys()
    for uid, row in cold.items():
        for name, value in row.asDict().items():
            assert hot[uid][name] == (pytest.approx(value) if isinstance(value, float) else value), (uid, name)


def test_scans_and_shuffles_of_segments(spark, tmp_path, monkeypatch):
    """Both keys hot: the written step and the rest together."""
    path = str(tmp_path / "flows")
    spark.createDataFrame(make_flows(300, 5), FLOWS).write.parquet(path)
    plans = []
    written = segments.stored
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(segments, "stored", lambda df: (plans.append(shown(df)), written(df))[1])
    plans.append(shown(flow_windows(spark.read.parquet(path), 60.0, target_rows=40)))
    assert len(plans) == 2
    assert sum(p.count("FileScan") for p in plans) <= 6
    # the list of hot keys is small by construction and not a shuffle
    assert sum(len(re.findall(r"\bExchange (?:hash|range|Round)", p)) for p in plans) <= 14


def test_partitions_of_segments_follow_the_rows(spark, monkeypatch):
    """Not the session's number of partitions: a task would grow with the table."""
    rows = make_flows(300, 5)
    df = spark.createDataFrame(rows, FLOWS)
    monkeypatch.setattr(segments, "PARTITION_ROWS", 50)
    plan = plan_segments(df.withColumn("_t", ticks("ts")), 40)
    assert plan.rows == 600 and segments.partitions(df, plan) == 12 and segments.partitions(df, plan, 2) == 24
    shown = []
    written = segments.stored
    monkeypatch.setattr(segments, "stored", lambda d: (shown.append(d._jdf.queryExecution().executedPlan().toString()), written(d))[1])
    done = flow_windows(df, 60.0, target_rows=40)
    shown.append(done._jdf.queryExecution().executedPlan().toString())
    sizes = [set(map(int, re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", p))) for p in shown]
    assert sizes[0] == {12, 24} and {12, 24} <= sizes[1]
    compare(done.collect(), brute(rows, 60.0))


def test_single_sides_are_sliced_and_agree(spark):
    rows = make_flows(300, 5)
    df = spark.createDataFrame(rows, FLOWS)
    plan = R.plan_slices(df.withColumn("_t", F.col("ts")), ["src_ip"], "_t", 60)
    assert plan is not None and len(plan.splits) >= 2
    compare(source_window(destination_window(df, 60.0, 60), 60.0, 60).collect(), brute(rows, 60.0))


def test_no_slices_below_the_target(spark):
    df = spark.createDataFrame(make_flows(50, 1), FLOWS)
    assert R.plan_slices(df, ["src_ip"], "ts", 50) is None


def test_periodicity_example(spark):
    rows = [(f"u{i}", 1000.0 + t, "s", "d", 80, "") for i, t in enumerate([0, 1, 120, 130, 150])]
    got = {r.uid: r.periodicity_score for r in flow_windows(spark.createDataFrame(rows, FLOWS)).collect()}
    assert got["u2"] == 0.0 and got["u4"] == pytest.approx(0.2)


def test_window_is_closed(spark):
    rows = [("a", 1000.0, "s", "d", 80, ""), ("b", 1060.0, "s", "e", 80, ""), ("c", 1060.000001, "s", "e", 80, "")]
    got = {r.uid: (r.connection_frequency, r.unique_dst_ips) for r in flow_windows(spark.createDataFrame(rows, FLOWS)).collect()}
    assert got == {"a": (1.0, 1), "b": (2.0, 2), "c": (2.0, 1)}


def test_cold_plan_needs_two_shuffles(spark):
    df = spark.createDataFrame(make_flows(50, 1), FLOWS)
    plan = flow_windows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_lifetime_only(spark):
    rows = make_flows(200, 8)
    expected = {u: {k: v for k, v in e.items() if k.startswith("iat_")} for u, e in brute(rows, 60.0).items()}
    compare(lifetime_intervals(spark.createDataFrame(rows, FLOWS)).collect(), expected)
    compare(lifetime_intervals(spark.createDataFrame(rows, FLOWS), target_rows=40).collect(), expected)


def test_running_null_key(spark):
    rows = [(None, i, 1) for i in range(40)] + [("k", i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t bigint, v int")
    plan = R.plan_slices(df, ["k"], "t", 10)
    got = R.per_temperature(df, plan, lambda p, c: R.running(p, ["k"], ["t"], {"n": ("sum", F.col("v"))}, c))
    assert sorted((r.t, r.n) for r in got.collect() if r.k is None) == [(i, i + 1) for i in range(40)]


def test_hot_destinations_are_sliced_behind_the_source_sweep(spark):
    """Only destinations hold more rows than a task takes; uids may repeat, and a null destination is a key too."""
    rows = [(f"u{k // 2 if k % 50 == 1 else k:03d}", 1700000000.0 + 7 * (k % 131), f"s{k % 23}", None if k % 4 == 3 else f"d{k % 4}",
             k % 5, "n") for k in range(300)]
    df = spark.createDataFrame(rows, FLOWS).repartition(4)
    plan = plan_segments(df.withColumn("_t", ticks("ts")), 40)
    assert {r._key.side for r in plan.hot.collect()} == {"destination"} and len(plan.splits) >= 3
    for window in (60.0, 4000.0):
        cold, hot = (flow_windows(df, window, n) for n in (None, 40))
        assert hot.columns == cold.columns
        assert sorted(map(repr, hot.collect())) == sorted(map(repr, cold.collect()))
    plan = hot._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, \(uid", plan)  # rows carry their sums and are not joined by uid
