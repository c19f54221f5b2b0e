"""What keeps a job's plans and tasks small as its tables grow."""

import contextlib
import io
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from flowsift.catalog import analytics, logs
from flowsift.catalog.alerts import alerts
from flowsift.operators import encode, joins, running
from flowsift.plans import jobs
from flowsift.schema import FEATURE_COLUMNS, FLOW_SCHEMA
from flowsift.sources import alert_table, zeek
from flowsift.streaming.correlation import KeyedChains, new_chain
from flowsift.streaming.features import KeyedWindows


def _small_log(spark, sf, folder):
    rows = logs._log_rows(spark, sf).limit(60)
    logs._conn_log(rows, folder)
    return zeek.read_conn_log(spark, f"{folder}/conn.log", "quarantine")


def test_readers_of_marked_flows_parse_no_cells(spark, sf, tmp_path):
    rejected = jobs.rejected_flows(_small_log(spark, sf, str(tmp_path)))
    plan = rejected._jdf.queryExecution().optimizedPlan().toString()
    assert "trim" not in plan and len(plan) < 20_000
    assert rejected.count() == 0


class _Cell:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, rows):
        self.value = [*(self.value or ()), *rows]

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.cells, self.timers = {}, []

    def getListState(self, name, schema):
        return self.cells.setdefault(name, _Cell())

    getValueState = getListState

    def registerTimer(self, moment):
        self.timers.append(moment)


class _Watermark:
    def __init__(self, millis):
        self.millis = millis

    def getCurrentWatermarkInMs(self):
        return self.millis


def test_a_timer_goes_through_all_cycles_behind_the_watermark():
    day = timedelta(days=1)
    chains, handle = KeyedChains(day, day, 2), _Handle()
    chains.init(handle)
    micros = day // timedelta(microseconds=1)
    rows = [("a", round(d * micros), f"{d}", kind, None) for d in (0.5, 3.5, 9.5) for kind in ("x", "y")]
    rows = [(k, t, f"{i}{kind}", kind, chain) for k, t, i, kind, chain in rows]
    assert list(chains.handleInputRows(("a",), iter(rows), _Watermark(0))) == []
    assert handle.timers == [86_400_000]
    out = list(chains.handleExpiredTimer(("a",), _Watermark(5 * 86_400_000), None))
    assert [(r.id, r.kill_chain_id) for r in out] == [
        (i, new_chain("a", f"{d}x")) for d in (0.5, 3.5) for i in (f"{d}x", f"{d}y")]
    # what the watermark has not passed waits for its own cycle
    assert [r[1] for r in handle.cells["alerts"].value] == ["9.5x", "9.5y"] and handle.timers[-1] == 10 * 86_400_000


def test_keyed_windows_take_and_give_rows():
    columns = ["uid", "src_ip", "dst_ip", "dst_port", "_t"]
    windows, handle = KeyedWindows(columns, "", 60.0, None), _Handle()
    windows.init(handle)
    rows = [("source", "s", "1", "s", "d", None, 5_000_000), ("source", "s", "2", "s", "d", 80, 0)]
    (late,) = windows.handleInputRows(("source", "s"), iter(rows), _Watermark(1_000))
    assert late.late and late.uid == "2" and late.dst_port == 80
    (row,) = windows.handleExpiredTimer(("source", "s"), _Watermark(6_000), None)
    assert (row.uid, row.dst_port, row.connection_frequency, row.side, row.late) == ("1", None, 1.0, "source", False)


def test_a_log_has_more_files_where_it_has_more_lines(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "PIECE_LINES", 200)
    rows = logs._log_rows(spark, sf)
    logs._conn_log(rows, str(tmp_path))
    files = [f.read_text() for f in (tmp_path / "conn.log").glob("part-*")]
    assert len([f for f in files if f]) > 4 and all(f.startswith("#separator") for f in files if f)
    assert zeek.read_conn_log(spark, f"{tmp_path}/conn.log").count() == rows.count()


def test_only_hot_keys_are_copied_for_a_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    rows = spark.range(300).select(F.when(F.col("id") < 100, -1).otherwise(F.col("id")).alias("k"), "id")
    side = spark.range(-1, 250).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    met = joins.lookup_join(rows, side, "k", "inner", max_rows=10)
    assert {(r.id, r.v) for r in met.collect()} == {(i, -2 if i < 100 else 2 * i) for i in range(250)}
    assert "SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString()
    hot = spark.createDataFrame([(-1, True)], "k bigint, _hot boolean")
    assert joins._copies(side, hot, "k").count() == side.count() - 1 + joins.SALTS


def test_a_feed_has_a_bounded_number_of_parts(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(alert_table, "MAX_PARTS", 3)
    alert_table.write_feed(alerts(spark, sf), str(tmp_path), 10)
    assert len(list((tmp_path / "rows").glob("part=*"))) == 3
    whole = alerts(spark, sf).orderBy(F.desc("timestamp"), "id").offset(600).limit(25)
    page = alert_table.feed_page(spark, str(tmp_path), 25, 25)
    assert [r.id for r in page.collect()] == [r.id for r in whole.collect()]


def test_a_key_of_over_a_million_rows_is_cut(spark):
    rows = spark.range(1_200_000).select(F.lit("a").alias("k"), F.col("id").alias("_t"))
    assert running.plan_slices(rows, ["k"], "_t").splits
    assert running.plan_slices(rows.limit(900_000), ["k"], "_t") is None


def longest_method(df):
    """Bytes of the longest method that Spark generates for a plan; Java interprets those of 8 000 and more."""
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())))


def test_methods_of_scoring_are_compiled(spark, sf):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert longest_method(analytics.contract_features(spark, sf)) < 8_000
        rows = spark.createDataFrame([], FLOW_SCHEMA).localCheckpoint()
        model = encode.model_rows(rows, None, ["flow_id", "label"])
        assert longest_method(encode.with_weights(model)) < 8_000
        assert longest_method(encode.strict_model_rows(model)) < 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("value", [None, float("nan"), float("inf"), float("-inf")])
def test_an_invalid_model_value_ends_the_job_with_its_name(spark, value):
    good = [float(i) for i in range(len(FEATURE_COLUMNS))]
    schema = "uid string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    fine = spark.createDataFrame([("a", *good)], schema)
    assert [tuple(r) for r in encode.strict_model_rows(fine).collect()] == [("a", *good)]
    at = FEATURE_COLUMNS.index("fan_in")
    bad = spark.createDataFrame([("a", *good), ("b", *good[:at], value, *good[at + 1:])], schema)
    with pytest.raises(Exception, match="invalid model value: fan_in"):
        # whatever is read later
        encode.strict_model_rows(bad).select("uid").collect()
