"""Physical plans: what is pruned, pushed down and shuffled."""

import pytest

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange ")


@pytest.mark.parametrize("name, most", [
    ("rolling_source", 1), ("rolling_fan_in", 1), ("arrival_intervals", 1), ("flow_windows", 2), ("dns_window", 2),
    ("correlate", 3), ("chain_summary", 5), ("classification_report", 6), ("contract_violations", 7), ("score_summary", 2), ("first_orders", 1),
])
def test_shuffle_counts(spark, sf, name, most):
    assert exchanges(QUERIES[name](spark, sf)) <= most


@pytest.mark.parametrize("name", ["first_orders", "chain_stages"])
def test_group_limits_run_before_the_shuffle(spark, sf, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["alert_page", "latest_points", "stats_top_sources"])
def test_top_k_does_not_sort_everything(spark, sf, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf))


def test_alert_filters_reach_the_scan(spark, tmp_path):
    from flowsift.operators import alerts as A
    from tests.test_alerts import NOW, frame

    path = str(tmp_path / "alerts")
    frame(spark, [("a", 1, "s", "ddos", "high", [], None)]).write.parquet(path)
    shown = plan(A.filter_alerts(spark.read.parquet(path), severity="high", since=NOW).select("id"))
    assert "EqualTo(severity,high)" in shown and "GreaterThanOrEqual(timestamp" in shown
    assert "evidence" not in shown.split("ReadSchema")[1]


def test_no_cartesian_products_or_driver_sorts(spark, sf):
    for name, query in QUERIES.items():
        if name.startswith("stream_") or name in ("scored_flows", "trained_predictions", "boosted_predictions", "isolation_scores"):
            continue
        assert "CartesianProduct" not in plan(query(spark, sf)), name
        assert "BroadcastNestedLoopJoin" not in plan(query(spark, sf)), name


def test_scan_reads_only_needed_columns(spark, sf):
    shown = plan(QUERIES["rolling_fan_in"](spark, sf))
    assert "value" not in shown.split("ReadSchema:")[1]
    assert "event_id" in shown.split("ReadSchema:")[1]
