from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowsift.operators import alerts as A
from flowsift.schema import ALERT_SCHEMA

NOW = datetime(2024, 5, 1, 12, 7)


def frame(spark, rows):
    """rows: (id, minutes ago, src, class, severity, evidence, chain)"""
    out = []
    for i, ago, src, cls, sev, evidence, chain in rows:
        at = NOW - timedelta(minutes=ago)
        out.append((i, at, at, f"f{i}", src, "d", 1, 2, "tcp", 0.5, cls, sev, 0.9, 0.1, evidence, "", "", False, False, chain))
    return spark.createDataFrame(out, ALERT_SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    return frame(spark, [
        ("a", 1, "s1", "ddos", "high", ["High packet rate: 5 (supports prediction)"], None),
        ("b", 3, "s1", "port_scan", "info", [], "kc-old"),
        ("c", 8, "s1", "ddos", "critical", None, None),
        ("d", 2, "s2", "ddos", "high", ["TLS traffic detected"], None),
        ("e", 4, "s2", "ddos", "high", [], None),
        ("f", 5, "s3", "c2_beaconing", "medium", [], None),
        ("g", 6, "s3", "exfiltration", "medium", [], None),
        ("h", 11, "s2", "port_scan", "high", [], None),
        ("i", 2, "", "ddos", "high", [], None),
        ("j", 2, "", "port_scan", "high", [], None),
        ("k", 2, "s2", "benign", "info", [], None),
    ])


def ids(df):
    return [r.id for r in df.collect()]


def test_filters(spark, table):
    at = lambda m: NOW - timedelta(minutes=m)
    assert sorted(ids(A.filter_alerts(table, severity="high", src_ip="s2"))) == ["d", "e", "h"]
    assert sorted(ids(A.filter_alerts(table, since=at(3), until=at(2)))) == ["b", "d", "i", "j", "k"]
    assert ids(A.filter_alerts(table, evidence="PACKET nothing")) == ["a"]
    assert ids(A.filter_alerts(table, evidence="acket")) == []
    assert ids(A.filter_alerts(table, evidence="acket", evidence_mode="substring")) == ["a"]
    assert ids(A.alert_by_id(table, "zz")) == []


def test_pages(spark, table):
    rows, info = A.alert_page(table, 2, 4)
    assert ids(rows) == ["k", "b", "e", "f"]
    assert info.first().asDict() == {"total": 11, "page": 2, "page_size": 4, "pages": 3}
    assert A.alert_page(table, 1, 4, src_ip="none")[1].first().pages == 1
    for number, size in ((0, 5), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            A.alert_page(table, number, size)


def test_stats(spark, table):
    stats = A.alert_stats(table, NOW, hours=1)
    assert stats["total"].first()[0] == 11
    assert stats["by_threat_class"].first().asDict() == {"threat_class": "ddos", "n": 5}
    assert stats["by_severity"].first().asDict() == {"severity": "high", "n": 6}
    assert [r.src_ip for r in stats["top_src_ips"].take(2)] == ["s2", "s1"]
    buckets = {r.bucket: r.n for r in stats["timeline"].collect()}
    assert len(buckets) == 13 and sum(buckets.values()) == 11
    assert buckets[datetime(2024, 5, 1, 12, 5)] == 5 and buckets[datetime(2024, 5, 1, 11, 5)] == 0


def test_correlation(spark, table):
    made = {r.id: r.kill_chain_id for r in A.correlate(table, NOW).collect()}
    assert set(made) == {"a", "c", "f", "g"}
    assert made["a"] == made["c"] == "kc-old"
    assert made["f"] == made["g"] and made["f"].startswith("kc-")
    assert {r.id: r.kill_chain_id for r in A.correlate(table, NOW).collect()} == made
    tagged = A.write_back(table, A.correlate(table, NOW))
    assert tagged.columns == table.columns and tagged.count() == 11
    assert A.correlate(tagged, NOW).isEmpty()
    assert A.correlate(table, NOW, max_alerts=2).collect() == []  # c and g only: one class each


def test_kill_chains(spark, table):
    tagged = A.write_back(table, A.correlate(table, NOW))
    chains = A.kill_chains(tagged, NOW - timedelta(hours=1)).collect()
    assert [(c.src_ip, c.stage_count, c.max_severity) for c in chains] == [("s1", 3, "critical"), ("s3", 2, "medium")]
    assert [s.alert_id for s in chains[0].stages] == ["c", "b", "a"]
    assert chains[0].last_seen == NOW - timedelta(minutes=1)
    capped = A.kill_chains(tagged, stages=2, max_chains=1).collect()
    assert len(capped) == 1 and [s.alert_id for s in capped[0].stages] == ["c", "b"] and capped[0].stage_count == 3
    short = A.chain_summary(tagged, NOW - timedelta(minutes=2)).collect()
    assert [(c.chain_id, c.stage_count) for c in short] == [("kc-old", 1)]
    assert A.chain_summary(tagged, NOW - timedelta(minutes=2), min_stages=2).isEmpty()
    drilled = A.stage_alerts(A.chain_stages(tagged), tagged)
    assert drilled.filter("stage = 1").count() == 2 and "evidence" in drilled.columns


def test_to_alerts(spark):
    scored = spark.createDataFrame(
        [("f1", 1700000000.5, "s", "d", 1, 2, "tcp", 0.1, "ddos", "high", 0.8, 0.2, None, "", "", True, False),
         ("f2", 1700000000.5, "s", "d", 1, 2, "tcp", 0.1, "benign", "high", 0.8, 0.2, ["x"], "", "", True, False)],
        "flow_id string, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, duration double,"
        " threat_class string, severity string, confidence double, anomaly_score double, evidence array<string>,"
        " ja3_hash string, ja4_hash string, is_quic boolean, quic_0rtt boolean")
    made = A.to_alerts(scored, F.lit(NOW))
    row = made.first()
    assert made.count() == 1 and made.columns == [f.name for f in ALERT_SCHEMA.fields]
    assert (row.evidence, row.kill_chain_id, row.timestamp) == ([], None, datetime(2023, 11, 14, 22, 13, 20, 500000))
    assert A.flatten_alerts(made).first().dst_port == 2
