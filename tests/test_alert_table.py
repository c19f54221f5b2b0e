"""The alert table by ingest hour: pruned reads, write-back, retention, word index and feed pages."""

import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from flowsift.operators import alerts as A
from flowsift.sources import alert_table as T
from tests.test_alerts import NOW, frame
from tests.test_plans import plan

MINUTES = [1, 2, 4, 5, 8, 40, 70, 130, 200, 3000]


def many(spark, extra=()):
    classes = ["ddos", "port_scan", "c2_beaconing"]
    rows = [(f"a{i}", m, f"s{i % 2}", classes[i % 3], "high", [f"High rate {i}", "TLS seen" if i % 2 else "plain"], None)
            for i, m in enumerate(MINUTES)]
    return frame(spark, [*rows, *extra])


def files(folder):
    return {os.path.join(at, n): os.path.getmtime(os.path.join(at, n)) for at, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_write_back_touches_only_its_hours(spark, tmp_path):
    folder = str(tmp_path / "alerts")
    T.write_alerts(many(spark), folder)
    before = files(folder)
    hours = T.correlate_table(spark, folder, NOW)
    got = {r.id: r.kill_chain_id for r in T.read_alerts(spark, folder).collect()}
    want = {r.id: r.kill_chain_id for r in A.write_back(many(spark), A.correlate(many(spark), NOW)).collect()}
    assert got == want and any(want.values()) and len(got) == len(MINUTES)
    after = files(folder)
    kept = [f for f in before if int(f.split("hour=")[1].split("/")[0]) not in hours]
    assert kept and all(after.get(f) == before[f] for f in kept) and len(hours) <= 2
    # nothing new: nothing is rewritten
    assert T.correlate_table(spark, folder, NOW) == [] and files(folder) == after


def test_batches_and_look_back(spark, tmp_path):
    folder = str(tmp_path / "alerts")
    T.write_alerts(many(spark), folder, 1)
    T.write_alerts(many(spark), folder, 1)  # a repeated batch leaves the same rows
    T.write_alerts(many(spark).limit(3), folder, 2)
    assert T.read_alerts(spark, folder).count() == len(MINUTES) + 3
    since = NOW - timedelta(minutes=60)
    recent = T.read_alerts(spark, folder, since)
    assert sorted(r.id for r in recent.filter("batch = 1").collect()) == sorted(f"a{i}" for i, m in enumerate(MINUTES) if m <= 60)
    shown = plan(recent)
    assert "PartitionFilters: [isnotnull(hour" in shown and "GreaterThanOrEqual(ingested_at" in shown


def test_retention(spark, tmp_path):
    folder, words = str(tmp_path / "alerts"), str(tmp_path / "words")
    rows = many(spark, [("null", 1, "s", "ddos", "high", ["odd"], None)]).withColumn(
        "ingested_at", F.when(F.col("id") != "null", F.col("ingested_at")))
    T.write_alerts(rows, folder)
    T.index_evidence(rows, words)
    assert T.retain(spark, folder, NOW - timedelta(minutes=130), words) == 2
    kept = {f"a{i}" for i, m in enumerate(MINUTES) if m <= 130} | {"null"}
    assert {r.id for r in T.read_alerts(spark, folder).collect()} == kept
    assert {r.id for r in T.search(spark, folder, words, "high odd").collect()} == kept
    # a day of the postings is dropped as a whole
    assert "a9" not in {r.id for r in T.find(spark, words, "high odd").collect()}
    assert [r.id for r in T.search(spark, folder, words, "odd").collect()] == ["null"]


def test_search(spark, tmp_path):
    folder, words = str(tmp_path / "alerts"), str(tmp_path / "words")
    rows = many(spark, [("none", 1, "s", "ddos", "high", None, None), ("twice", 1, "s", "ddos", "high", ["tls TLS 3"], None)])
    T.write_alerts(rows, folder)
    T.index_evidence(rows, words)
    for query in ("tls", "3 plain", "absent", "TLS absent", "", "!?"):
        got = sorted(r.id for r in T.search(spark, folder, words, query).collect())
        matched = rows.filter(A.evidence_matches(F.concat_ws(" ", "evidence"), query))
        assert got == sorted(r.id for r in matched.collect()), query
    both = T.search(spark, folder, words, "high tls", "all")
    assert sorted(r.id for r in both.collect()) == ["a1", "a3", "a5", "a7", "a9"]
    assert T.search(spark, folder, words, "high absent", "all").count() == 0
    late = T.search(spark, folder, words, "high", since=NOW - timedelta(minutes=4))
    assert sorted(r.id for r in late.collect()) == ["a0", "a1", "a2"]
    shown = plan(T.find(spark, words, "tls"))
    assert "bucket#" in shown.split("PartitionFilters")[1] and "EqualTo(token,tls)" in shown
    with pytest.raises(ValueError):
        T.find(spark, words, "x", "some")


def test_feed_pages(spark, tmp_path):
    folder = str(tmp_path / "feed")
    # ties in time, null times, and a part that a page straddles
    rows = frame(spark, [(f"i{i:03}", i // 7, "s", "ddos", "high", [], None) for i in range(230)]).withColumn(
        "timestamp", F.when(F.col("id") < "i220", F.col("timestamp")))
    T.write_feed(rows, folder, 20)
    assert len(os.listdir(f"{folder}/rows")) >= 8
    order = [r.id for r in rows.orderBy(F.desc("timestamp"), F.asc("id")).collect()]
    for number, size in ((1, 20), (2, 33), (7, 33), (23, 10), (24, 10), (1, 100)):
        page = T.feed_page(spark, folder, number, size)
        assert [r.id for r in page.collect()] == order[(number - 1) * size : number * size]
    shown = plan(T.feed_page(spark, folder, 5, 10))
    assert "part#" in shown.split("PartitionFilters")[1].split("PushedFilters")[0]
    read = T.feed_page(spark, folder, 5, 10)
    assert len(read.inputFiles()) >= 1
    T.write_feed(rows.limit(0), folder, 20)
    assert T.feed_page(spark, folder).count() == 0
    for number, size in ((0, 5), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            T.feed_page(spark, folder, number, size)
