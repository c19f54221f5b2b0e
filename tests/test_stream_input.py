"""Input of catalog streams: parts as files of bounded rows."""

import pytest
from pyspark.sql import functions as F

from flowsift.catalog import ORACLE, QUERIES, streams
from flowsift.streaming.store import children
from tests.oracle import compare, connect


def test_parts_of_a_stream_are_files_of_bounded_rows(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 60)
    folder, rows = str(tmp_path / "in"), spark.range(1000).selectExpr("double(id) ts", "cast(id as string) uid")
    files = streams._files(rows, 4)
    assert files == 5
    streams._in_parts(rows, "ts", folder, 4, files)
    streams._as_batch(streams._heartbeat(rows, "ts", 10.0), folder, files)
    names = [n for n in children(spark, folder) if n.endswith(".parquet")]
    assert len(names) == 25 and max(spark.read.parquet(f"{folder}/{n}").count() for n in names) <= 60
    seen = []
    query = streams._as_stream(spark, folder, files).writeStream.foreachBatch(
        lambda b, n: seen.append(b.agg(F.min("ts"), F.max("ts"), F.count("uid")).first())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) == 5 and sum(s[2] for s in seen) == 1000 and seen[4][:2] == (1009.0, 1009.0)
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
    # a part without rows still fills a batch
    none = str(tmp_path / "none")
    streams._as_batch(rows.where("ts < 0"), none, 3)
    assert sum(n.endswith(".parquet") for n in children(spark, none)) == 3


@pytest.mark.parametrize("name", ["stream_flow_features", "stream_late_flows"])
def test_queries_over_many_files(spark, sf, name, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 60)
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) is None
