import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowsift.operators import alerts as A
from flowsift.operators.dns import source_window_dns
from flowsift.operators.enrich import to_contract
from flowsift.sources import wire, zeek
from flowsift.sources.tail import TailedLog
from flowsift.streaming import ingest, metrics
from flowsift.streaming.correlation import correlation_cycle, new_chain, start_correlation, tagged_alerts
from flowsift.streaming.features import split_features, start_features
from flowsift.streaming.names import start_queries
from flowsift.streaming.scoring import score_batches
from flowsift.streaming.store import batch_numbers, drop_partitions_before, read_table, state_root
from tests.test_jobs import CONN, QUIC_FLOW, TLS_FLOW, contract_row, write_log
from tests.test_models import trained  # noqa: F401
from tests.test_rolling import FLOWS, brute, compare, make_flows



def test_stream_features_equal_batch(spark, tmp_path):
    """Four files in time order, one per batch, the query stopped and started again in between."""
    rows = sorted(make_flows(240, 6), key=lambda r: (r[1], r[0]))
    source, root = tmp_path / "flows", str(tmp_path / "out")

    def send(part):
        spark.createDataFrame(part, FLOWS).coalesce(1).write.mode("append").parquet(str(source))

    def drain():
        stream = spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = start_features(stream, root, 60.0, lateness_seconds=30.0, once=True)
        query.awaitTermination()
        assert query.exception() is None

    draw = random.Random(1)
    for i in range(4):
        part = rows[i * 60:(i + 1) * 60]
        draw.shuffle(part)  # within the lateness any order will do
        if i == 3:
            part = part + [("late", 1700000000.0, "as", "d0", 1, "x"), ("none", None, "as", "d0", 1, "y")]
        send(part)
        if i == 1:
            drain()
    drain()
    horizon = max(r[1] for r in rows) - 30.0
    got = read_table(spark, f"{root}/features").collect()
    assert {r.uid for r in got} == {r[0] for r in rows if r[1] <= horizon}
    expected = brute(rows, 60.0)
    compare(got, {r.uid: expected[r.uid] for r in got})
    assert {r.uid: r.note for r in got} == {r[0]: r[5] for r in rows if r[1] <= horizon}
    late = read_table(spark, f"{root}/late")
    assert sorted((r.uid, r.note) for r in late.collect()) == [("late", "x"), ("none", "y")]
    assert set(spark.createDataFrame([], FLOWS).columns) <= set(late.columns)
    # a heartbeat flushes what still waits
    send([(None, 1700010000.0, None, None, None, None)])
    drain()
    got = read_table(spark, f"{root}/features").collect()
    compare(got, expected)
    # a batch that runs again leaves the same rows
    again = spark.read.parquet(f"{root}/halves/batch=2")
    split_features(root)(spark.createDataFrame(again.collect(), again.schema), 2)
    assert read_table(spark, f"{root}/features").count() == len(rows)


def test_silent_sources_are_forgotten(spark, tmp_path):
    at = [0.0, 1.0, 3.0, 500.0, 504.0, 1500.0]
    source = str(tmp_path / "flows")
    for k, t in enumerate(at):
        spark.createDataFrame([(f"u{k}", 1000.0 + t, "s", "d", None, "")], FLOWS).coalesce(1).write.mode("append").parquet(source)
    for name, forget, want in (("kept", None, 126.0), ("gone", 100.0, 4.0)):
        stream = spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", 1).parquet(source)
        root = str(tmp_path / name)
        start_features(stream, root, 10.0, 0.0, forget, once=True).awaitTermination()
        got = {r.uid: r for r in read_table(spark, f"{root}/features").collect()}
        assert got["u2"].iat_mean == 1.5 and got["u4"].iat_mean == want and got["u4"].connection_frequency == 2.0
        assert got["u4"].unique_dst_ports == 1 and got["u4"].fan_in == 1.0


def test_stream_queries_equal_batch(spark, tmp_path):
    """Flows and queries in four files each, ties and bounds of the window included, then late rows of both."""
    draw = random.Random(9)
    at = lambda: 1000.0 + draw.choice([draw.randint(0, 300), round(300 * draw.random(), 6)])
    made = sorted(((f"f{k}", at(), draw.choice(["a", "a", "b", None])) for k in range(160)), key=lambda r: r[1])
    asked = sorted((("u", draw.choice(["a", "a", "b", "c", None]), at(), draw.choice(["x.lab", "mail.long.lab", "", "y"]),
                     draw.choice(["A", "TXT", "MX"])) for _ in range(200)), key=lambda r: r[2])
    flows, queries = "uid string, ts double, src_ip string", "uid string, src_ip string, ts double, query string, qtype string"
    end = 5000.0
    for k in range(4):
        spark.createDataFrame(made[40 * k:40 * k + 40], flows).coalesce(1).write.mode("append").parquet(str(tmp_path / "flows"))
        spark.createDataFrame(asked[50 * k:50 * k + 50], queries).coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
    spark.createDataFrame([(None, end, None)], flows).coalesce(1).write.mode("append").parquet(str(tmp_path / "flows"))
    spark.createDataFrame([(None, None, end, None, None)], queries).coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
    root = str(tmp_path / "out")

    def drain():
        of = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        start_queries(of(flows, "flows"), of(queries, "asked"), root, 60.0, 1.0, 1.0, once=True).awaitTermination()

    drain()
    got = {r.uid: r for r in read_table(spark, f"{root}/dns").drop("batch").collect()}
    batch = source_window_dns(spark.createDataFrame(made, flows), spark.createDataFrame(asked, queries), 60.0)
    expected = {r.uid: r for r in batch.collect()}
    assert got.keys() == expected.keys() and len(got) > 100
    for uid, row in expected.items():
        assert tuple(got[uid][c] for c in batch.columns[1:]) == pytest.approx(tuple(row)[1:]), uid
    spark.createDataFrame([("late", 1001.0, "a"), ("none", None, "a")], flows).coalesce(1).write.mode("append").parquet(str(tmp_path / "flows"))
    spark.createDataFrame([("q", "a", 1001.0, "x.lab", "A")], queries).coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
    drain()
    assert sorted((r.flow, r.uid) for r in read_table(spark, f"{root}/late").collect()) == [(False, "q"), (True, "late"), (True, "none")]
    assert read_table(spark, f"{root}/dns").count() == len(expected)


def test_dead_letters_and_deduplication(spark, tmp_path):
    sent = wire.encode(to_contract(contract_row(spark)))
    bad = spark.createDataFrame([(b"k", b"\xff"), (b"k", b"{")], ingest.MESSAGE_SCHEMA)
    inbox = str(tmp_path / "inbox")
    sent.unionByName(bad).write.parquet(inbox)
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    ingest.start_batches(ingest.file_messages(spark, inbox), ingest.split_messages(good, dead), str(tmp_path / "c1"), once=True).awaitTermination()
    assert read_table(spark, good).count() == 1
    assert sorted(r.error_class for r in read_table(spark, dead).collect()) == ["json_decode", "unicode_decode"]
    # the same row sent three times
    again = str(tmp_path / "again")
    for _ in range(3):
        sent.write.mode("append").parquet(again)
    rows = wire.good_rows(wire.decode(ingest.file_messages(spark, again, 1)))
    out = str(tmp_path / "unique")
    ingest.deduplicate(rows).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(
        availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_publish(spark, tmp_path):
    rows = str(tmp_path / "rows")
    to_contract(contract_row(spark)).write.parquet(rows)
    stream = spark.readStream.schema(spark.read.parquet(rows).schema).parquet(rows)
    query = ingest.publish(stream, str(tmp_path / "ck"), path=str(tmp_path / "topic"))
    query.processAllAvailable()
    query.stop()
    assert bytes(spark.read.parquet(str(tmp_path / "topic")).first().key) == b"a"


def test_log_stream(spark, tmp_path):
    logs = tmp_path / "logs"
    (logs / "day").mkdir(parents=True)
    write_log(logs / "conn.log", CONN, [TLS_FLOW])
    write_log(logs / "day" / "conn.2024.log", CONN, [QUIC_FLOW])
    write_log(logs / "other.log", CONN, [QUIC_FLOW])
    stream = zeek.stream_log(spark, str(logs), CONN, ["orig_bytes"])
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted((r.uid, r.orig_bytes, r.duration) for r in spark.read.parquet(out).collect()) == [("C1", "128", "2.0"), ("C2", "-", None)]


def test_lines_added_to_a_file_come_out_once(spark, tmp_path):
    logs, good, dead = tmp_path / "logs", str(tmp_path / "rows"), str(tmp_path / "dead")
    logs.mkdir()
    row = lambda k: "\t".join([f"C{k}", *TLS_FLOW[1:]])
    write_log(logs / "conn.log", CONN, [[f"C{k}", *TLS_FLOW[1:]] for k in range(7)])
    (logs / "conn.plain.log").write_text(row(50) + "\n")  # no header: the given fields

    def drain(*actions):
        stream = ingest.tail_log(spark, str(logs), CONN, str(tmp_path / "progress"), ["orig_bytes"], max_rows=3)
        query = ingest.start_batches(stream, ingest.split_log(good, dead), str(tmp_path / "ck"), interval="0 seconds")
        query.processAllAvailable()
        for act in actions:
            act()
            query.processAllAvailable()
        query.stop()
        return [r.uid for r in read_table(spark, good).orderBy("uid").collect()]

    def add(text):
        with open(logs / "conn.log", "a") as file:
            file.write(text)

    assert drain() == sorted([*(f"C{k}" for k in range(7)), "C50"])
    sizes = [read_table(spark, good).where(F.col("batch") == n).count() for n in range(3)]
    assert sizes == [3, 3, 2]
    # a line is complete when its end is written; a new header changes the order of the columns
    swapped = ["ts", "uid", *CONN[2:]]
    got = drain(lambda: add(row(8)), lambda: add("\n" + row(9) + "\n"), lambda: add("#fields\t" + "\t".join(swapped) + "\n"),
                lambda: add("\t".join(["7.5", "C10", *TLS_FLOW[2:]]) + "\n" + "torn\tline\n"))
    assert got == sorted([*(f"C{k}" for k in range(7)), "C8", "C9", "C10", "C50"])
    assert drain() == got
    assert read_table(spark, good).where("uid = 'C10'").first().ts == "7.5"
    assert [r._raw for r in read_table(spark, dead).collect()] == ["torn\tline"]
    # a file written anew starts over
    got = drain(lambda: write_log(logs / "conn.log", CONN, [["N1", *TLS_FLOW[1:]]]))
    assert "N1" in got and len(got) == 12
    with pytest.raises(ValueError, match="progress"):
        TailedLog({"path": str(logs), "maxRows": "3"}).streamReader(None)


def test_only_batches_with_torn_lines_write_them(spark, tmp_path):
    logs, good, dead = tmp_path / "logs", str(tmp_path / "rows"), str(tmp_path / "dead")
    logs.mkdir()
    write_log(logs / "conn.log", CONN, [[f"C{k}", *TLS_FLOW[1:]] for k in range(8)] + [["torn"]])
    stream = ingest.tail_log(spark, str(logs), CONN, str(tmp_path / "progress"), max_rows=3)
    query = ingest.start_batches(stream, ingest.split_log(good, dead), str(tmp_path / "ck"), interval="0 seconds")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.uid for r in read_table(spark, good).collect()) == [f"C{k}" for k in range(8)]
    assert [(r.batch, r._raw) for r in read_table(spark, dead).collect()] == [(2, "torn")]
    # the first one makes the table, the second one has none to write
    assert batch_numbers(spark, dead) == [0, 2]


def test_log_stream_keeps_torn_lines(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write_log(logs / "conn.log", CONN, [TLS_FLOW, TLS_FLOW[:5], [*QUIC_FLOW, "more"]])
    # another log of as many columns
    write_log(logs / "dns.log", [f"c{k}" for k in range(len(CONN))], [QUIC_FLOW])
    good, dead = str(tmp_path / "rows"), str(tmp_path / "dead")
    stream = zeek.stream_log(spark, str(logs), CONN, ["orig_bytes"])
    ingest.start_batches(stream, ingest.split_log(good, dead), str(tmp_path / "ck"), once=True).awaitTermination()
    rows = read_table(spark, good)
    assert set(CONN) <= set(rows.columns) and [r.uid for r in rows.collect()] == ["C1"]
    letters = read_table(spark, dead).collect()
    assert sorted(r._raw for r in letters) == ["\t".join(TLS_FLOW[:5]), "\t".join([*QUIC_FLOW, "more"])]
    assert all(r._file.endswith("/conn.log") for r in letters)
    with pytest.raises(ValueError, match="glob"):
        zeek.stream_log(spark, str(logs), ["ts", "query"])


def test_score_stream_and_correlate(spark, tmp_path, trained):  # noqa: F811
    from flowsift.plans import jobs

    rows, out, _ = trained
    models = jobs.load_models(spark, out)
    source = str(tmp_path / "rows")
    rows.drop("scenario", "label").withColumn("label", F.lit(None).cast("string")).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    root = str(tmp_path / "live")
    ticks = iter([1000.0, 1000.5])
    ingest.start_batches(stream, score_batches(models, root, lambda: next(ticks)), str(tmp_path / "ck"), once=True).awaitTermination()
    results, alerts = read_table(spark, f"{root}/results"), read_table(spark, f"{root}/alerts")
    messages = read_table(spark, f"{root}/messages").collect()
    assert len(messages) == 240 and all(bytes(m.key) == b"s" for m in messages)
    assert {json.loads(bytes(m.value))["flow_id"] for m in messages} == {r.flow_id for r in results.collect()}
    assert results.count() == 240 and results.filter("latency_ms = 500").count() == 240
    assert alerts.count() == results.filter("threat_class <> 'benign'").count() > 100
    (point,) = read_table(spark, f"{root}/metrics").collect()  # 240 flows in the half second the batch took
    assert (point.window_flows, point.flows_per_sec, point.latency_ms_mean) == (240, 480.0, 500.0)
    assert point.kafka_queue_depth == -1
    now = datetime.fromtimestamp(1000.5, timezone.utc)
    for cycle in (0, 1):
        correlation_cycle(spark, f"{root}/alerts", f"{root}/chains", now, cycle)
    tagged = tagged_alerts(spark, f"{root}/alerts", f"{root}/chains")
    assert tagged.count() == alerts.count() and tagged.filter("kill_chain_id is null").isEmpty()
    assert A.chain_summary(tagged).count() == 1
    assert drop_partitions_before(spark, f"{root}/alerts/batch=0", "hour", "1970-01-02") == ["hour=1970-01-01-00"]


def test_correlation_cycles_equal_repeated_batch_cycles(spark, tmp_path):
    """Every cycle in turn over a whole table, chain ids carried on, against keyed state over four files."""
    draw = random.Random(4)
    schema = "id string, src_ip string, threat_class string, kill_chain_id string, ingested_at timestamp"
    start = datetime(2024, 1, 1)
    rows = []
    for k in range(120):
        at = start + timedelta(milliseconds=draw.randint(0, 600_000), microseconds=draw.randint(0, 999))
        rows.append((f"al{k:03d}", draw.choice(["a", "a", "b", "c", "", None]), draw.choice(["ddos", "ddos", "port_scan", "benign"]),
                     f"kc-old{k}" if draw.random() < 0.05 else None, at))
    rows.sort(key=lambda r: r[4])
    lookback, cycle = timedelta(seconds=90), timedelta(seconds=30)
    chain, first = {r[0]: r[3] for r in rows}, None
    for n in range(1, 24):
        now = start + n * cycle
        seen = [r for r in rows if now - lookback <= r[4] <= now and r[2] != "benign" and r[1]]
        before = dict(chain)
        for source in {r[1] for r in seen}:
            own = [r for r in seen if r[1] == source]
            if len({r[2] for r in own}) >= 2:
                old = [before[r[0]] for r in own if before[r[0]]]
                for r in own:
                    chain[r[0]] = chain[r[0]] or (old[0] if old else new_chain(source, own[0][0]))
        given = {i: c for i, c in chain.items() if c != before[i]}
        first = first or (given and (now, given)) or None
    expected = {i: c for i, c in chain.items() if c and not dict((r[0], r[3]) for r in rows)[i]}
    inbox = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(rows[30 * k:30 * k + 30], schema).coalesce(1).write.mode("append").parquet(inbox)
    spark.createDataFrame([(None, None, None, None, start + timedelta(hours=1))], schema).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    start_correlation(stream, str(tmp_path / "chains"), str(tmp_path / "state"), lookback, cycle, "0 seconds", once=True).awaitTermination()
    found = read_table(spark, str(tmp_path / "chains"))
    got = [(r.id, r.kill_chain_id) for r in found.collect()]
    assert len(got) == len(dict(got)) and dict(got) == expected and len(got) > 30
    assert found.select("batch").distinct().count() > 2
    # the first cycle that assigns anything is one run of the batch operator
    now, given = first
    table = spark.createDataFrame(rows, schema).where(F.col("ingested_at") <= F.lit(now))
    assert {r.id: r.kill_chain_id for r in A.correlate(table, now, lookback).collect()} == given


def test_throughput_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    shaped = lambda df: df.select(F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("flow_id"),
                                  F.length("props").alias("bytes"), F.col("value").alias("latency_ms"))
    source = str(tmp_path / "ev")
    events.coalesce(1).write.parquet(source)
    stream = shaped(spark.readStream.schema(events.schema).parquet(source)).withWatermark("event_time", "1 hour")
    query = metrics.throughput(stream, 3600).writeStream.outputMode("complete").format("memory").queryName("tp").trigger(
        availableNow=True).start()
    query.awaitTermination()
    a = sorted(map(tuple, spark.table("tp").collect()))
    assert a == sorted(map(tuple, metrics.throughput(shaped(events), 3600).collect())) and len(a) > 10


def test_queue_depth_and_counters(spark):
    produced = spark.createDataFrame([(0, 5), (0, 9), (1, 4)], "partition int, offset bigint")
    committed = spark.createDataFrame([(0, 7)], "partition int, offset bigint")
    assert {tuple(r) for r in metrics.queue_depth(produced, committed).collect()} == {(0, 2), (1, -1)}
    progress = {"sources": [{"latestOffset": {"t": {"0": 10, "1": 4}}, "endOffset": {"t": {"0": 7, "1": 4}}}]}
    assert metrics.progress_depth(progress) == 3
    assert metrics.progress_depth({"sources": [{"latestOffset": None, "endOffset": None}]}) == -1
    outcomes = spark.createDataFrame(
        [(datetime(2024, 1, 1, 0, 0, s), o, b) for s, o, b in [(1, "published", 1), (2, "published", 1), (9, "dropped", 2), (11, "error", 3)]],
        "event_time timestamp, outcome string, batch_id int")
    got = [tuple(r)[1:] for r in metrics.outcome_counters(outcomes).orderBy("ts").collect()]
    assert got == [(2, 1, 0, 2), (0, 0, 1, 1)]


def test_state_root(spark):
    assert state_root(spark, "x", "/tmp/shared/") in ("/tmp/shared/x", f"{spark.conf.get('spark.checkpoint.dir', '')}/x")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            state_root(spark, "x")
