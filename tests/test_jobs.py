import os

import pytest
from pyspark.sql import functions as F

from flowsift.operators.enrich import enrich, normalise_conn, quic_features, split_violations, tls_features, to_contract
from flowsift.plans import jobs
from flowsift.schema import FLOW_COLUMNS
from flowsift.sources import tables, wire, zeek

CONN = ["uid", "ts", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p", "proto", "duration",
        "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "conn_state"]
TLS_FLOW = ["C1", "1000.5", "10.0.0.5", "93.184.216.34", "50000", "443", "tcp", "2.0", "128", "64", "2", "1", "SF"]
QUIC_FLOW = ["C2", "1001.5", "10.0.0.5", "142.250.1.1", "50001", "443", "UDP", "-", "-", "-", "-", "-", "SF"]


def write_log(path, fields, rows, separator="\t", header=True):
    lines = [f"#separator {separator.encode('unicode_escape').decode() if separator != chr(9) else chr(92) + 'x09'}"]
    if header:
        lines.append(separator.join(["#fields", *fields]))
    lines += ["#types ignored", *[separator.join(r) for r in rows], "#close 2024"]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def log_dir(tmp_path):
    write_log(tmp_path / "conn.log", CONN, [TLS_FLOW, QUIC_FLOW])
    write_log(tmp_path / "ssl.log", ["uid", "ts", "version", "cipher", "ja3", "ja3s"], [
        ["C1", "1000.6", "-", "TLS_AES_128_GCM_SHA256", "-", "bbb"], ["C1", "1000.7", "TLSv12", "OTHER", "aaa", "ccc"]])
    write_log(tmp_path / "quic.log", ["uid", "ts", "is_quic", "zero_rtt"], [["C2", "1001.5", "T", "F"]])
    return tmp_path


def test_log_reader(spark, log_dir):
    rows = zeek.read_conn_log(spark, str(log_dir / "conn.log")).orderBy("uid").collect()
    assert [r["orig_bytes"] for r in rows] == ["128", "-"] and rows[1]["duration"] is None


def test_log_reader_mixed_layouts_and_separators(spark, tmp_path):
    write_log(tmp_path / "a.log", ["uid", "x"], [["1", "p"], ["2", "-"]])
    write_log(tmp_path / "b.log", ["x", "uid", "y"], [["q", "3", "r|s"]], separator=",")
    got = {r.uid: (r.x, r.y) for r in zeek.read_log(spark, str(tmp_path)).collect()}
    assert got == {"1": ("p", None), "2": (None, None), "3": ("q", "r|s")}


def test_log_reader_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="#fields"):
        zeek.read_log(spark, write_log(tmp_path / "n.log", [], [["1"]], header=False))
    narrow = write_log(tmp_path / "w.log", ["a", "b"], [["1", "2"], ["1"]])
    with pytest.raises(Exception, match="does not match"):
        zeek.read_log(spark, narrow).collect()
    assert [r._malformed for r in zeek.read_log(spark, narrow, mode="quarantine").orderBy("_line").collect()] == [False, True]


def test_a_header_holds_to_the_next_one_of_its_file(spark, tmp_path):
    (tmp_path / "a.log").write_text("1\t2\n#fields\tuid\tx\n1\ta\n#close\n#separator ||\n#fields||x||uid||z\nb||2||c|d\n"
                                    "#separator \\x2c\\x20\n#fields, uid\n3\n")
    got = zeek.read_log(spark, str(tmp_path), mode="quarantine").orderBy("_line").collect()
    assert [(r.uid, r.x, r.z, r._malformed) for r in got] == [
        (None, None, None, True), ("1", "a", None, False), ("2", "b", "c|d", False), ("3", None, None, False)]
    with pytest.raises(Exception, match="does not match"):
        zeek.read_log(spark, str(tmp_path)).select("_file").collect()  # whatever columns are read


def test_layouts_are_one_scan(spark, tmp_path):
    for k in range(12):
        write_log(tmp_path / f"{k}.log", ["uid", f"c{k % 6}"], [[str(k), "v"]])
    read = zeek.read_log(spark, str(tmp_path))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Union" not in plan
    assert {r.uid for r in read.collect()} == {str(k) for k in range(12)} and read.columns[:7] == ["uid", *(f"c{k}" for k in range(6))]


def conn_frame(spark, **changes):
    row = dict(zip(CONN, TLS_FLOW)) | changes
    return spark.createDataFrame([tuple(row[c] for c in CONN)], ", ".join(f"`{c}` string" for c in CONN))


def test_conn_values(spark):
    got = normalise_conn(conn_frame(spark, orig_bytes="-", duration="-3")).first()
    assert (got.orig_bytes, got.resp_bytes, got.duration, got.protocol) == (0, 64, 0.0, "tcp")
    for bad in ("", "12x", "-1", "1.5", None):
        with pytest.raises(Exception, match="orig_bytes"):
            normalise_conn(conn_frame(spark, orig_bytes=bad)).collect()
        assert normalise_conn(conn_frame(spark, orig_bytes=bad), "quarantine").first().violations == ["invalid orig_bytes"]
    with pytest.raises(ValueError, match="orig_pkts"):
        normalise_conn(conn_frame(spark).drop("orig_pkts"))


def test_feature_job(spark, log_dir, tmp_path):
    out = str(tmp_path / "out")
    jobs.feature_job(spark, str(log_dir), "web", out)
    read = tables.read_features(spark, out)
    assert read.drop("scenario").columns == FLOW_COLUMNS
    tls, quic = read.orderBy("flow_id").collect()
    assert (tls.scenario, tls.is_tls, tls.is_quic, tls.ja3_hash, tls.ja3s_hash) == ("web", True, False, "aaa", "bbb")
    assert (tls.tls_version, tls.cipher_suite, tls.bytes_per_sec, tls.packets_per_sec) == (3.0, "TLS_AES_128_GCM_SHA256", 64.0, 1.0)
    assert (quic.is_quic, quic.quic_0rtt, quic.quic_pkt_size_mean, quic.is_tls, quic.ja3_hash) == (True, False, 0.0, False, "")
    assert (quic.protocol, quic.fan_out, quic.iat_mean, quic.connection_frequency) == ("udp", 2.0, 1.0, 2.0)


def test_duplicate_uid_is_an_error(spark):
    flows = spark.createDataFrame([("a",), ("a",)], "uid string")
    with pytest.raises(ValueError, match="duplicate uid: a"):
        enrich(flows)


def test_quic_sizes(spark):
    log = spark.createDataFrame(
        [("a", "F", "[1,2,3]"), ("a", "T", "{6}"), ("b", "-", ""), ("c", None, "[x,-1]")], "uid string, `0rtt` string, pkt_sizes string")
    got = {r.uid: (r.quic_0rtt, r.quic_pkt_size_mean, round(r.quic_pkt_size_std, 6)) for r in quic_features(log).collect()}
    assert got == {"a": (True, 3.0, 1.870829), "b": (False, 0.0, 0.0), "c": (False, 0.0, 0.0)}


def test_tls_first_values_follow_the_order(spark):
    log = spark.createDataFrame([("a", 2.0, "x"), ("a", 1.0, "-"), ("a", 1.5, "y")], "uid string, ts double, JA3 string")
    assert tls_features(log).first().ja3_hash == "y"


def contract_row(spark, **changes):
    base = {"uid": "f", "src_ip": "a", "dst_ip": "b", "protocol": "tcp"}
    from flowsift.schema import FLOW_TYPES
    for name, kind in FLOW_TYPES.items():
        if name not in ("flow_id", "label") and name not in base:
            base[name] = {"double": 1.0, "bigint": 1, "int": 1, "boolean": True, "string": "x"}[kind]
    base |= changes
    kinds = {**FLOW_TYPES, "uid": "string"}
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{c} {kinds[c]}" for c in base))


def test_contract(spark):
    assert to_contract(contract_row(spark)).first().flow_id == "f"
    for change, problem in (({"uid": "-"}, "flow_id"), ({"protocol": "sctp"}, "protocol"), ({"bytes_per_sec": float("inf")}, "bytes_per_sec"),
                            ({"orig_bytes": -1}, "orig_bytes"), ({"src_ip": " "}, "src_ip")):
        good, bad = split_violations(to_contract(contract_row(spark, **change), "quarantine"))
        assert good.isEmpty() and bad.first().violations == [f"invalid {problem}"]
        with pytest.raises(Exception, match=problem):
            to_contract(contract_row(spark, **change)).collect()
        with pytest.raises(Exception, match=problem):  # whatever columns are read
            to_contract(contract_row(spark, **change)).select("duration").collect()


def test_wire_round_trip_and_dead_letters(spark):
    rows = to_contract(contract_row(spark))
    sent = wire.encode(rows)
    assert bytes(sent.first().key) == b"a"
    assert wire.good_rows(wire.decode(sent)).first() == rows.first()
    body = bytes(sent.first().value).decode()
    import json
    less = json.loads(body)
    for name in ("iat_std", "ja4_hash", "label", "is_quic"):
        del less[name]
    short = {k: v for k, v in less.items() if k != "dst_ip"}
    bad = [(b"k", b"\xff\xfe"), (b"k", b"{nope"), (b"k", json.dumps(short).encode()), (None, json.dumps(less).encode()),
           (b"k", json.dumps(less | {"orig_bytes": "many"}).encode())]
    decoded = wire.decode(spark.createDataFrame(bad, "key binary, value binary"))
    assert [r.error_class for r in decoded.collect()] == ["unicode_decode", "json_decode", "schema_mismatch", None, "schema_mismatch"]
    kept = wire.good_rows(decoded).first()
    assert (kept.iat_std, kept.ja4_hash, kept.label, kept.is_quic) == (0.0, "", None, False)
    assert all(len(r.raw) <= 200 for r in wire.dead_letters(decoded).collect())


def test_labels_manifest_and_files(spark, tmp_path):
    labels = tmp_path / "labels"
    os.makedirs(labels)
    (labels / "syn_flood.json").write_text('{"scenario": "syn_flood", "attack_class": "ddos",\n "src_ip": "a", "dst_ip": "b", "pcap": "p"}')
    (labels / "odd.json").write_text('{"scenario": "other", "attack_class": "weird", "src_ip": "a"}')
    (labels / "broken.json").write_text('{"scenario": ')
    read = tables.read_labels(spark, str(labels))
    assert {r.scenario: r.label for r in tables.scenario_classes(read).collect()} == {"syn_flood": "ddos"}
    from flowsift.operators.quality import check_labels
    found = {(r.subject, r.message) for r in check_labels(read).collect()}
    assert found == {("odd", "missing field: dst_ip"), ("odd", "missing field: pcap"), ("odd", "unknown class: weird"),
                     ("odd", "scenario differs from file name: other"), ("broken", "not valid JSON")}
    rows = to_contract(contract_row(spark))
    feats = str(tmp_path / "feats")
    tables.write_features(rows, "syn_flood", feats)
    tables.write_features(rows, "mystery", feats)
    labelled, skipped = tables.attach_labels(tables.read_features(spark, feats), tables.scenario_classes(read))
    assert [(r.scenario, r.label) for r in labelled.collect()] == [("syn_flood", "ddos")]
    assert [(r.scenario, r.rows) for r in skipped.collect()] == [("mystery", 1)]
    with pytest.raises(ValueError):
        tables.write_features(rows, " ", feats)
    classes = tables.scenario_classes(read)
    assert [r.label for r in tables.evaluation_rows(spark, feats, "benign").collect()] == ["benign", "benign"]
    assert [r.label for r in tables.evaluation_rows(spark, feats, classes=classes).collect()] == ["ddos"]
    assert tables.evaluation_rows(spark, feats).count() == 2
    manifest = tmp_path / "runs.csv"
    manifest.write_text("run_id,attack_scenario,profile,pcap_path,zeek_log_dir,parquet_path,seed\nr1,syn_flood,p,a,b,x/one.parquet,7\n")
    runs = tables.read_manifest(spark, str(manifest))
    got = tables.attach_runs(spark.createDataFrame([("/d/one.parquet",), ("/d/two.parquet",)], "_path string"), runs)
    assert [(r.run_id, r.attack_scenario) for r in got.collect()] == [("r1", "syn_flood")]
    for name in ("a.pcap", "syn_flood.pcap"):
        (tmp_path / name).write_text("x")
    assert sorted(r.stem for r in tables.inventory(spark, str(tmp_path), "*.pcap").collect()) == ["a", "syn_flood"]
    report = jobs.check_job(spark, str(labels), feats, str(tmp_path))
    assert {("capture-label", "error", "a"), ("features-label", "error", "mystery")} <= {(r.check, r.severity, r.subject) for r in report.collect()}
