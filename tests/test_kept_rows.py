"""No row of a log vanishes or is kept wrongly; addresses, times and runs keep their meaning."""

from flowsift.functions import scalar
from flowsift.operators import encode
from flowsift.plans import jobs
from flowsift.sources import tables, wire

FIELDS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes",
          "resp_bytes", "orig_pkts", "resp_pkts"]


def line(uid, source="10.0.0.1", **change):
    row = dict(zip(FIELDS, ["5", uid, source, "1", "10.0.0.2", "443", "tcp", "1", "10", "20", "1", "2"])) | change
    return "\t".join(row[f] for f in FIELDS)


def write_log(path, fields, lines):
    path.write_text("\n".join(["#separator \\x09", "#fields\t" + "\t".join(fields), *lines]) + "\n")


def test_quarantine_keeps_every_row_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write_log(logs / "conn.log", FIELDS, [
        line("good"), line("bad", orig_bytes="oops"), line("long") + "\textra", "5\tshort", line("twin"), line("twin")])
    jobs.feature_job(spark, str(logs), "one", str(tmp_path / "out"), "quarantine")
    good = spark.read.parquet(str(tmp_path / "out")).select("flow_id").collect()
    bad = {(r.flow_id, r.violations[0]) for r in spark.read.parquet(str(tmp_path / "out_rejected")).collect()}
    assert [r.flow_id for r in good] == ["good"]
    assert bad == {("bad", "invalid orig_bytes"), ("long", "malformed line"), ("short", "malformed line"),
                   ("twin", "duplicate uid")}
    assert spark.read.parquet(str(tmp_path / "out_rejected")).count() == 5


def test_dns_of_an_ipv6_source_is_counted(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write_log(logs / "conn.log", FIELDS, [line("a", source="2001:0DB8:0:0::1")])
    write_log(logs / "dns.log", ["ts", "uid", "id.orig_h", "query", "qtype_name"],
              ["4\tx\t2001:0DB8:0:0::1\tname.example\tA"])
    jobs.feature_job(spark, str(logs), "one", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().dns_query_count == 1


def test_runs_of_files_with_one_name(spark):
    rows = spark.createDataFrame([("file:///r1/a.parquet", 1), ("file:///r2/a.parquet", 2)], "_path string, n int")
    runs = spark.createDataFrame([("one", "s", "/r1/a.parquet"), ("two", "t", "r2/a.parquet")],
                                 "run_id string, attack_scenario string, parquet_path string")
    got = tables.attach_runs(rows, runs).select("n", "run_id").collect()
    assert sorted(map(tuple, got)) == [(1, "one"), (2, "two")]


def test_times_are_utc_in_any_zone(spark):
    rows = spark.createDataFrame([(0.0,), (1_700_000_000.25,), (-0.5,)], "ts double")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in rows.select(scalar.iso_utc("ts")).collect()] == [
                "1970-01-01T00:00:00.000000+00:00", "2023-11-14T22:13:20.250000+00:00", "1969-12-31T23:59:59.500000+00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_codes_are_fitted_and_applied_alike(spark):
    rows = spark.createDataFrame([(" A",), ("A",), ("-",)], "cipher_suite string")
    codes = encode.fit_frequency(rows, "cipher_suite")
    assert {r.value: r.code for r in codes.collect()} == {"A": 1, "": 2}
    done = encode.apply_codes(rows, codes, "cipher_suite", "code").select("code").collect()
    assert sorted(r.code for r in done) == [1, 1, 2]


def test_dead_letters_can_be_sent_again(spark):
    body = b"\xff" + b"x" * 500
    messages = spark.createDataFrame([(b"\xfe", body)], "key binary, value binary")
    dead = wire.dead_letters(wire.decode(messages)).first()
    assert bytes(dead.value) == body and bytes(dead.key) == b"\xfe" and len(dead.raw) <= 200
