import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowsift.functions import evidence as E
from flowsift.functions import scalar as S
from flowsift.schema import FEATURE_COLUMNS


def one(spark, values, kind, expr):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_numbers(spark):
    got = one(spark, [" 1.5", "-", "", None, "nan", "inf", "x"], "string", S.number_or)
    assert got == [1.5, 0, 0, 0, 0, 0, 0]


def test_counts(spark):
    got = one(spark, ["-", "42", "42.0", "1.5", "-1", "", None, "12x", "inf", "9007199254740993"], "string", S.count_value)
    assert got == [0, 42, 42, None, None, None, None, None, None, 9007199254740993]


def test_strict_value_ends_the_job(spark):
    df = spark.createDataFrame([("12x",)], "v string")
    with pytest.raises(Exception, match="orig_bytes"):
        df.select(S.required(S.count_value("v"), "invalid required value: orig_bytes")).collect()


def test_safe_divide(spark):
    df = spark.createDataFrame([(6.0, 2.0), (1.0, 0.0), (1.0, 1e-10), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(S.safe_divide("a", "b")).collect()] == [3.0, 0.0, 0.0, 0.0]


def test_addresses(spark):
    values = ["10.0.0.1", "2001:0DB8::0001", "not:an:ip", "host", " ", "-", None]
    assert one(spark, values, "string", S.clean_ip) == ["10.0.0.1", "2001:db8::1", "not:an:ip", "host", "", "", ""]


def entropy(text):
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def test_char_entropy(spark):
    names = ["yrbncq.tunnel.lab", "aaaa", "", "AbaB", "vaaaakavuke.tunnel.lab", "ü√ü", "x" * 5000 + "y" * 5000]
    got = one(spark, names, "string", S.char_entropy)
    assert got == pytest.approx([entropy(n) for n in names], abs=1e-9)
    assert one(spark, [None], "string", S.char_entropy) == [0.0]


def test_labels_and_types(spark):
    assert one(spark, ["a.b.c", "a.b...", "", "..", None, "a"], "string", S.label_count) == [3, 2, 0, 0, 0, 1]
    assert one(spark, ["1", "28.0", "aaaa", "16", "15", "99", "-", None], "string", S.dns_qtype) == [
        "A", "AAAA", "AAAA", "TXT", "MX", "99", "", ""]


def test_tls_ordinal(spark):
    values = ["TLSv12", "tls 1.3", "TLSv1", "TLS_1.0", "TLS11", "SSLv3", None, "TLSv1.2"]
    assert one(spark, values, "string", S.tls_ordinal) == [3, 4, 0, 1, 2, 0, 0, 3]


def test_flags_and_sizes(spark):
    assert one(spark, ["T", "yes", "on", "1", "0", "", None, "F"], "string", S.truthy) == [True] * 4 + [False] * 4
    assert one(spark, [2.0, 0.0, None, math.nan], "double", S.truthy_number) == [True, False, False, False]
    assert one(spark, ["[1,2, 3]", "{4}", "", None, "[-1,x,5]"], "string", S.packet_sizes) == [
        [1.0, 2.0, 3.0], [4.0], [], [], [5.0]]


def test_severity_and_decision(spark):
    assert one(spark, [0.9, 0.89, 0.75, 0.5, 0.49], "double", S.severity) == ["critical", "high", "high", "medium", "info"]
    df = spark.createDataFrame(
        [([0.4, 0.3, 0.1, 0.1, 0.05, 0.03, 0.02], 0.6), ([0.4, 0.3, 0.1, 0.1, 0.05, 0.03, 0.02], 0.5),
         ([0.1, 0.45, 0.1, 0.1, 0.1, 0.1, 0.05], 0.9), ([0.9, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0], 0.9)], "p array<double>, a double")
    service = [r[0].threat_class for r in df.select(S.decide("p", "a")).collect()]
    library = [r[0].threat_class for r in df.select(S.decide("p", "a", policy="library")).collect()]
    assert service == ["unknown_anomaly", "benign", "c2_beaconing", "benign"]
    assert library == ["unknown_anomaly"] * 3 + ["benign"]


def test_class_codes(spark):
    assert one(spark, ["benign", "port_scan", "nope"], "string", S.class_index) == [0, 6, None]
    assert one(spark, [0, 5], "int", S.class_name) == ["benign", "malware_tls"]
    assert one(spark, [0.8, 1.6, -0.1, 0.4], "double", S.anomaly_norm) == pytest.approx([1.0, 1.0, 0.0, 0.5])


def test_fingerprints(spark):
    import hashlib

    df = spark.createDataFrame(
        [(771, [2570, 4865, 0x0A1A], [0, 23], [29, 64250], [0])],
        "v int, c array<int>, e array<int>, g array<int>, f array<int>")
    got = df.select(S.ja3("v", "c", "e", "g", "f"), S.ja3s("v", F.lit(4865)), S.ja3s("v", F.lit(2570))).first()
    assert got[0] == hashlib.md5(b"771,4865-2586,0-23,29,0").hexdigest()
    assert got[1] == hashlib.md5(b"771,4865,").hexdigest() and got[2] is None


def test_latency_and_time(spark):
    assert one(spark, [99.9, 100.0, 499.0, 500.0], "double", S.latency_band) == ["green", "yellow", "yellow", "red"]
    assert one(spark, [1700000000.25], "double", S.iso_utc) == ["2023-11-14T22:13:20.250000+00:00"]


@pytest.mark.parametrize("value", [
    0.0, 1.0, 2.5, 1234.0, 1234.5, 9999.6, 12345.0, 99999.0, 0.0001, 0.00012344, 0.00001, 123.25, 12355.0, -12345.0, 1234.75, 16777216.5, 1e-9, 1e10, -3.14159, 100.0, 0.1,
])
def test_four_digits(spark, value):
    assert one(spark, [value], "double", E.g4) == [f"{value:.4g}"]


def evidence(spark, contributions, top_k=5, values=None):
    values = values or [float(i + 1) for i in range(len(FEATURE_COLUMNS))]
    df = spark.createDataFrame([(values, contributions)], "v array<double>, c array<double>")
    return df.select(E.top_contributions(F.col("v"), F.col("c"), top_k).alias("t")).select(
        "t", E.evidence_texts(F.col("t")).alias("s")).first()


def test_top_contributions(spark):
    zeros = [0.0] * 33
    got = evidence(spark, [0.2, -1.5, 0.7, *zeros])
    assert [FEATURE_COLUMNS.index(t.feature) for t in got.t][:3] == [1, 2, 0]
    assert [t.direction for t in got.t][:3] == ["opposes", "supports", "supports"]
    assert len(got.t) == 5
    assert len(evidence(spark, [0.0] * 36, 999).t) == 36
    with pytest.raises(ValueError):
        E.top_contributions(F.col("v"), F.col("c"), 0)


def test_contributions_are_ranked_and_told_in_batches(spark):
    """Ties, nulls, no numbers and rows of several lengths; no array of all features is sorted row by row."""
    names = ["duration", "is_tls", "fan_out"]
    rows = [([1.0, 2.0, 3.0], [0.5, -0.5, 0.5]), ([1.5, 0.0, None], [0.0, 2.0, -3.0]), ([1e-7, 1.0, 123456.0], [-0.0, 1.0, float("nan")]),
            ([1.0, 2.0, 3.0], [1.0, None, -2.0]), ([4.0], [1.0]), ([], []), (None, None)]
    expected = [
        ["Connection duration: 1 (supports prediction)", "TLS traffic detected (opposes prediction)"],
        [None, "TLS traffic detected: 0 (supports prediction)"],
        ["TLS traffic detected (supports prediction)", "Connection duration: 1e-07 (supports prediction)"],
        ["TLS traffic detected (opposes prediction)", "Connections to many destinations: 3 (opposes prediction)"],
        ["Connection duration: 4 (supports prediction)"], [], None,
    ]
    schema = "n int, v array<double>, c array<double>"
    for part in (range(7), range(1), [2]):  # together, and full rows by themselves
        df = spark.createDataFrame([(n, *rows[n]) for n in part], schema).coalesce(1)
        told = df.select("n", E.evidence_texts(E.top_contributions(F.col("v"), F.col("c"), 2, names)).alias("s"))
        assert {r.n: r.s for r in told.collect()} == {n: expected[n] for n in part}
    assert "array_sort" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_text(spark):
    got = evidence(spark, [5.0, -4.0, 3.0, -2.0, 1.0, 0.5, *[0.0] * 30])
    assert list(got.s) == [
        "High packet rate: 1 (supports prediction)",
        "High traffic volume: 2 (opposes prediction)",
        "High outbound traffic ratio: 3 (supports prediction)",
        "Large originator byte volume: 4 (opposes prediction)",
        "Large responder byte volume: 5 (supports prediction)",
    ]
    flags = [0.0] * 36
    flags[FEATURE_COLUMNS.index("is_tls")] = 2.0
    assert evidence(spark, flags, 1).s == ["TLS traffic detected (supports prediction)"]
    off = [0.0] * 36
    assert evidence(spark, flags, 1, off).s == ["TLS traffic detected: 0 (supports prediction)"]
