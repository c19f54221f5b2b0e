import random

import pytest

from flowsift.operators.dns import dns_events, dns_features
from tests.test_functions import entropy

NAMES = [
    "yrbncq.tunnel.lab", "vaaaakavuke.tunnel.lab",
    "lademw4j322uhxehobwwd205sey3liuq.tunnel.lab", "ianct.tunnel.lab",
]
RATIOS = [f"dns_record_type_{t}_ratio" for t in ("a", "aaaa", "txt", "mx")]


def flows(spark, rows):
    return spark.createDataFrame(rows, "uid string, ts double, src_ip string")


def log(spark, rows, qtype="qtype_name"):
    return spark.createDataFrame(rows, f"uid string, `id.orig_h` string, ts string, query string, {qtype} string")


def run(spark, flow_rows, event_rows, mode="source_window", qtype="qtype_name", **kw):
    got = dns_features(flows(spark, flow_rows), dns_events(log(spark, event_rows, qtype)), mode, **kw).collect()
    return {r.uid: r for r in got}


def test_uid_first(spark):
    events = [("f", "10.0.0.1", str(100.0 + 50 * i), n, "A") for i, n in enumerate(NAMES)]
    for ordered in (events, events[::-1]):
        got = run(spark, [("f", 100.0, "10.0.0.1")], ordered, "uid_first")["f"]
        assert (got.dns_query_count, got.domain_length_mean, got.domain_length_max) == (4, 24.5, 43)
        assert got.dns_query_entropy == pytest.approx(3.543144, abs=1e-6)


def test_uid_first_excludes_other_uids_and_falls_back(spark):
    events = [("f", "s", "100", "a.b", "A"), ("g", "s", "100", "c.d", "A")]
    assert run(spark, [("f", 100.0, "s")], events, "uid_first")["f"].dns_query_count == 1
    events = [("x", "s", "90", "a.b", "A"), ("y", "s", "20", "c.d", "A"), ("z", "s", "110", "e.f", "A")]
    assert run(spark, [("", 100.0, "s")], events, "uid_first")[""].dns_query_count == 1


@pytest.mark.parametrize("types, expected", [
    (["AAAA"], (0, 1, 0, 0)), (["MX"], (0, 0, 0, 1)),
    (["A", "AAAA", "TXT", "MX"], (0.25,) * 4), (["A", "NULL"], (0.5, 0, 0, 0)), (["A", None], (0.5, 0, 0, 0)),
])
def test_record_types(spark, types, expected):
    events = [("f", "s", "100", "a.b", t) for t in types]
    got = run(spark, [("f", 100.0, "s")], events)["f"]
    assert tuple(got[c] for c in RATIOS) == expected


def test_numeric_record_types(spark):
    events = [("f", "s", "100", "a.b", t) for t in ("1", "28", "16", "15")]
    got = run(spark, [("f", 100.0, "s")], events, qtype="qtype")["f"]
    assert tuple(got[c] for c in RATIOS) == (0.25,) * 4


def test_no_events_no_row(spark):
    assert run(spark, [("f", 100.0, "s")], [("g", "s", "100", "", "A"), ("g", "t", "100", "x", "A")]) == {}


@pytest.mark.parametrize("target", [None, 50])
def test_source_window_matches_brute_force(spark, target):
    rng = random.Random(4)
    pick = lambda: round(rng.choice([rng.randint(0, 300), rng.random() * 300, 120 + rng.randint(0, 3)]), 6)
    flow_rows = [(f"u{i}", 1700000000.0 + pick(), rng.choice("aaab")) for i in range(120)]
    events = [("", rng.choice("aaac"), repr(1700000000.0 + pick()), rng.choice(["", *NAMES, "x.y"]), rng.choice(["1", "TXT", "NS"]))
              for _ in range(250)]
    got = run(spark, flow_rows, events, target_rows=target)
    seen = 0
    for uid, ts, src in flow_rows:
        near = [e for e in events if e[1] == src and e[3] and 0 <= round(ts * 1e6) - round(float(e[2]) * 1e6) <= 60e6]
        if not near:
            assert uid not in got
            continue
        seen += 1
        row, n = got[uid], len(near)
        assert row.dns_query_count == n
        assert row.domain_length_max == max(len(e[3]) for e in near)
        assert row.domain_length_mean == pytest.approx(sum(len(e[3]) for e in near) / n)
        assert row.dns_query_entropy == pytest.approx(sum(entropy(e[3]) for e in near) / n)
        assert row.dns_record_type_txt_ratio == pytest.approx(sum(e[4] == "TXT" for e in near) / n)
        assert row.subdomain_count == pytest.approx(sum(e[3].count(".") + 1 for e in near) / n)
    assert seen > 50
