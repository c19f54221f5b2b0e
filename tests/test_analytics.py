import os
import math
import random

import pytest
from pyspark.sql import functions as F

from flowsift.operators import encode, evaluate, ordering, quality
from flowsift.operators.joins import lookup_join
from flowsift.schema import FEATURE_COLUMNS
from tests.test_jobs import contract_row
from flowsift.operators.enrich import to_contract


@pytest.mark.parametrize("target", [None, 40])
def test_exact_quantiles(spark, target):
    import numpy as np

    rng = random.Random(1)
    values = [float(rng.choice([rng.randint(0, 5), rng.random() * 100])) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r.quantile: r.value for r in ordering.exact_quantiles(df, "v", [0.0, 0.5, 0.99, 1.0], target).collect()}
    for q, value in got.items():
        assert value == pytest.approx(float(np.percentile(values, q * 100)), abs=1e-12)
    row = ordering.score_summary(df, "v").first()
    assert (row.rows, row.median, row.threshold) == (500, got[0.5], got[0.99])


def test_quantiles_one_to_ten(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    assert ordering.exact_quantiles(df, "v", [0.99]).first().value == pytest.approx(9.91)


def test_quantiles_of_odd_values(spark):
    numbers = [-math.inf, -1.7e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.0, 1.0000000000000002, 1.7e308, math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in numbers] + [(None,)], "v double")
    got = [r.value for r in ordering.exact_quantiles(df, "v", [i / 11 for i in range(12)]).collect()]
    # ranks by hand: i / 11 * 11 may miss i by a rounding, which only blends equal or near neighbours
    for i in (0, 1, 2, 4, 6, 7, 9):
        assert i / 11 * 11 != i or got[i] == numbers[i]
    assert math.isnan(got[11])
    empty = ordering.exact_quantiles(df.limit(0), "v", [0.5]).first()
    assert empty.value is None and ordering.score_summary(df.limit(0), "v").first().rows == 0
    same = spark.createDataFrame([(7.0,)] * 50, "v double")
    assert ordering.score_summary(same, "v").first()[1:] == (7.0, 7.0, 7.0, 7.0, 7.0)


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 50, 100, 100]], "v double")
    rows = ordering.histogram(df, "v", 50).orderBy("bin").collect()
    assert len(rows) == 50 and sum(r.rows for r in rows) == 6
    assert rows[0].rows == 2 and rows[1].rows == 1 and rows[49].rows == 2
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert sum(r.rows for r in ordering.histogram(same, "v", 5).collect()) == 2


def test_lookup_join_large_side_is_salted(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "i int, k string")
    side = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        small = lookup_join(rows, side, "k", how)
        large = lookup_join(rows, side, "k", how, max_rows=1, row_id="i")
        assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)


def test_latest(spark):
    df = spark.range(50).select(F.col("id").alias("ts"))
    assert [r.ts for r in ordering.latest(df, "ts", 30).collect()] == list(range(20, 50))


def test_frequency_codes(spark):
    rows = spark.createDataFrame([(v,) for v in ["b", "b", "a", "c", "c", "", None]], "ja4_hash string")
    codes = encode.fit_encoders(rows, top_n=3)
    assert {r.value: r.code for r in codes.collect()} == {"b": 1, "c": 2, "": 3}
    known = spark.createDataFrame([("ja4_hash", "KNOWN", 7), ("cipher_suite", "TLS_AES_128_GCM_SHA256", 3)], "column string, value string, code int")
    raw = spark.createDataFrame([("KNOWN", "TLS_AES_128_GCM_SHA256"), ("UNKNOWN", "x"), ("", ""), (None, None)], "ja4_hash string, cipher_suite string")
    got = encode.apply_encoders(raw, known).collect()
    assert sorted((r.ja4_hash_enc, r.cipher_suite_enc) for r in got) == [(0, 0), (0, 0), (0, 0), (7, 3)]
    assert encode.apply_encoders(raw, None).first().ja4_hash_enc == 0


def test_model_rows(spark):
    rows = to_contract(contract_row(spark, periodicity_score=1e9))
    model = encode.model_rows(rows, None, ["flow_id"])
    assert model.columns == ["flow_id", *FEATURE_COLUMNS]
    row = model.first()
    assert (row.periodicity_score, row.is_tls, row.ja4_hash_enc) == (100.0, 1.0, 0.0)
    assert quality.bad_model_values(model).isEmpty()
    broken = model.withColumn("duration", F.lit(float("nan")))
    assert [r.column for r in quality.bad_model_values(broken).collect()] == ["duration"]
    with pytest.raises(Exception, match="duration"):
        encode.strict_model_rows(broken).collect()
    with pytest.raises(ValueError, match="fan_in"):
        encode.model_rows(rows.drop("fan_in"), None)
    assert encode.model_rows(rows.drop("fan_in"), None, zero_missing=True).first().fan_in == 0.0


def test_weights(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    assert {(r.label, r.weight) for r in encode.with_weights(rows).collect()} == {("a", 4 / 6), ("b", 2.0)}


@pytest.mark.parametrize("target", [None, 10])
def test_group_split(spark, target):
    groups = [("one", 1), ("two", 2), ("many", 20), ("tie", 30)]
    rows = spark.createDataFrame([(f"{c}{i}", c) for c, n in groups for i in range(n) for _ in range(2)], "scenario string, label string")
    split = encode.group_split(rows, target_rows=target)
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {("one", "train"): 1, ("two", "train"): 1, ("two", "val"): 1, ("many", "train"): 14, ("many", "val"): 3,
                      ("many", "test"): 3, ("tie", "train"): 21, ("tie", "val"): 4, ("tie", "test"): 5}
    assert encode.leaked_groups(split).isEmpty()
    assert encode.take_split(rows, split, "test").count() == 16
    total = encode.split_report(rows, split).filter("split is null").first()
    assert (total.groups, total.rows) == (53, 106)


def test_report(spark):
    pairs = evaluate.pair_counts(spark.createDataFrame(
        [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "a")] * 2, "label string, predicted string"))
    got = {r["class"]: r for r in evaluate.report(pairs, ["a", "b", "c"]).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (0.6, 0.75, 4)
    assert got["a"].f1 == pytest.approx(2 / 3) and got["c"].f1 == 0.0 and got["c"].support == 0
    assert got["accuracy"].f1 == 0.625 and got["macro avg"].recall == pytest.approx((0.75 + 0.5) / 3)
    assert got["weighted avg"].recall == pytest.approx(0.625)
    assert {r["class"] for r in evaluate.below_target(pairs, ["a", "b", "c"]).collect()} == {"a", "b"}
    matrix = {r.label: (r.a, r.b, r.c) for r in evaluate.confusion(pairs, ["a", "b", "c"]).collect()}
    assert matrix == {"a": (3, 1, 0), "b": (2, 2, 0), "c": (0, 0, 0)}
    assert evaluate.macro_f1(pairs, ["a", "b", "c"]) == pytest.approx((2 / 3 + 4 / 7) / 2)


def messages(df, **kw):
    return [r.message for r in quality.check_rows(df, **kw).collect()]


def test_row_checks(spark, tmp_path):
    good = to_contract(contract_row(spark)).withColumn("label", F.lit("ddos"))
    assert messages(good, require_label=True) == []
    assert messages(good.limit(0)) == ["dataframe is empty"]
    assert "missing required columns: bytes_per_sec" in messages(good.drop("bytes_per_sec"))
    assert messages(good.union(good)) == ["duplicate flow_id values: 1 ids, 1 extra rows"]
    bad = good.withColumn("bytes_per_sec", F.lit(float("inf"))).withColumn("orig_bytes", F.lit(-1))
    assert set(messages(bad)) == {"non-finite bytes_per_sec: 1", "invalid non-negative integer orig_bytes: 1"}
    assert messages(good.withColumn("label", F.lit("not-a-label")), require_label=True) == ["invalid labels: not-a-label"]
    assert messages(good.withColumn("ja4_hash_enc", F.lit(7))) == ["unexpected model-only column: ja4_hash_enc"]
    twice = good.select("*", F.lit("x").alias("flow_id"))
    assert "duplicate column names: flow_id" in messages(twice)
    paths = [f"{tmp_path}/{name}.parquet" for name in ("one", "two")]
    good.write.parquet(paths[0])
    good.drop("duration").write.parquet(paths[1])
    found = quality.check_files(spark, paths).collect()
    assert {(r.subject.split("/")[0], r.message) for r in found} == {("two.parquet", "missing required columns: duration")}
    assert len(found) == len([f for f in os.listdir(paths[1]) if f.endswith(".parquet")])
    report = quality.summary(quality.check_rows(bad)).first()
    assert (report.errors, report.warnings, report.passed) == (2, 0, False)


def test_balance_and_integrity(spark):
    rows = spark.createDataFrame([("ddos",)] * 20 + [("benign",)] + [("port_scan",)] * 2, "label string")
    got = {r["class"]: (r.rows, r.status) for r in quality.class_balance(rows).collect()}
    assert got["ddos"] == (20, "OK") and got["benign"] == (1, "IMBALANCED") and got["port_scan"] == (2, "OK")
    assert got["malware_tls"] == (0, "MISSING") and len(got) == 7
    runs = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "b"), ("q", "a")], "run string, id string")
    assert {tuple(r) for r in quality.run_integrity(runs, "run", "id").collect()} == {("r", 3, 2, 1), ("q", 1, 1, 0)}
