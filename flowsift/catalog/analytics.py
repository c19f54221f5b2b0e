"""Queries of encoding, evaluation, order statistics, quality and model operators."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from flowsift.catalog.base import prop_k, query, rounded, run_folder, table
from flowsift.catalog.features import contract_rows
from flowsift.functions import scalar
from flowsift.operators import classify, encode, enrich, evaluate, isolation, ordering, quality
from flowsift.plans.score import Models, score
from flowsift.schema import CLASSES, FEATURE_COLUMNS
from flowsift.sources import tables

KINDS = ["click", "error", "purchase", "signup", "view"]


@query("label_index", "SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS class_index FROM events")
def label_index(spark, d):
    return table(spark, d, "events").select("event_id", scalar.class_index("event_type", KINDS).alias("class_index"))


@query("class_names", f"SELECT part.p_partkey, {CLASSES}[p_size % 7 + 1] AS name FROM part")
def class_names(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.class_name(F.col("p_size") % 7).alias("name"))


CODES_SQL = """codes AS (SELECT c_nationkey_acct AS value, row_number() OVER (ORDER BY n DESC, c_nationkey_acct)::INT AS code FROM (
    SELECT c_nationkey || '-' || c_mktsegment AS c_nationkey_acct, count(*) AS n FROM customer GROUP BY 1) QUALIFY code <= 50)"""


def _segments(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("ja4_hash")
    )


@query("frequency_codes", f"WITH {CODES_SQL} SELECT value, code FROM codes")
def frequency_codes(spark, d):
    """The fifty most frequent values of a categorical column."""
    return encode.fit_frequency(_segments(spark, d), "ja4_hash").select("value", "code")


@query("applied_codes", f"""WITH {CODES_SQL} SELECT c_custkey, coalesce(code, 0) AS code FROM customer
  LEFT JOIN codes ON value = c_nationkey || '-' || c_mktsegment""")
def applied_codes(spark, d):
    rows = _segments(spark, d)
    coded = encode.apply_codes(rows, encode.fit_encoders(rows), "ja4_hash", "code")
    return coded.select("c_custkey", "code")


@query("model_rows", """SELECT event_id::VARCHAR AS uid, least(value, 100) AS periodicity_score, (k % 2)::DOUBLE AS is_tls,
    coalesce(CASE WHEN k % 5 > 0 THEN k END, 0)::DOUBLE AS dns_query_count FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def model_rows(spark, d):
    """Zero-filled, capped, ordered model columns."""
    k = prop_k()
    special = {
        "periodicity_score": F.col("value"), "is_tls": (k % 2 == 1), "dns_query_count": F.when(k % 5 > 0, k),
        "is_quic": F.lit("F"), "quic_0rtt": F.lit(None).cast("string"),
    }
    rows = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("uid"), *[special.get(c, F.lit(1.0)).alias(c) for c in FEATURE_COLUMNS]
    )
    return encode.model_rows(rows, None, ["uid"]).select("uid", "periodicity_score", "is_tls", "dns_query_count")


@query("class_weights", """SELECT event_id, round(sum(1) OVER () / ((SELECT count(DISTINCT event_type) FROM events)
    * count(*) OVER (PARTITION BY event_type)), 9) AS weight FROM events""")
def class_weights(spark, d):
    rows = encode.with_weights(table(spark, d, "events").withColumnRenamed("event_type", "label"))
    return rows.select("event_id", F.round("weight", 9).alias("weight"))


SPLIT_SQL = """g AS (SELECT o_custkey, min(o_orderpriority) AS label FROM orders GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('42:' || o_custkey), 1, 15))::BIGINT, o_custkey) AS rank,
      count(*) OVER (PARTITION BY label) AS n FROM g),
  split AS (SELECT o_custkey, label, CASE WHEN n <= 2 AND rank = 1 THEN 'train' WHEN n <= 2 THEN 'val'
      WHEN rank <= greatest(1, round_even(n * 0.7::DOUBLE, 0)) THEN 'train'
      WHEN rank <= greatest(1, round_even(n * 0.7::DOUBLE, 0)) + greatest(1, round_even(n * 0.15::DOUBLE, 0)) THEN 'val' ELSE 'test' END AS split FROM r)"""


def _split(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "label")
    return rows, encode.group_split(rows, "o_custkey")


@query("group_split", f"WITH {SPLIT_SQL} SELECT o_custkey, label, split FROM split")
def group_split(spark, d):
    return _split(spark, d)[1]


@query("split_members", f"WITH {SPLIT_SQL} SELECT o_orderkey, o_custkey FROM orders JOIN split USING (o_custkey) WHERE split = 'val'")
def split_members(spark, d):
    rows, split = _split(spark, d)
    return encode.take_split(rows, split, "val", "o_custkey").select("o_orderkey", "o_custkey")


@query("split_report", f"""WITH {SPLIT_SQL} SELECT split, split.label, count(DISTINCT o_custkey) AS groups, count(*) AS rows
  FROM orders JOIN split USING (o_custkey) GROUP BY ROLLUP (split, split.label)""")
def split_report(spark, d):
    rows, split = _split(spark, d)
    return encode.split_report(rows, split, "o_custkey")


@query("split_leaks", f"""WITH {SPLIT_SQL}, leaky AS (SELECT o_custkey, split FROM split UNION ALL
    SELECT o_custkey, CASE split WHEN 'test' THEN 'train' ELSE 'test' END FROM split WHERE o_custkey % 7 = 0
    UNION ALL SELECT o_custkey, 'val' FROM split WHERE o_custkey % 11 = 0)
  SELECT DISTINCT a.o_custkey, a.split || '/' || b.split AS splits FROM leaky a JOIN leaky b USING (o_custkey)
  WHERE (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test'))""")
def split_leaks(spark, d):
    """Groups in two splits: a seventh and an eleventh of the customers are put into another one as well."""
    split = _split(spark, d)[1].select("o_custkey", "split")
    other = F.when(F.col("split") == "test", "train").otherwise("test")
    leaky = split.union(split.filter("o_custkey % 7 = 0").withColumn("split", other)).union(
        split.filter("o_custkey % 11 = 0").withColumn("split", F.lit("val")))
    return encode.leaked_groups(leaky, "o_custkey")


@query("attached_runs", """SELECT event_id, 'run ' || k % 3 AS run_id, event_type || ' of ' || k % 3 AS attack_scenario
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) WHERE k % 3 < 2""")
def attached_runs(spark, d):
    """Rows of files that share their names, with the run their whole path belongs to."""
    k = prop_k()
    rows = table(spark, d, "events").select(
        "event_id", F.concat_ws("", F.lit("file:///data/r"), k % 3, F.lit("/"), "event_type", F.lit(".parquet")).alias("_path"))
    runs = table(spark, d, "events").filter(k % 3 < 2).select((k % 3).alias("third"), "event_type").distinct().select(
        F.concat_ws("", F.lit("r"), "third", F.lit("/"), "event_type", F.lit(".parquet")).alias("parquet_path"),
        F.concat_ws(" ", F.lit("run"), "third").alias("run_id"),
        F.concat_ws(" of ", "event_type", "third").alias("attack_scenario"))
    return tables.attach_runs(rows, runs).select("event_id", "run_id", "attack_scenario")


@query("set_operations", """SELECT o_custkey, 'both' AS side FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
  UNION ALL SELECT o_custkey, 'only F' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def set_operations(spark, d):
    orders = table(spark, d, "orders")
    side = {s: orders.filter(F.col("o_orderstatus") == s).select("o_custkey") for s in "FO"}
    both = side["F"].intersect(side["O"]).withColumn("side", F.lit("both"))
    return both.unionByName(side["F"].subtract(side["O"]).withColumn("side", F.lit("only F")))


@query("bag_union", """SELECT o_orderstatus AS scenario, NULL::VARCHAR AS note, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT event_type, 'event', count(*) FROM events GROUP BY ALL""")
def bag_union(spark, d):
    """Frames with different columns, stacked by name."""
    parts = [
        table(spark, d, "orders").select(F.col("o_orderstatus").alias("scenario")),
        table(spark, d, "events").select(F.col("event_type").alias("scenario"), F.lit("event").alias("note")),
    ]
    return quality.union_all(parts).groupBy("scenario", "note").agg(F.count(F.lit(1)).alias("n"))


PAIRS_SQL = """pairs AS (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label,
    CASE WHEN n_chars > 400 THEN 'good' WHEN n_chars > 100 THEN 'bad' ELSE 'junk' END AS predicted FROM labels JOIN documents USING (doc_id))"""
LABELS = ["bad", "good", "junk"]


def _pairs(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    size = F.col("n_chars")
    return evaluate.pair_counts(joined.select(
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"),
        F.when(size > 400, "good").when(size > 100, "bad").otherwise("junk").alias("predicted"),
    ))


SCORES_SQL = f"""{PAIRS_SQL}, cls AS (SELECT unnest({LABELS}) AS class),
  cnt AS (SELECT class, (SELECT count(*) FROM pairs WHERE label = class) AS support, (SELECT count(*) FROM pairs WHERE predicted = class) AS said,
    (SELECT count(*) FROM pairs WHERE predicted = class AND label = class) AS hits FROM cls),
  pr AS (SELECT class, support, CASE WHEN said = 0 THEN 0 ELSE hits / said END AS p, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r FROM cnt),
  sc AS (SELECT class, support, p, r, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM pr)"""


@query("classification_report", f"""WITH {SCORES_SQL}, tot AS (SELECT count(*) AS n, avg((label = predicted)::INT) AS a FROM pairs)
  SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM sc
  UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n FROM tot
  UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM sc
  UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
    round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM sc""")
def classification_report(spark, d):
    return evaluate.report(_pairs(spark, d), LABELS).select("class", rounded("precision"), rounded("recall"), rounded("f1"), "support")


@query("below_target", f"WITH {SCORES_SQL} SELECT class, round(f, 6) AS f1 FROM sc WHERE support > 0 AND f < 0.85")
def below_target(spark, d):
    return evaluate.below_target(_pairs(spark, d), LABELS).select("class", rounded("f1"))


@query("confusion_matrix", f"""WITH {PAIRS_SQL} SELECT l.label, {', '.join(f"count(*) FILTER (predicted = '{c}') AS {c}" for c in LABELS)}
  FROM (SELECT unnest({LABELS}) AS label) l LEFT JOIN pairs USING (label) GROUP BY 1""")
def confusion_matrix(spark, d):
    return evaluate.confusion(_pairs(spark, d), LABELS)


@query("class_distribution", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1")
def class_distribution(spark, d):
    return evaluate.class_distribution(table(spark, d, "documents").withColumnRenamed("lang", "label"))


@query("group_labels", "SELECT source AS scenario, min(lang) AS label FROM documents GROUP BY 1")
def group_labels(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("scenario"), F.col("lang").alias("label"))
    return evaluate.group_labels(rows)


@query("score_summary", """SELECT count(*) AS rows, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean,
    round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.99), 6) AS threshold FROM lineitem""")
def score_summary(spark, d):
    done = ordering.score_summary(table(spark, d, "lineitem"), "l_extendedprice")
    return done.select("rows", "min", "max", rounded("mean", 4), rounded("median"), rounded("threshold"))


@query("score_quantiles", """SELECT unnest([0.01, 0.25, 0.75, 0.999]) AS quantile, round(unnest(quantile_cont(value, [0.01, 0.25, 0.75, 0.999])), 6) AS value FROM events""")
def score_quantiles(spark, d):
    return ordering.exact_quantiles(table(spark, d, "events"), "value", [0.01, 0.25, 0.75, 0.999]).select("quantile", rounded("value"))


@query("score_histogram", """WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 50 AS w FROM events),
  b AS (SELECT least(greatest(floor((value - lo) / w)::INT, 0), 49) AS bin FROM events, s)
  SELECT g.bin::INT AS bin, round(lo + g.bin * w, 6) AS low, count(b.bin) AS rows FROM (SELECT unnest(range(50)) AS bin) g CROSS JOIN s LEFT JOIN b USING (bin) GROUP BY g.bin, lo, w""")
def score_histogram(spark, d):
    return ordering.histogram(table(spark, d, "events"), "value", 50).select("bin", rounded("low"), "rows")


@query("class_balance", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
  SELECT class, coalesce(n, 0) AS rows, round(coalesce(n * 100.0 / (SELECT sum(n) FROM c), 0), 6) AS percent,
    round(coalesce(n / (SELECT max(n) FROM c), 0), 6) AS ratio,
    CASE WHEN n IS NULL THEN 'MISSING' WHEN n / (SELECT max(n) FROM c) < 0.2 THEN 'IMBALANCED' ELSE 'OK' END AS status
  FROM (SELECT unnest(['de', 'en', 'es', 'xx']) AS class) LEFT JOIN c ON class = lang""")
def class_balance(spark, d):
    rows = table(spark, d, "documents").withColumnRenamed("lang", "label")
    return quality.class_balance(rows, ["de", "en", "es", "xx"], threshold=0.2).select(
        "class", "rows", rounded("percent"), rounded("ratio"), "status"
    )


@query("run_integrity", """SELECT strftime(l_shipdate, '%Y-%m') AS run, count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_ids,
    count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem GROUP BY 1""")
def run_integrity(spark, d):
    rows = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("run"), "l_orderkey")
    return quality.run_integrity(rows, "run", "l_orderkey")


@query("labelled_documents", """SELECT doc_id, CASE quality WHEN 1 THEN 'benign' ELSE 'ddos' END AS label FROM documents JOIN labels USING (doc_id)""")
def labelled_documents(spark, d):
    labelled, _ = _labelled(spark, d)
    return labelled.select(F.col("scenario").alias("doc_id"), "label")


def _labelled(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("scenario"), "source")
    classes = table(spark, d, "labels").select(
        F.col("doc_id").alias("scenario"), F.when(F.col("quality") == 1, "benign").otherwise("ddos").alias("label")
    )
    return tables.attach_labels(rows, classes)


@query("unlabelled_documents", "SELECT doc_id, 1::BIGINT AS rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, d):
    return _labelled(spark, d)[1].withColumnRenamed("scenario", "doc_id")


@query("dropped_labels", "SELECT lang AS label, count(*) AS rows FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY 1")
def dropped_labels(spark, d):
    return tables.drop_unknown(table(spark, d, "documents").withColumnRenamed("lang", "label"), ["en", "de"])[1]


@query("file_consistency", """SELECT d::VARCHAR AS subject, CASE WHEN l IS NULL THEN 'error' WHEN d IS NULL THEN 'warning' ELSE 'ok' END AS severity
  FROM (SELECT doc_id AS d FROM documents) FULL JOIN (SELECT doc_id AS l FROM labels) ON d = l""")
def file_consistency(spark, d):
    stems = {n: table(spark, d, n).select(F.col("doc_id").alias("stem")) for n in ("documents", "labels")}
    return quality.consistency(stems["documents"], stems["labels"], "capture").select("subject", "severity")


@query("row_checks", """WITH e AS (SELECT json_extract_string(props, '$.k')::INT AS k, event_type, user_id FROM events),
  d AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1 HAVING count(*) > 1)
  SELECT 'values' AS "check", 'non-finite duration: ' || count(*) FILTER (k % 10 = 0) AS message FROM e
  UNION ALL SELECT 'values', 'invalid non-negative integer orig_bytes: ' || count(*) FILTER (k % 10 IN (1, 2)) FROM e
  UNION ALL SELECT 'duplicates', 'duplicate flow_id values: ' || count(*) || ' ids, ' || sum(n - 1)::BIGINT || ' extra rows' FROM d
  UNION ALL SELECT DISTINCT 'labels', 'invalid labels: ' || event_type FROM e WHERE event_type <> 'click'""")
def row_checks(spark, d):
    """Every value check of a feature frame in one report."""
    k = prop_k()
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("flow_id"), F.col("event_type").alias("label"),
        F.when(k % 10 == 0, float("inf")).otherwise(1.0).alias("duration"),
        F.when(k % 10 == 1, -5).when(k % 10 == 2, F.lit(None)).otherwise(k).cast("bigint").alias("orig_bytes"),
    )
    report = quality.check_rows(rows, require_label=True, classes=["click"])
    return report.filter("check <> 'columns'").select("check", "message")


@query("column_checks", """SELECT 'missing required columns: ' || c AS message FROM (SELECT unnest(['flow_id', 'ts']) AS c)
  UNION ALL SELECT 'extra column: ' || column_name FROM (DESCRIBE orders)""")
def column_checks(spark, d):
    report = quality.check_columns(table(spark, d, "orders"), ["flow_id", "ts"])
    return report.select("message")


@query("bad_model_values", """WITH e AS (SELECT json_extract_string(props, '$.k')::INT AS k FROM events)
  SELECT 'a' AS "column", count(*) FILTER (k % 10 = 0) AS bad FROM e UNION ALL SELECT 'b', count(*) FILTER (k < 5) FROM e""")
def bad_model_values(spark, d):
    k = prop_k()
    rows = table(spark, d, "events").select(
        F.when(k % 10 > 0, 1.0).alias("a"), F.when(k < 5, float("nan")).otherwise(2.0).alias("b"), F.lit(3.0).alias("c")
    )
    return quality.bad_model_values(rows, ["a", "b", "c"])


@query("quality_summary", """WITH e AS (SELECT json_extract_string(props, '$.k')::INT AS k FROM events)
  SELECT count(DISTINCT k) FILTER (k < 60) AS errors, count(DISTINCT k) FILTER (k >= 60) AS warnings, count(*) FILTER (k < 60) = 0 AS passed FROM e""")
def quality_summary(spark, d):
    found = table(spark, d, "events").select(F.when(prop_k() < 60, "error").otherwise("warning").alias("severity"), prop_k().alias("k"))
    return quality.summary(found.distinct())


# --- models: no SQL twin; properties are tested instead ---

SMALL_FEATURES = ["value", "k", "hour", "user_id"]


def _points(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("flow_id"), "value", prop_k().cast("double").alias("k"),
        F.hour("ts").cast("double").alias("hour"), F.col("user_id").cast("double").alias("user_id"), "event_type",
    )


@query("isolation_scores")
def isolation_scores(spark, d):
    """Isolation forest fitted on purchases, scores of all events."""
    rows = _points(spark, d)
    nodes = isolation.fit(rows.filter("event_type = 'purchase'"), SMALL_FEATURES, "flow_id", trees=100)
    scored = isolation.with_score(rows, isolation.load(nodes), SMALL_FEATURES)
    return scored.select("flow_id", F.round("raw_score", 6).alias("raw_score"))


@query("trained_predictions")
def trained_predictions(spark, d):
    """Weighted forest on all events, predicting the value band."""
    band = F.when(F.col("value") > 60, "ddos").when(F.col("value") > 20, "port_scan").otherwise("benign")
    rows = encode.with_weights(_points(spark, d).withColumn("label", band))
    model = classify.train(rows, SMALL_FEATURES, params={"numTrees": 10, "maxDepth": 4})
    return classify.predict(model, rows.drop("weight"), SMALL_FEATURES).select("flow_id", "label", "predicted", F.round("confidence", 6).alias("confidence"))


@query("boosted_predictions")
def boosted_predictions(spark, d):
    """Boosted trees of all classes at once on all events, predicting the value band."""
    band = F.when(F.col("value") > 60, "ddos").when(F.col("value") > 20, "port_scan").otherwise("benign")
    rows = encode.with_weights(_points(spark, d).withColumn("label", band))
    model = classify.fit("softmax", rows, SMALL_FEATURES, params={"rounds": 5, "maxDepth": 3})
    return classify.predict(model, rows.drop("weight"), SMALL_FEATURES).select(
        "flow_id", "label", "predicted", F.round("confidence", 6).alias("confidence"))


def contract_features(spark, d):
    """Contract rows of all sound events, labelled by their kind."""
    good, _ = enrich.split_violations(enrich.to_contract(contract_rows(spark, d), "quarantine"))
    kinds = F.when(F.col("dst_ip") == "click", "ddos").when(F.col("dst_ip") == "error", "port_scan").otherwise("benign")
    return good.withColumn("label", kinds)


def small_models(labelled):
    # both models pass over the rows several times: they are encoded once, and keep their partitions
    ready = encode.with_weights(encode.model_rows(labelled, None, ["flow_id", "label"])).persist(StorageLevel.DISK_ONLY)
    model = classify.train(ready, params={"numTrees": 10, "maxDepth": 4})
    forest = isolation.load(isolation.fit(ready.filter("label = 'benign'"), FEATURE_COLUMNS, "flow_id", trees=50))
    ready.unpersist()
    return Models(model, forest, None)


@query("scored_flows")
def scored_flows(spark, d):
    """End to end: features of all events, models trained on them, verdicts with evidence."""
    # training passes over the rows many times: compute the features once
    path = f"{run_folder(spark, 'scored')}/rows"
    contract_features(spark, d).write.parquet(path)
    labelled = spark.read.parquet(path)
    return score(labelled, small_models(labelled)).select(
        "flow_id", "threat_class", "confidence", "anomaly_score", "severity", F.array_join("evidence", "; ").alias("evidence")
    )
