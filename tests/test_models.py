import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import boosting, classify, encode, isolation
from flowsift.plans import jobs
from flowsift.plans.score import score
from flowsift.schema import FEATURE_COLUMNS, FLOW_COLUMNS, FLOW_TYPES

# each class stands out in one field
SIGNS = {"benign": ("duration", 5.0), "ddos": ("packets_per_sec", 900.0), "port_scan": ("fan_out", 80.0), "dns_anomaly": ("dns_query_entropy", 4.0)}


def labelled(spark, per_scenario=15, scenarios=4):
    rng = random.Random(7)
    rows = []
    for label, (field, value) in SIGNS.items():
        for s in range(scenarios):
            for i in range(per_scenario):
                row = {}
                for name in FLOW_COLUMNS:
                    kind = FLOW_TYPES[name]
                    row[name] = {"double": rng.random(), "bigint": rng.randint(0, 3), "int": rng.randint(0, 3), "boolean": False, "string": "x"}[kind]
                row |= {"flow_id": f"{label}{s}-{i}", "src_ip": "s", "dst_ip": "d", "protocol": "tcp", "label": label, "ja4_hash": rng.choice("ab")}
                row[field] = value * (1 + rng.random() / 10)
                rows.append((*[row[c] for c in FLOW_COLUMNS], f"{label}{s}"))
    return spark.createDataFrame(rows, ", ".join(f"{c} {FLOW_TYPES[c]}" for c in FLOW_COLUMNS) + ", scenario string")


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("models"))
    rows = labelled(spark).persist()
    reports = jobs.train_job(rows, out, jobs.TrainConfig(trials=2, space={"numTrees": [5], "maxDepth": [3, 4]}))
    benign = rows.filter("label = 'benign'")
    reports |= jobs.train_anomaly_job(benign, out, spark.read.parquet(f"{out}/encoders"), trees=20, sample=32)
    return rows, out, reports


def test_train_job(trained):
    _, _, reports = trained
    scores = {r["class"]: r for r in reports["report"].collect()}
    assert scores["accuracy"].f1 > 0.9 and scores["ddos"].support > 0 and scores["malware_tls"].support == 0
    assert sum(r.rows for r in reports["split"].filter("label is not null").collect()) == 240
    assert sum(r.rows for r in reports["histogram"].collect()) == 60
    summary = reports["summary"].first()
    assert 0 < summary.min <= summary.median <= summary.threshold <= summary.max < 1


def test_score(spark, trained):
    rows, out, _ = trained
    models = jobs.load_models(spark, out)
    got = score(rows, models).collect()
    assert len(got) == 240
    for r in got:
        assert 0 <= r.anomaly_score <= 1 and len(r.evidence) == 5
        assert r.severity == ("critical" if r.confidence >= 0.9 else "high" if r.confidence >= 0.75 else "medium" if r.confidence >= 0.5 else "info")
    ddos = [r for r in got if r.flow_id.startswith("ddos")]
    assert sum(r.threat_class == "ddos" for r in ddos) > 50
    assert sum(any("High packet rate" in e and "supports" in e for e in r.evidence) for r in ddos) > 30
    library = score(rows, models, policy="library").filter("confidence <= 0.5").select("threat_class").distinct().collect()
    assert all(r[0] == "unknown_anomaly" for r in library)
    done = jobs.evaluate_job(rows.withColumn("label", F.when(F.col("flow_id") == "ddos0-0", "odd").otherwise(F.col("label"))), models)
    assert done["dropped"].first().rows == 1 and done["samples"].count() == 3
    assert sum(r.n for r in done["distribution"].collect()) == 239


def drawn_tree(draw, features, depth, paths):
    """A tree with covers in arrays, as the paths keep it."""
    def add(level, cover):
        at = len(paths.feature)
        paths.said.append(draw.normal(size=2))
        paths.cover.append(float(cover))
        for values in (paths.feature, paths.below, paths.above):
            values.append(-1)
        paths.threshold.append(0.0)
        if level and cover > 1 and draw.random() < 0.9:
            paths.feature[at], paths.threshold[at] = int(draw.integers(features)), float(draw.normal())
            left = int(draw.integers(1, cover))
            paths.below[at] = add(level - 1, left)
            paths.above[at] = add(level - 1, cover - left)
        return at

    paths.roots.append(add(depth, 200))


def test_shapley_values_match_all_subsets():
    from itertools import combinations
    from math import factorial

    draw, features = np.random.default_rng(5), 5
    for depth in (1, 2, 4, 7):
        paths = classify.TreePaths()
        for _ in range(3):
            drawn_tree(draw, features, depth, paths)
        paths._freeze()
        x, target = draw.normal(size=(30, features)), draw.integers(0, 2, 30)

        def mean(at, row, known, k):
            if paths.feature[at] < 0:
                return paths.said[at, k]
            if paths.feature[at] in known:
                return mean(paths.below[at] if row[paths.feature[at]] <= paths.threshold[at] else paths.above[at], row, known, k)
            a, b = paths.below[at], paths.above[at]
            return (paths.cover[a] * mean(a, row, known, k) + paths.cover[b] * mean(b, row, known, k)) / (paths.cover[a] + paths.cover[b])

        got = paths.contributions(x, target)
        for r, row in enumerate(x):
            worth = lambda known: sum(mean(root, row, known, target[r]) for root in paths.roots)
            assert paths.base()[target[r]] == pytest.approx(worth(()))
            for i in range(features):
                others = [j for j in range(features) if j != i]
                value = sum(factorial(n) * factorial(features - n - 1) / factorial(features) * (worth((*s, i)) - worth(s))
                            for n in range(features) for s in combinations(others, n))
                assert got[r, i] == pytest.approx(value, abs=1e-9)
            assert paths.base()[target[r]] + got[r].sum() == pytest.approx(paths.totals(x)[r, target[r]])


def test_contributions_add_up(spark, trained):
    rows, out, _ = trained
    models = jobs.load_models(spark, out)
    ready = encode.model_rows(rows, models.encoders, ["flow_id"])
    predicted = classify.predict(models.classifier, ready)
    moved = predicted.withColumn("moved", classify.attribution_column(models.paths, FEATURE_COLUMNS, "class_index"))
    for r in moved.select("moved", "confidence", "class_index").collect():
        assert models.paths.base()[r.class_index] + sum(r.moved) == pytest.approx(r.confidence, abs=1e-9)


def test_boosted(spark, tmp_path):
    out = str(tmp_path)
    rows = labelled(spark, 8, 4).persist()
    jobs.train_job(rows, out, jobs.TrainConfig(boosted=True, params={"maxIter": 3, "maxDepth": 3}))
    jobs.train_anomaly_job(rows.filter("label = 'benign'"), out, trees=10, sample=16)
    models = jobs.load_models(spark, out)
    ready = encode.model_rows(rows, models.encoders, ["flow_id"])
    predicted = classify.predict(models.classifier, ready)
    got = predicted.withColumn("moved", classify.attribution_column(models.paths, FEATURE_COLUMNS, "class_index")).collect()
    # the margins must be those of Spark's own ensembles
    own = {}
    for position, ensemble in enumerate(models.classifier.models):
        for r in ensemble.transform(classify.assemble(ready)).select("flow_id", "rawPrediction").collect():
            own[r.flow_id, position] = r.rawPrediction[1]
    for r in got:
        assert sum(r.probabilities) == pytest.approx(1.0)
        assert models.paths.base()[r.class_index] + sum(r.moved) == pytest.approx(own[r.flow_id, r.class_index], abs=1e-9)
    assert sum(r.flow_id.startswith(r.predicted) for r in got) > 0.9 * len(got)
    assert all(len(r.evidence) == 5 for r in score(rows, models).collect())


def test_isolation_ranks_outliers_first(spark):
    rng = np.random.default_rng(0)
    points = [(str(i), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [("out", 9.0, 9.0)]
    df = spark.createDataFrame(points, "id string, a double, b double")
    for trees, sample in ((30, 64), (10, 32)):  # few rows per tree: drawn anew; many: shared out
        nodes = isolation.fit(df, ["a", "b"], "id", trees, sample)
        forest = isolation.load(nodes)
        again = isolation.load(isolation.fit(df.repartition(3), ["a", "b"], "id", trees, sample))
        assert len(forest.roots) == trees
        scored = isolation.with_score(df, forest, ["a", "b"]).orderBy(F.desc("raw_score")).take(1)[0]
        assert scored.id == "out" and scored.raw_score > 0.6
        x = np.array([[0.0, 0.0], [5.0, 5.0]])
        assert forest.score(x) == pytest.approx(again.score(x))


def test_mean_path():
    assert isolation.mean_path([1, 2]).tolist() == [0.0, 1.0]
    assert float(isolation.mean_path(256)) == pytest.approx(10.2448, abs=1e-3)


def by_hand(rows, cuts, classes, rounds, depth, rate, penalty):
    """Rows of trees as nested tuples, one row at a time: (label, weight, values)."""
    from math import exp

    one = boosting.ONE
    margins, trees = [[0.0] * classes for _ in rows], []

    def value(g, h):
        return -rate * (g / one) / (h / one + penalty)

    def grow(k, members, sums, level):
        def total(some):
            return [sum(sums[i][c] for i in some) for c in (0, 1)]

        def worth(g, h):
            return (g / one) * (g / one) / (h / one + penalty)

        g, h = total(members)
        best = None
        for f, cut in enumerate(cuts):
            for c in cut if level < depth else ():
                below = [i for i in members if rows[i][2][f] <= c]
                if 0 < len(below) < len(members):
                    gb, hb = total(below)
                    gain = worth(gb, hb) + worth(g - gb, h - hb) - worth(g, h)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, f, c, below)
        if best is None:
            for i in members:
                margins[i][k] += value(g, h)
            return value(g, h)
        below = set(best[3])
        return best[1], grow(k, best[3], sums, level + 1), grow(k, [i for i in members if i not in below], sums, level + 1)

    for _ in range(rounds):
        p = []
        for m in margins:
            odds = [exp(v - max(m)) for v in m]
            p.append([o / sum(odds) for o in odds])
        for k in range(classes):
            sums = [(round((p[i][k] - (r[0] == k)) * r[1] * one), round(2 * p[i][k] * (1 - p[i][k]) * r[1] * one))
                    for i, r in enumerate(rows)]
            trees.append(grow(k, list(range(len(rows))), sums, 0))
    return trees, margins


def test_softmax_boosting_by_hand(spark):
    rng = random.Random(3)
    data = []
    for _ in range(300):
        x = [rng.randint(0, 9), rng.random(), rng.choice([0, 0, 0, 1])]
        data.append(("abc"[(x[0] > 4) + (x[1] > 0.5 and x[2] == 0)], rng.choice([0.5, 1.0, 3.0]), *map(float, x)))
    columns, classes = ["x0", "x1", "x2"], ["a", "b", "c"]
    df = spark.createDataFrame(data, "label string, weight double, x0 double, x1 double, x2 double")
    params = {"rounds": 4, "maxDepth": 2, "bins": 8}
    model = boosting.train(df.repartition(5), columns, classes, params)
    cuts = [list(c) for c in boosting.cut_points(df, columns, 8)]
    assert all(len(c) <= 7 for c in cuts)
    rows = [("abc".index(r[0]), r[1], r[2:]) for r in data]
    trees, margins = by_hand(rows, cuts, 3, 4, 2, boosting.PARAMS["rate"], boosting.PARAMS["penalty"])
    got = classify.SoftmaxPaths(model, 3).totals(np.array([r[2] for r in rows]))
    assert got == pytest.approx(np.array(margins), abs=1e-6)
    # the same trees however the rows are spread, and whatever the rounds between two writings
    kept, boosting.KEPT = boosting.KEPT, 2
    try:
        assert boosting.train(df.coalesce(1), columns, classes, params).nodes == model.nodes
    finally:
        boosting.KEPT = kept
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) == 4
    assert model.losses[0] == pytest.approx(np.log(3), abs=1e-6)


def test_softmax_boosting_edges(spark):
    kind = "label string, weight double, x double"
    nothing = boosting.train(spark.createDataFrame([], kind), ["x"], ["a", "b"], {"rounds": 2})
    assert nothing.nodes == [] and nothing.losses == []
    rows = spark.createDataFrame([("a", 1.0, 1.0)], kind)
    assert classify.predict(nothing, rows, ["x"], ["a", "b"]).first().probabilities == [0.5, 0.5]
    # unknown labels and weights that are no positive number say nothing
    odd = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("q", 9.0, 1.0), (None, 9.0, 1.0), ("b", 0.0, 1.0), ("b", None, 1.0),
                                 ("b", float("nan"), 1.0)], kind)
    model = boosting.train(odd, ["x"], ["a", "b"], {"rounds": 2, "penalty": 0.1})
    assert {n[6] for n in model.nodes if n[2] == 1} == {2}
    assert classify.predict(model, rows, ["x"], ["a", "b"]).first().predicted == "a"
    with pytest.raises(Exception, match="invalid training value"):
        boosting.train(spark.createDataFrame([("a", 1.0, None)], kind), ["x"], ["a", "b"])


def test_softmax_job(spark, tmp_path):
    out = str(tmp_path)
    rows = labelled(spark, 8, 4).persist()
    config = jobs.TrainConfig(family="softmax", trials=2, space={"rounds": [2, 3], "maxDepth": [2]})
    reports = jobs.train_job(rows, out, config)
    assert {r["class"]: r for r in reports["report"].collect()}["accuracy"].f1 > 0.9
    jobs.train_anomaly_job(rows.filter("label = 'benign'"), out, trees=10, sample=16)
    models = jobs.load_models(spark, out)
    assert isinstance(models.classifier, boosting.SoftmaxTrees)
    ready = encode.model_rows(rows, models.encoders, ["flow_id"])
    predicted = classify.predict(models.classifier, ready)
    got = predicted.withColumn("moved", classify.attribution_column(models.paths, FEATURE_COLUMNS, "class_index")).collect()
    x = np.array([[r[c] for c in FEATURE_COLUMNS] for r in got], dtype=float)
    margins = models.paths.totals(x)
    for r, margin in zip(got, margins):
        assert sum(r.probabilities) == pytest.approx(1.0) and min(r.probabilities) > 0
        assert models.paths.base()[r.class_index] + sum(r.moved) == pytest.approx(margin[r.class_index], abs=1e-9)
    assert all(len(r.evidence) == 5 for r in score(rows, models).collect())
    with pytest.raises(ValueError, match="family"):
        jobs.TrainConfig(family="none")


def test_rows_of_one_kind_are_explained_once(monkeypatch):
    """Rows on the same sides of all splits of a tree, with one target; the values are those of rows one by one."""
    draw, paths = np.random.default_rng(5), classify.TreePaths()
    for _ in range(3):
        drawn_tree(draw, 5, 4, paths)
    paths._freeze()
    x, target = np.tile(draw.normal(size=(20, 5)), (50, 1)), np.tile(draw.integers(0, 2, 20), 50)
    met, whole = [], paths._tree_contributions
    monkeypatch.setattr(paths, "_tree_contributions", lambda x, *rest: (met.append(len(x)), whole(x, *rest))[1])
    got = paths.contributions(x, target)
    assert len(met) == 3 and max(met) <= 20
    monkeypatch.setattr(classify, "MOST_SPLITS", 0)
    assert got == pytest.approx(paths.contributions(x, target), abs=1e-12) and max(met[3:]) == 1000


def test_isolation_draws_are_made_for_near_rows_only(spark):
    rows = spark.range(20_000).select("id", F.col("id").cast("double").alias("a"))
    samples, size = isolation.tree_samples(rows, ["a"], "id", trees=4, sample=16)
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert "least(" in plan and samples.count() == 4 * size == 64
