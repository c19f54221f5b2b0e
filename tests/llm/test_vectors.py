from collections import Counter
from math import isfinite

import numpy as np
import pytest

from flowsift.llm import embedding_links

SCHEMA = "vec_id long, embedding array<float>, label string, node long, copies string, v double"


def brute(data, least=0.95):
    """(vec_id, links, component, kept) of every row, pair by pair."""
    unit = []
    for _, v in data:
        good = v and all(x is not None and isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(float) if good else None
        unit.append(None if x is None else x / np.abs(x).max())
    links, top = [0] * len(data), list(range(len(data)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, x in enumerate(unit):
        for b, y in enumerate(unit[:a]):
            if x is not None and y is not None and len(x) == len(y):
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    top[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    out = ((i, links[k], ids.get(find(k))) for k, (i, _) in enumerate(data))
    return Counter((i, n, c, i == c) for i, n, c in out)


def table(spark, tmp_path, data):
    folder = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, v, "x", 1, "y", 2.0) for i, v in data], SCHEMA).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


def links(df, least=0.95):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_links.vector_links(df, least).collect())


def test_awkward_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    data = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 0.0]),
            (7, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0]), (9, [2.0, 4.0, 6.0]), (10, [-1.0, -2.0, -3.0]),
            (None, [1.0, 2.0, 3.1]), (None, None), (None, [0.0, 0.0, 5.0]), (11, [1.0, 2.0]), (12, [1.0, 2.0, 3.0, 0.0]),
            (13, [1e30, 2e30, 3e30]), (14, [1e-38, 2e-38, 3e-38]), (15, [5.0]), (16, [7.0]), (17, [-5.0]), (18, [-0.0, 1.0, 0.0]),
            (19, [0.0, 1.0, 0.0])]
    assert links(table(spark, tmp_path, data)) == brute(data)


def test_no_vectors(spark, tmp_path):
    df = table(spark, tmp_path, [])
    assert embedding_links.vector_links(df).collect() == []


@pytest.mark.parametrize("block", [1_024, 16])
def test_groups_and_chains(spark, tmp_path, monkeypatch, block):
    """Tight groups that are balls, a loose one that isn't, copies, a chain, and others at the threshold."""
    monkeypatch.setattr(embedding_links, "BLOCK", block)
    monkeypatch.setattr(embedding_links, "DRAWN", 8)
    draw = np.random.default_rng(8)
    point = lambda: (lambda x: x / np.linalg.norm(x))(draw.normal(size=24))
    near = lambda x, far: x + far * point()
    a, b = point(), point()
    found = [near(a, 0.1) for _ in range(120)] + [near(b, 0.28) for _ in range(90)] + [a] * 40
    step = point()
    for _ in range(30):
        found.append(step)
        step = near(step, 0.2)
    found += [point() for _ in range(60)]
    data = [(k * 7 % 1009, [float(x) for x in v * (1 + k % 3)]) for k, v in enumerate(found)]
    assert links(table(spark, tmp_path, data)) == brute(data)


def test_pairs_at_the_threshold_are_met(spark, tmp_path):
    draw = np.random.default_rng(2)
    data = []
    for k in range(150):
        x = draw.normal(size=32)
        x /= np.linalg.norm(x)
        y = draw.normal(size=32)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        c = 0.95 + 1e-5 * (k % 2 * 2 - 1)
        data += [(2 * k, x.tolist()), (2 * k + 1, (c * x + (1 - c * c) ** 0.5 * y).tolist())]
    assert links(table(spark, tmp_path, data)) == brute(data)


def test_blocks_of_a_ball_do_not_meet(spark, tmp_path, monkeypatch):
    """A large group of near copies costs rows in proportion to it, not to its square."""
    monkeypatch.setattr(embedding_links, "BLOCK", 16)
    seen = []
    linked = embedding_links._linked
    monkeypatch.setattr(embedding_links, "_linked", lambda tasks, *a: (seen.append(tasks.count()), linked(tasks, *a))[1])
    draw = np.random.default_rng(4)
    a = draw.normal(size=32)
    a /= np.linalg.norm(a)
    for n in (300, 600):
        data = [(k, (a + 0.008 * draw.normal(size=32)).tolist()) for k in range(n)]
        folder = tmp_path / str(n)
        folder.mkdir()
        assert links(table(spark, folder, data)) == Counter((k, n - 1, 0, k == 0) for k in range(n))
    assert seen[1] <= 3 * seen[0] + 100


def test_transform_and_keys():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = embedding_links._transform(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(embedding_links._transform(y), x)
    tables = embedding_links.Hashing(16, 2, 3)
    keys = tables.keys(x / np.linalg.norm(x, axis=1, keepdims=True), np.full(5, 16))
    assert keys.shape == (5, 12) and all(len(set(k)) == 12 for k in keys.tolist())


def test_more_tables_for_more_functions():
    few, many = (embedding_links.hashing(64, n, 0.95) for n in (5_000, 5_000_000))
    assert few.functions < many.functions and few.tables < many.tables
