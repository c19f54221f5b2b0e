import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowsift.llm import common, language_model, toxicity
from flowsift.llm.queries import op1
from tests.llm.fixtures import CHUNK, LOWER, none, rows


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return language_model.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def tokens(text):
    return [*CHUNK.findall((text or "").translate(LOWER)), "\0end"]


@pytest.mark.parametrize("share", [1e-6, 0.05])
def test_base_scores(spark, corpus, vocabulary, monkeypatch, share):
    monkeypatch.setattr(language_model, "SHARE", share)
    count, total = Counter(), 0
    for i, t, *_ in rows():
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            count.update(tokens(t))
    total = sum(count.values())
    want = Counter()
    for i, t, *_ in rows():
        w = tokens(t)
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (len(count) + 1))) for x in w)
        want[i, not zlib.crc32(("" if i is None else str(i)).encode()) % 10, len(w), sum(count[x] > 0 for x in w), total,
             round(base, 4)] += 1
    got = language_model.language_scores(corpus, vocabulary).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_language_model_of_nothing(spark, vocabulary):
    assert language_model.language_scores(none(spark), vocabulary).count() == 0
    held = next(k for k in range(100) if not zlib.crc32(str(k).encode()) % 10)
    only = spark.createDataFrame([(held, "a word")], "doc_id long, text string")
    r = language_model.language_scores(only, vocabulary).first()
    assert r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score)


def test_windows_score_as_one_pass_over_the_text(vocabulary):
    """Batched half windows against attention spelt out for every place."""
    net = language_model.Attention(50)
    draw = np.random.default_rng(2)
    net.set_classes(draw.integers(0, 30, 50))
    net.p["lag"] += draw.normal(0, 1, net.p["lag"].shape).astype(np.float32)
    texts = [draw.integers(0, 50, n) for n in (1, 7, 8, 9, 40)]
    inputs, targets, places = language_model.half_windows(texts, 49, 50)
    got = net.log_probabilities(inputs, targets, net.tables()).ravel()[places]
    want = []
    for ids in texts:
        before = [49, *ids[:-1]]
        for t, wanted in enumerate(ids):
            seen = range(max(0, (t // language_model.HALF - 1) * language_model.HALF), t + 1)
            q = net.embed[before[t]] @ net.p["query"] / math.sqrt(language_model.QUERY)
            s = np.array([q @ (net.embed[before[k]] @ net.p["key"]) + net.p["lag"][t - k] for k in seen])
            a = np.exp(s - s.max())
            a /= a.sum()
            z = sum(x * (net.embed[before[k]] @ net.p["value"]) for x, k in zip(a, seen))
            h = np.maximum(z + net.embed[before[t]] @ net.p["stay"] + net.p["base"], 0)
            logit = h @ net.p["out"] + net.p["level"]
            p = np.exp(logit - logit.max())
            want.append(math.log(p[net.of[wanted]] / p.sum()) + net.within[wanted])
    assert np.allclose(got, want, atol=1e-4)
    # classes and shares make one distribution
    assert np.allclose(np.bincount(net.of, np.exp(net.within), language_model.CLASSES)[np.unique(net.of)], 1, atol=1e-4)


def test_attention_learns():
    net = language_model.Attention(30)
    text = np.tile(np.arange(30), 200)
    net.set_classes(np.bincount(text, minlength=30))
    inputs, targets, places = language_model.half_windows([text], 29, 30)
    real = np.zeros(inputs.size, bool)
    real[places] = True
    before = net.log_probabilities(inputs, targets, net.tables()).ravel()[places].mean()
    net.train(inputs, targets, real.reshape(inputs.shape), rounds=20)
    assert net.log_probabilities(inputs, targets, net.tables()).ravel()[places].mean() > before + 1


def test_network_learns_from_all_training_texts(spark, vocabulary, tmp_path, monkeypatch):
    draw = np.random.default_rng(4)
    texts = [" ".join(draw.choice(["red", "green", "blue"], 40)) for _ in range(500)]
    texts[7] = " ".join(f"zebra{k % 50}" for k in range(6_000))  # a long one
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    encode, end = vocabulary.encoder()
    want = Counter(n for t in texts for w in language_model.tokens(t.encode()) for n in encode(w))
    counts = language_model.subword_counts(language_model.word_counts(docs, vocabulary), vocabulary)
    assert {n: int(counts[n]) for n in np.flatnonzero(counts)} == want
    # pieces of all texts where there are few, a share of them where there are many
    every = language_model.pieces(docs, vocabulary, 1.0).collect()
    assert Counter(n for r in every for n in r.ids) == want
    some = language_model.pieces(docs, vocabulary, 0.25).collect()
    assert 0.1 < len(some) / len(every) < 0.4 and any(not r.begins for r in some)
    # several tasks, averaged
    monkeypatch.setattr(language_model, "LEAST", int(counts.sum()) // 3)
    monkeypatch.setattr(language_model, "DRAWN", 1.0)
    ids = [np.array([n for w in language_model.tokens(texts[7].encode()) for n in encode(w)])]
    inputs, targets, places = language_model.half_windows(ids, end, end + 1)
    fresh = language_model.Attention(end + 1)
    fresh.set_classes(counts)
    net = language_model.fit(docs, vocabulary, counts)
    before, after = (n.log_probabilities(inputs, targets, n.tables()).ravel()[places].mean() for n in (fresh, net))
    assert after > before + 0.5
    # the sum in two levels is the sum in one
    monkeypatch.setattr(language_model, "ADDED", 2)
    levels = language_model.fit(docs, vocabulary, counts)
    assert np.allclose(levels.embed, net.embed, atol=1e-4)
    assert all(np.allclose(levels.p[name], net.p[name], atol=1e-4) for name in net.p)


def test_lm_query_scores_every_document(spark, sf):
    got = op1(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r.held_out for r in got} == {True, False}


def labelled(seed, n):
    draw = np.random.default_rng(seed)
    texts, labels = [], []
    for k in range(n):
        w = [f"{a}{b}" for a, b in zip(draw.choice(list("abcdefgh"), 60), draw.integers(0, 40, 60))]
        if k % 2:
            w[draw.integers(60)] = draw.choice(["vilest", "vileness", "vilely"])
        texts.append(" ".join(w).encode())
        labels.append(k % 2)
    return texts, np.array(labels, np.float32)


def test_toxicity_on_held_out_texts():
    net = toxicity.Trainer(*labelled(1, 240)).train()
    texts, labels = labelled(2, 120)
    scores = toxicity.Scorer(net).scores([*texts, b"", b"... !"])
    assert ((scores[:120] >= 0.7) == (labels == 1)).mean() > 0.95
    assert ((scores >= 0) & (scores <= 1)).all()


def test_gradients_are_right():
    net = toxicity.Network.fresh(np.empty(0, np.uint64))
    draw = np.random.default_rng(3)
    gates = draw.normal(0, 1, (3, toxicity.WINDOW, 6 * toxicity.STATE)).astype(np.float64)
    real = np.ones((3, toxicity.WINDOW), bool)
    real[2, 20:] = False
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    labels = np.array([1.0, 0, 1])

    def loss():
        z = net.forward(gates, real)
        return float((np.log1p(np.exp(z)) - labels * z).sum())

    g, d_gates = net.gradients(gates, real, lambda z: toxicity.sigmoid(z) - labels)
    for name, at in (("out", (3,)), ("attend", (9,)), ("f", (2, 20)), ("b", (4, 9)), ("level", (0,))):
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        down = loss()
        net.p[name][at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(np.asarray(g[name])[at], rel=0.05, abs=2e-3)
    assert np.abs(d_gates[2, 20:]).max() == 0


def test_windows_cover_texts():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        starts = toxicity.window_starts(n)
        assert {k for s in starts for k in range(s, s + toxicity.WINDOW)} >= set(range(n)) and (np.diff(starts) > 0).all()


def test_toxicity_sample_is_taken_of_documents_that_are_there(spark):
    docs = spark.createDataFrame([(k, "short" if k % 4 else "long " * 50) for k in range(900, 960)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1_000)], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels, count=(10, 10), size=40)
    assert len(texts) == 20 and y.sum() == 10
    assert all(len(t) <= 40 for t in texts) and any(b"long" in t for t in texts)


def test_toxicity_of_awkward_tables(spark, corpus):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (99, 1), (3, None), (5, 0), (11, 1)],
                                   "doc_id long, toxic int")
    net = toxicity.fit(corpus, labels)
    got = toxicity.scored(corpus, net).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit(corpus, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.scored(corpus, None).collect()} == {0.5}
    assert toxicity.scored(none(spark), net).count() == 0


def test_toxicity_scores_give_their_memory_back(spark):
    """Caches are empty when a task's memory is given back, and a table of gates takes only the rows written."""
    texts, y = labelled(1, 60)
    scorer = toxicity.Scorer(toxicity.Trainer(texts, y).train(1))
    first = scorer.scores(texts)
    room = scorer.table.shape
    records = iter([pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts])], ["text"])])
    assert sum(b.num_rows for b in common.batches(records, 7, scorer)) == len(texts)
    assert not scorer.known and not scorer.fresh and not scorer.table.any()
    assert scorer.scores(texts).tolist() == first.tolist() and scorer.table.shape == room
    docs = spark.createDataFrame([(k, "one two") for k in range(900, 960)], "doc_id long, text string").localCheckpoint()
    labels = spark.createDataFrame([(k, k % 2) for k in range(1_000)], "doc_id long, toxic int").localCheckpoint()
    made = type(spark).createDataFrame
    try:
        type(spark).createDataFrame = None  # local rows would start workers of their own
        assert len(toxicity.sample(docs, labels, count=(10, 10))[0]) == 20
    finally:
        type(spark).createDataFrame = made
