import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from flowsift.llm import ngram_join, spot_signatures, suffix_dedup
from tests.llm.fixtures import none, rows, words


def shingles(text):
    w = words(text)
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def linked(docs):
    """Class and number of links of every (id, text), pair by pair."""
    sets = [shingles(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(docs)
    for a in range(len(docs)):
        for b in range(a):
            alike = sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and sets[a] and sets[b]
            if alike:
                links[a] += 1
                links[b] += 1
                top[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return Counter((i, ids.get(find(k)), links[k]) for k, (i, _) in enumerate(docs))


def test_links_of_awkward_texts(corpus):
    got = ngram_join.ngram_links(corpus).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == linked([(i, t) for i, t, *_ in rows()])
    # two texts share the id 19, so two classes have it as theirs
    assert sum(r.first for r in got) == 1 + len({r.class_id for r in got})


@pytest.mark.parametrize("block", [1_024, 4])
def test_links_of_near_copies(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 100 * block)
    draw = np.random.default_rng(5)
    base = [[f"b{k}x{j}" for j in range(70)] for k in range(3)]
    docs = []
    for k in range(90):
        w = list(base[k % 3])
        for at in draw.integers(0, 70, int(draw.integers(0, 4))):
            w[at] = f"e{draw.integers(1000)}"
        docs.append((k, " ".join(w)))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = ngram_join.ngram_links(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == linked(docs)


@pytest.mark.parametrize("crossed", [False, True])
def test_verification_holds_no_square_of_a_group(crossed):
    draw = np.random.default_rng(6)
    base = draw.integers(0, 1 << 62, 40, dtype=np.uint64)
    sets = []
    for k in range(2_500):
        s = base.copy()
        s[draw.integers(0, 40, k % 7)] = draw.integers(0, 1 << 62)
        sets.append(np.unique(s))
    values = ngram_join.min_hashes(sets)
    side = np.arange(len(sets)) % 2 if crossed else None
    least = ngram_join.least_matches(0.8, 1e-8)
    got = np.zeros(len(sets), np.int64)
    tracemalloc.start()
    for left, right in ngram_join.verified_pairs(values, sets, side, least, 0.8):
        np.add.at(got, left, 1)
        np.add.at(got, right, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # the pairs alone would take more
    for k in draw.integers(0, len(sets), 12):
        want = sum(len(np.intersect1d(sets[k], s)) >= 0.8 * len(np.union1d(sets[k], s)) - 1e-9
                   for j, s in enumerate(sets) if j != k and (side is None or side[j] != side[k]))
        assert got[k] == want


def test_groups_are_cut_by_sets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    docs = [(k, " ".join(f"w{j}" for j in range(60)) + f" e{k}") for k in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    cut = []
    blocks = ngram_join._blocks
    monkeypatch.setattr(ngram_join, "_blocks", lambda rows, *rest: cut.append(blocks(rows, *rest)) or cut[-1])
    got = ngram_join.ngram_links(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == linked(docs)
    # 30 sets in eight blocks, few as their shingles are
    assert cut[-1].groupBy("low", "high").count().where("low != high").count() > 20


def test_pruning_keeps_pairs_at_the_threshold():
    least = ngram_join.least_matches(0.8, 1e-8)
    assert least == sorted(least) and least[-1] < 0.8 * ngram_join.HASHES


def removed(docs):
    """Bytes of 100-byte strings seen before, text by text."""
    seen, out = set(), Counter()
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            part = data[k : k + 100]
            if part in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(part)
        left = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i, len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize("kinds", [20_000, 0])
def test_suffix_dedup_of_awkward_texts(corpus, monkeypatch, kinds):
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    # of rows with one id and different texts only long ones are told apart by their order
    assert Counter(tuple(r) for r in suffix_dedup.dedup_digest(corpus).collect()) == removed(
        [(i, t) for i, t, *_ in rows()])


def test_suffix_dedup_of_periodic_texts(spark, tmp_path):
    draw = np.random.default_rng(8)
    base = ["".join(draw.choice(list("abé "), 300)) for _ in range(4)]
    docs = [(int(k), "".join(base[draw.integers(4)][draw.integers(80) :][: draw.integers(60, 260)] + "ab" * int(draw.integers(0, 90))
                             for _ in range(draw.integers(0, 4)))) for k in draw.permutation(80)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = suffix_dedup.dedup_digest(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert Counter(tuple(r) for r in got) == removed(docs)


@pytest.mark.parametrize("seed", range(5))
def test_deep_shallow_order(seed):
    draw = np.random.default_rng(seed)
    strings = [bytes(draw.choice([97, 98], draw.integers(0, 60)).astype(np.uint8)) for _ in range(80)]
    strings += [b"a" * 50 + s for s in strings[:40]] + [b"a" * 90, b"a" * 90]
    order = suffix_dedup.deep_shallow_order(strings, shallow=8)
    assert [strings[k] for k in order] == sorted(strings) and sorted(order.tolist()) == list(range(len(strings)))


def test_kept_text_keeps_letters_whole():
    text = "aéé日b".encode()
    assert suffix_dedup.kept_text(text, [{"start": 2, "stop": 6}]) == "aé日b"
    assert suffix_dedup.kept_bytes(text, [{"start": 0, "stop": 1}]) == text[1:]


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(corpus):
    unique = [(i, t or "") for i, t, *_ in rows() if i is not None and i < 19 and i != 2]
    docs = sorted(unique, reverse=True)
    signer = spot_signatures.Signer()
    of = lambda t: set(signer.signatures(t.encode()).tolist())
    got = {r.doc_id: r for r in spot_signatures.fingerprints(corpus.where("doc_id < 19 and doc_id != 2"), parts=4).collect()}
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == spot_signatures.written(signer.signatures(text.encode()))
        assert r.near_edited == pytest.approx(likeness(of(text), of(edited)))
        assert r.near_next == pytest.approx(likeness(of(text), of(after)))


@pytest.mark.parametrize("rare", [0, 40])
def test_fingerprints_cover_texts_of_few_common_words(rare):
    signer = spot_signatures.Signer()
    w = [f"слово{k}" if not rare or k % rare else "the" for k in range(200)]
    of = lambda w: set(signer.signatures(" ".join(w).encode()).tolist())
    own = of(w)
    assert likeness(own, of(w[:3] + [f"x{k}" for k in range(197)])) < 0.1
    assert 0.3 < len(own & of(w[:100] + [f"x{k}" for k in range(100)])) / len(own) < 0.7
    for k in range(200):
        edited = of([*w[:k], "other", *w[k + 1 :]])
        # a word shows wherever it stands, in the chains around it only
        assert edited != own and len(edited - own) <= 8


def test_fingerprints_of_all_rows(corpus, spark):
    assert spot_signatures.fingerprints(corpus, parts=3).count() == len(rows())
    assert spot_signatures.fingerprints(none(spark)).count() == 0
    one = spot_signatures.fingerprints(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"aa").hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_pruned_jaccard(seed):
    draw = np.random.default_rng(seed)
    for _ in range(50):
        a, b = (np.unique(draw.integers(0, 120, draw.integers(0, 100)).astype(np.uint32)) for _ in range(2))
        exact = likeness(set(a.tolist()), set(b.tolist()))
        assert spot_signatures.pruned_jaccard(a, b) == pytest.approx(exact)
        assert spot_signatures.pruned_jaccard(a, b, 0.5) == pytest.approx(exact if exact >= 0.5 else 0) or (
            exact < 0.5 and spot_signatures.pruned_jaccard(a, b, 0.5) < 0.5)


def test_similar_sets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pairs, members = spot_signatures.similar_sets(docs, 0.8)
    signer = spot_signatures.Signer()
    sets = {tuple(signer.signatures(r.text.encode()).tolist()) for r in docs.collect()} - {()}
    every = [set(s) for s in sets]
    want = sum(likeness(a, b) >= 0.8 for k, a in enumerate(every) for b in every[:k])
    assert pairs.count() == want and members.select("set_id").distinct().count() == len(every)


def test_empty_tables(spark):
    assert ngram_join.ngram_links(none(spark)).count() == 0
    assert suffix_dedup.dedup_digest(none(spark)).count() == 0
