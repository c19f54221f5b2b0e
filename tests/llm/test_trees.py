import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.llm import merkle, periodic_runs
from flowsift.llm.queries import ORACLE, QUERIES
from tests.llm.fixtures import corpus as make
from tests.llm.fixtures import none, rows
from tests.oracle import compare, connect


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


# --- runs


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : j + q]
            if j > i and length >= max(6, 4 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = crc(doc_id)
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def digests(docs):
    found = periodic_runs.run_digests(periodic_runs.with_repeated_tails(docs))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return Counter(map(tuple, found.collect()))


def test_runs_of_awkward_texts(corpus):
    short = [r for r in rows() if r[0] not in (10, 11)]
    got = digests(corpus.where("doc_id not in (10, 11) or doc_id is null"))
    assert got == Counter(plain_digest(r[0], r[1]) for r in short)
    # the long ones hold 40 000 words
    assert sum(digests(corpus.where("doc_id in (10, 11)")).values()) == 2


@pytest.mark.parametrize("index", [500_000, 50])
def test_runs_of_drawn_texts(spark, monkeypatch, index):
    monkeypatch.setattr(periodic_runs, "INDEX_WORDS", index)
    draw = random.Random(index)
    docs = []
    for k in range(300):
        words = []
        for _ in range(draw.randint(0, 5)):
            unit = [draw.choice("abc") for _ in range(draw.randint(1, 12))]
            words += unit * draw.randint(1, 6) + [draw.choice("abcd") for _ in range(draw.randint(0, 8))]
        docs.append((k * 3, draw.choice([" ", "\n", " \t "]).join(words * draw.randint(1, 3)), "en", "s", 0, 1, "", None))
    assert digests(make(spark, docs)) == Counter(plain_digest(d[0], d[1]) for d in docs)


def test_no_documents(spark):
    assert digests(none(spark)) == Counter()
    assert merkle.verified_rows(none(spark)).collect() == [] and merkle.manifest(none(spark)).collect() == []


def test_words_and_collapsed_text(spark):
    docs = make(spark, [(1, "x  a b\na b a b a b y", None, None, None, 0, "", None), (2, "one", None, None, None, 0, "", None)])
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs, "row").collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 8, 2)] and got[1].collapsed == "x a b y" and got[1].n_words == 10
    assert got[2].runs == [] and got[2].collapsed == "one" and got[2].row == 0


def test_a_lag_is_extended_once(monkeypatch):
    """A text of one word repeated has one run, and one extension."""
    calls = []
    matches = periodic_runs._matches
    monkeypatch.setattr(periodic_runs, "_matches", lambda a, b: (calls.append(1), matches(a, b))[1])
    assert periodic_runs.find_runs(np.array([0] * 50_000 + [1])) == [(0, 50_000, 1)]
    assert len(calls) == 2


# --- trees


def climb(digests):
    """The root, and the siblings before and after every leaf, level by level."""
    steps, cover = [[] for _ in digests], [[k] for k in range(len(digests))]
    while len(digests) > 1:
        up, covered = [], []
        for k in range(0, len(digests), 3):
            run = digests[k : k + 3]
            for j in range(len(run)):
                for leaf in cover[k + j]:
                    steps[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            covered.append(sum(cover[k : k + 3], []))
        digests, cover = up, covered
    return digests[0], steps


def plain_manifest(docs):
    def part(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(d, text):
        doc_id, _, lang, source, n_chars = d[:5]
        return sha("".join(map(part, (doc_id, source, lang, n_chars, text))))

    trees = {}
    for d in docs:
        trees.setdefault(d[3], []).append(d)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in order:
        trees[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        own[s] = climb([leaf(d, d[1]) for d in trees[s]])
    root, above = climb([own[s][0] for s in order])
    out = Counter()
    for s, top in zip(order, above):
        for d, path in zip(trees[s], own[s][1]):
            path, text = path + top, d[1]
            if text is not None and crc(d[0]) % 2 == 0:
                text = text.replace("\n", "")
            at = leaf(d, text)
            for before, after in path:
                at = sha(before + at + after)
            out[d[0], leaf(d, d[1]), own[s][0], root, sha("".join(b + a for b, a in path)), at, at == root] += 1
    return out


def manifests(docs):
    return Counter(map(tuple, merkle.verified_rows(docs).collect()))


def test_manifest_of_awkward_rows(spark, corpus):
    docs = [(r[0], r[1], r[2], (None, "", "s", "é")[k % 4], *r[4:]) for k, r in enumerate(rows())]
    got = merkle.verified_rows(make(spark, docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == plain_manifest(docs)
    assert manifests(corpus) == plain_manifest(rows())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 82])
def test_manifest_of_sizes(spark, n):
    docs = [(k * 5 % 83, f"t{k}\n", "en", f"s{k}" if k % 3 else "hot", 2, 1, "", None) for k in range(n)]
    assert manifests(make(spark, docs)) == plain_manifest(docs)


def test_nodes_nest(spark, corpus):
    nodes = merkle.manifest(corpus.withColumn("source", F.concat("source", F.col("doc_id") % 2))).collect()
    for node in nodes:
        assert node.lo < node.hi <= node.lo + 3 ** node.level
        if node.level:
            inside = [x for x in nodes if x.tree == node.tree and x.level == node.level - 1 and node.lo <= x.lo and x.hi <= node.hi]
            assert node.digest == sha("".join(x.digest for x in sorted(inside, key=lambda x: x.lo)))
    assert sum(x.tree is None and x.level == 0 for x in nodes) == 3


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) is None
