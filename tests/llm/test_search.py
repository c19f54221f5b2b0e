import random
import zlib
from collections import Counter, defaultdict

import pytest

from flowsift.llm import license_scan, positional_index, sharding
from tests.llm.fixtures import none, rows, words

ITEMS = [(1, "nobody in the valley could say when the river had last been free of ice nor who"), (2, None), (3, "..."),
         (4, "a b c"), (5, "One"), (None, "c d e"), (5, "the the")]


def brute(text, window=13):
    own, hit, items = words(text), set(), set()
    for item, phrase in ITEMS:
        w = words(phrase)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            for b in range(len(own) - k + 1):
                if own[b : b + k] == w[a : a + k]:
                    hit.update(range(b, b + k))
                    items.add("" if item is None else str(item))
    return len(own), len(hit), tuple(sorted(items))


@pytest.mark.parametrize("group_words", [1_000_000, 10])
def test_contamination(spark, corpus, group_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = positional_index.contamination(corpus, items, group_words=group_words).collect()
    want = Counter((i, *brute(t)) for i, t, *_ in rows())
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want


def test_item_pieces_hold_every_window_once_and_the_driver_one_group(spark, corpus, monkeypatch):
    long = " ".join(f"w{k * k % 997} the {k % 89}" for k in range(300))
    items = spark.createDataFrame([(1, long)] * 30 + [(2, "a b c")] * 30, "item_id long, text string")
    # 900 words: windows start at the first 888, a hundred starts to a piece; equal items are one
    pieces = positional_index.item_pieces(items, 13, piece=100).collect()
    assert sorted(p.words for p in pieces) == [3, 100, *[112] * 8]
    monkeypatch.setattr(positional_index.item_pieces, "__defaults__", (100,))
    fetched = []
    monkeypatch.setattr(positional_index, "fetched",
                        lambda *x, own=positional_index.fetched: fetched.append(own(*x)) or fetched[-1])
    many = positional_index.contamination(corpus, items, group_words=150)
    assert len(fetched) > 3 and max(len(p.flat) for p in fetched) < 900 * 13
    one = positional_index.contamination(corpus, items)
    columns = ["doc_id", "n_words", "n_hit", "items"]
    assert sorted(map(str, many.select(columns).collect())) == sorted(map(str, one.select(columns).collect()))
    assert one.where("n_hit > 0").count() >= 4


def test_no_items_and_no_documents(spark, corpus):
    items = spark.createDataFrame([], "item_id long, text string")
    assert positional_index.contamination(corpus, items).where("n_hit > 0").count() == 0
    assert positional_index.contamination(none(spark), items).count() == 0


def test_proximity(corpus):
    index = positional_index.build_index(corpus)
    got = {r.doc_id for r in positional_index.proximity(index, ["river", "ice"], 8).collect()}
    assert got == {None, 1, 2, 3}
    assert positional_index.proximity(index, ["river", "valley"], 3).count() == 0


def test_license_scan(corpus):
    phrases = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
    want = Counter()
    for i, t, *_ in rows():
        w, places, labels = words(t), [], set()
        for phrase, label in phrases:
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        want[i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    got = license_scan.license_scan(corpus).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_license_labels_of_its_own(spark):
    text = "x " * 40 + "Redistribution and use in source and binary forms, with or without modification, are permitted"
    docs = spark.createDataFrame([(1, text), (2, "a general public license version 3"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.license_scan(docs).collect()}
    assert got[1] == "bsd" and got[3] == ""
    assert license_scan.license_scan(none(spark)).count() == 0


@pytest.mark.parametrize("cell", [20_000, 2])
def test_sharding(corpus, cell):
    got = sharding.balanced_shards(corpus, shards=4, cell=cell).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_keep_copies_together(spark):
    data = [(k, f"text {k // 3}" if k < 150 else "hot" if k < 400 else f"alone {k}") for k in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = sharding.balanced_shards(docs, shards=6).collect()
    of = defaultdict(Counter)
    for r in got:
        of[dict(data)[r.doc_id]][r.shard] += 1
    split = sum(len(c) > 1 for t, c in of.items() if t != "hot")
    assert split <= 6 and len(of["hot"]) <= 5
    assert sharding.balanced_shards(none(spark)).count() == 0


def shards_of(spark, data, shards):
    got = sharding.balanced_shards(spark.createDataFrame(data, "doc_id long, text string").repartition(4), shards=shards)
    of = defaultdict(Counter)
    texts = dict(data)
    for r in got.collect():
        of[texts[r.doc_id]][r.shard] += 1
    return of


def test_shards_where_every_row_is_repeated(spark):
    of = shards_of(spark, [(k, f"text {k // 2}") for k in range(2_000)], 8)
    assert sum(len(c) > 1 for c in of.values()) <= 50


def test_shards_of_large_groups_only(spark):
    of = shards_of(spark, [(k, f"text {k % 4}") for k in range(1_600)], 8)
    # 400 rows of a group fill two shards of 200; spread over all shards they are in 32 parts
    assert sum(map(len, of.values())) <= 20


def test_shards_of_skewed_groups_in_few_rounds(spark, monkeypatch):
    draw = random.Random(5)
    sizes, data = [], []
    while len(data) < 4_000:
        sizes.append(min(900, int(2 * draw.paretovariate(0.9))))
        data += [(len(data) + k, f"text {len(sizes)}") for k in range(sizes[-1])]
    shards, rounds = 8, []
    monkeypatch.setattr(sharding, "_shares", lambda *x, own=sharding._shares: rounds.append(1) or own(*x))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = sharding.balanced_shards(docs, shards=shards).join(docs, "doc_id").withColumnRenamed("text", "hub")
    measured = sharding.cut_links(got).first()
    # a greedy plan: the largest groups first, each into the emptiest shards
    free, cut = [len(data) / shards] * shards, 0
    for size in sorted((s for s in sizes if s > 1), reverse=True):
        parts = []
        while size > 0.5:
            k = max(range(shards), key=free.__getitem__)
            parts.append(min(size, free[k]))
            free[k] -= parts[-1]
            size -= parts[-1]
        cut += sum(n * (sum(parts) - n) / sum(parts) for n in parts)
    assert len(rounds) <= 20 and measured.cut <= 2 * cut
