"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Texts with the same set are one *set* from here on. MinHash values
are grouped into bands; sets that agree in a band are candidates. Inside a band's bucket pairs are held
against each other by comparing MinHash values step by step, and a pair is dropped as soon as the
posterior probability (uniform prior) that its similarity reaches the threshold falls below `TOLERANCE`.
Pairs that stay tie sets into candidate groups; buckets with the same members are looked at once. Within
a group all pairs are pruned the same way once more and the rest verified on the shingles themselves.

No pair is ever a row: a task puts out the number of links of each set and edges of a spanning forest.
Large buckets and groups are cut into blocks, and each pair of blocks is a task of its own.

A pair at the threshold is missed by all bands with probability (1 - 0.8 ** 3) ** 30, below 1e-9, and
dropped wrongly with TOLERANCE.

Defined results: texts of fewer words than a shingle are one shingle of all their words; null, empty and
wordless texts have equal, empty sets and are linked with each other only; repeated rows and null ids are
rows of their own; class_id is the least doc_id of the class, null if it has none.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import batches, mix, shingle_hashes, stored, utf8, whole, wide, word_hashes
from flowsift.llm.graph import components
from flowsift.llm.positional_index import text_hashes

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 3
HASHES = BANDS * ROWS
TOLERANCE = 1e-8
STEP = 10
# sets of one block of a bucket or group; shingles of one block of a group
BLOCK, BLOCK_SHINGLES = 1_024, 1_000_000
# sets that are held against others at once
TILE = 256

_DRAW = np.random.default_rng(20)
_FACTOR = _DRAW.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _DRAW.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After each step: fewest equal values of the first k that leave a pair in the race."""
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        # P(similarity >= t | c of k equal) = P(Binomial(k + 1, t) <= c)
        below, c = 0.0, 0
        while True:
            below += comb(k + 1, c) * threshold**c * (1 - threshold) ** (k + 1 - c)
            if below >= tolerance:
                break
            c += 1
        out.append(c)
    return out


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each of the MinHash values of some sets; empty sets have zeros."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    values = np.concatenate([sets[k] for k in full])
    values = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
    least = np.empty((len(full), HASHES), np.uint32)
    for k in range(HASHES):
        x = values * _FACTOR[k] + _SHIFT[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        least[:, k] = np.minimum.reduceat(x, starts)
    out[full] = (mix(least.astype(np.uint64) + np.uint64(1)) >> np.uint64(48)).astype(np.uint16)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One number per band; with its band's number it holds the values themselves."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.int64)
    return parts[:, :, 0] | parts[:, :, 1] << 16 | parts[:, :, 2] << 32 | np.arange(BANDS, dtype=np.int64) << 48


def values_of(keys: np.ndarray) -> np.ndarray:
    """MinHash values of band numbers."""
    return np.stack([keys & 0xFFFF, keys >> 16 & 0xFFFF, keys >> 32 & 0xFFFF], axis=2).astype(np.uint16).reshape(
        len(keys), HASHES)


def surviving(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b that the posterior doesn't rule out."""
    equal = np.zeros((len(a), len(b)), np.int16)
    for k in range(STEP):
        equal += a[:, k : k + 1] == b[:, k]
    left, right = np.nonzero(equal >= least[0])
    count = equal[left, right]
    for step in range(1, len(least)):
        if not len(left):
            break
        part = slice(step * STEP, step * STEP + STEP)
        count = count + (a[left, part] == b[right, part]).sum(axis=1)
        keep = count >= least[step]
        left, right, count = left[keep], right[keep], count[keep]
    return left, right


class Forest:
    """Union-find over a task's own sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def tie(self, left, right) -> None:
        for x, y in zip(left, right):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def tied(values: np.ndarray, side: np.ndarray, least: list[int]) -> Forest:
    """Connects rows whose pairs survive, comparing a row only with rows that nothing has reached yet.

    `side` tells the two blocks of a pair of blocks apart; pairs inside a block are then another task's.
    """
    n = len(values)
    forest = Forest(n)
    crossed = len(np.unique(side)) > 1
    waiting = np.arange(n)
    while len(waiting):
        front = waiting[:1]
        waiting = waiting[1:]
        while len(front) and len(waiting):
            reached = []
            for x in front[:64]:
                other = waiting[side[waiting] != side[x]] if crossed else waiting
                _, hit = surviving(values[x : x + 1], values[other], least)
                if len(hit):
                    forest.tie([int(x)] * len(hit), other[hit].tolist())
                    reached.append(other[hit])
                    waiting = np.setdiff1d(waiting, other[hit], assume_unique=True)
            front = np.concatenate([front[64:], *reached])
    return forest


def _signed(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest of the shingle set, its size, band numbers."""

    def sign(records):
        memo = word_hashes()
        for batch in batches(records, 100, memo):
            sets = [shingle_hashes(text_hashes(t, memo), WIDTH) for t in utf8(batch.column(2))]
            keys = band_keys(min_hashes(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array(map(len, sets), pa.int64()),
                 pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))],
                ["row", "doc_id", "digest", "size", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "text").mapInArrow(
        sign, f"row bigint, doc_id {kind}, digest binary, size bigint, keys array<bigint>")


def _blocks(rows: DataFrame, name: str, parts) -> DataFrame:
    """A copy of each row for every pair of blocks that its own block is in."""
    own = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("parts")))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select(
        *rows.columns, "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def candidate_groups(sets: DataFrame, threshold: float) -> DataFrame:
    """set_id, group_id of all sets with a surviving candidate."""
    least = least_matches(threshold, TOLERANCE)
    keyed = sets.where("size > 0").select("set_id", F.explode("keys").alias("key"))
    buckets = (
        keyed.groupBy("key").agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("sum"),
            F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("xor"))
        .where("n > 1").groupBy("n", "sum", "xor").agg(F.min("key").alias("key")).select("key", "n"))
    met = keyed.join(buckets, "key").join(sets.select("set_id", "keys"), "set_id")
    dealt = _blocks(met.select("key", "n", "set_id", "keys"), "key", F.ceil(F.col("n") / BLOCK))
    tasks = 8 * wide(sets)
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("key", "low", "high"), F.lit(tasks)))

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("set_id").to_numpy()
        own, key, low, high = (table.column(c).to_numpy() for c in ("own", "key", "low", "high"))
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
        a, b = [], []
        order = np.lexsort((ids, high, low, key))
        here = np.stack([key[order], low[order], high[order]])
        edges = np.concatenate([[0], np.flatnonzero((here[:, 1:] != here[:, :-1]).any(axis=0)) + 1, [len(ids)]])
        for begin, end in zip(edges, edges[1:]):
            part = order[begin:end]
            values = values_of(keys[part])
            if len(part) == 2:
                left, right = surviving(values[:1], values[1:], least)
                tops = [(1, 0)] if len(left) and (own[part[0]] != own[part[1]] or low[part[0]] == high[part[0]]) else []
            elif low[part[0]] != high[part[0]] and len(np.unique(own[part])) < 2:
                tops = []  # one of the blocks is empty
            else:
                forest = tied(values, own[part], least)
                tops = [(k, t) for k in range(len(part)) if (t := forest.top(k)) != k]
            for k, t in tops:
                a.append(ids[part[k]])
                b.append(ids[part[t]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    edges = dealt.groupBy("task").applyInArrow(compare, "a bigint, b bigint")
    return components(edges).select(F.col("node").alias("set_id"), F.col("label").alias("group_id"))


def _verified(texts: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """set_id, links and tie: per task the weight of a set's partners, and a set it is connected with."""
    least = least_matches(threshold, TOLERANCE)
    sized = groups.groupBy("group_id").agg(F.greatest(
        F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK)).alias("cut"))
    rows = groups.join(sized, "group_id").join(texts, "set_id")
    dealt = _blocks(rows.select("set_id", "group_id", "weight", "keys", "text", "cut"), "group_id", F.col("cut"))
    tasks = 8 * wide(texts)
    # a group of several blocks has tasks of its own, others share one
    task = F.when(F.col("cut") > 1, F.concat_ws("-", "group_id", "low", "high")).otherwise(
        F.pmod(F.xxhash64("group_id"), F.lit(tasks)).cast("string"))

    def verify(table: pa.Table) -> pa.Table:
        memo = word_hashes(200_000)
        ids, group, own, weight = (table.column(c).to_numpy() for c in ("set_id", "group_id", "own", "weight"))
        crossing = (table.column("low").to_numpy() != table.column("high").to_numpy())
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
        texts = utf8(table.column("text").combine_chunks())
        links, tie = np.zeros(len(ids), np.int64), ids.copy()
        order = np.lexsort((ids, group))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(ids)]])
        for begin, end in zip(edges, edges[1:]):
            part = order[begin:end]
            values = values_of(keys[part])
            sets = [shingle_hashes(text_hashes(texts[k], memo), WIDTH) for k in part]
            forest = Forest(len(part))
            for left, right in verified_pairs(values, sets, own[part] if crossing[part[0]] else None, least, threshold):
                np.add.at(links, part[left], weight[part[right]])
                np.add.at(links, part[right], weight[part[left]])
                forest.tie(left.tolist(), right.tolist())
            for k in range(len(part)):
                tie[part[k]] = ids[part[forest.top(k)]]
        some = (links > 0) | (tie != ids)
        return pa.table({"set_id": ids[some], "links": links[some], "tie": tie[some]})

    return dealt.withColumn("task", task).groupBy("task").applyInArrow(
        verify, "set_id bigint, links bigint, tie bigint")


def verified_pairs(values: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, least: list[int],
                   threshold: float):
    """Left and right of the pairs that reach the threshold, some rows against some others at a time.

    All pairs of rows, or those between the two blocks that `side` tells apart. What is held at once depends
    on `TILE`, not on the number of pairs.
    """
    every = np.arange(len(values))
    first = second = every
    if side is not None:
        first, second = every[side == side.min()], every[side != side.min()]
    for begin in range(0, len(first), TILE):
        rows = first[begin : begin + TILE]
        for start in range(begin if side is None else 0, len(second), 4 * TILE):
            others = second[start : start + 4 * TILE]
            left, right = surviving(values[rows], values[others], least)
            left, right = rows[left], others[right]
            if side is None:
                once = left < right
                left, right = left[once], right[once]
            keep = exact(sets, left, right, threshold)
            yield left[keep], right[keep]


def exact(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold; shared shingles are counted over all pairs at once if many."""
    sizes = np.array([len(s) for s in sets], np.int64)
    rows, x = np.unique(left, return_inverse=True)
    others, y = np.unique(right, return_inverse=True)
    if len(left) <= 4 * (len(rows) + len(others)):
        common = np.fromiter(
            (len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)), np.int64, len(left))
    else:
        both = np.concatenate([rows, others])
        _, number, count = np.unique(np.concatenate([sets[k] for k in both]), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1  # shingles that stand once are in no intersection
        owner = np.repeat(np.arange(len(both)), sizes[both])
        keep = count[number] > 1
        owner, column = owner[keep], shared[number[keep]]
        total = np.zeros((len(rows), len(others)), np.float32)
        for begin in range(0, int(shared[-1]) + 1 if len(shared) else 0, 4_096):
            here = (column >= begin) & (column < begin + 4_096)
            matrix = np.zeros((len(both), 4_096), np.float32)
            matrix[owner[here], column[here] - begin] = 1
            total += matrix[: len(rows)] @ matrix[len(rows) :].T
        common = total[x, y].astype(np.int64)
    return common >= threshold * (sizes[left] + sizes[right] - common) - 1e-9


def numbered(docs: DataFrame, *extra: str) -> DataFrame:
    return whole(docs, *extra).withColumn("row", F.monotonically_increasing_id())


def ngram_links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row (see `numbered`), doc_id, class_id, n_links and first (one row of each class) for every row."""
    rows = numbered(docs)
    signed = stored(_signed(rows))
    sets = stored(signed.groupBy("digest").agg(
        F.min("row").alias("set_id"), F.count("*").alias("weight"), F.first("size").alias("size"),
        F.first("keys").alias("keys")))
    groups = stored(candidate_groups(sets, threshold).join(sets.drop("digest"), "set_id"))
    texts = rows.select(F.col("row").alias("set_id"), "text")
    found = stored(_verified(texts, groups, threshold))
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    classes = components(found.where("tie != set_id").select(F.col("set_id").alias("a"), F.col("tie").alias("b")))
    of_set = (
        sets.select("digest", "set_id", "weight")
        .join(links, "set_id", "left").join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
        .select("digest", F.coalesce("label", "set_id").alias("class"),
                (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    each = stored(signed.select("row", "doc_id", "digest").join(of_set, "digest").drop("digest"))
    least = each.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"))
    return each.join(least, "class").select(
        "row", "doc_id", "class_id", "n_links", (F.col("row") == F.col("head.row")).alias("first"))
