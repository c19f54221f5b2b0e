"""Periodic runs of words: stretches that repeat a period of q words, four times and more.

A run of period q has at least three more periods behind its first one, so at a lag of q it agrees with itself
over 3 * q words, and never over fewer than `LEAST_MATCH`. Lags are taken in classes [2^j, 2^(j+1)): every
run of a class holds k-grams of k = max(LEAST_MATCH, 3 * 2^j) words that come again one period later. k is at
least one and a half periods, so inside a run the *next* occurrence of such a k-gram lies exactly one smallest
period on (two periods whose sum fits into a stretch imply their greatest common divisor). Hence pairs of
neighbouring occurrences in the same document are all seeds there are: at most one per word and class.

A seed lies on the diagonal of its lag and is extended both ways as long as words agree. For each lag the
furthest word covered by an extension so far is kept, and seeds before it are not extended again. Stretches
found this way have lengths of more than two periods, of which a text of n words has fewer than n.

k-grams are told apart by ranks, not hashes: ranks of 2^m words come from pairs of ranks of half that width,
and words whose gram is unique leave the index, so usual text costs little beyond the first classes. One
batch of documents is one index; a number of its own after each document keeps grams from crossing borders.

Defined results: null and empty texts and texts of white space have no words and no runs; a null id, repeated
rows and equal ids are rows of their own; other columns are ignored unless named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.llm.common import batches, utf8, whole

# a run has this many words at least, and this many periods
LEAST_WORDS = 6
LEAST_PERIODS = 4
LEAST_MATCH = LEAST_WORDS - 1

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACES = r"[\x20\x09-\x0D]+"


def _joined(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of pairs, and how often each pair occurs."""
    pairs = left * (int(right.max(initial=0)) + 1) + right
    _, rank, count = np.unique(pairs, return_inverse=True, return_counts=True)
    return rank, count


def _grams(ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For every class of lags: first lag, k, positions whose k-gram comes again, and the ranks of these.

    `rank` holds ranks of grams of `width` words at all positions; -1 where the gram is unique or cut off.
    """
    size = len(ids)

    def wider(rank: np.ndarray, shift: int) -> np.ndarray:
        """Ranks of what begins with a gram of `rank` and ends with another, `shift` words on."""
        out = np.full(size, -1, np.int64)
        at = np.flatnonzero(rank[: max(0, size - shift)] >= 0)
        at = at[rank[at + shift] >= 0]
        if len(at):
            new, count = _joined(rank[at], rank[at + shift])
            often = count[new] > 1
            out[at[often]] = new[often]
        return out

    quads = wider(wider(ids, 1), 2)
    rank, width, lag = quads, 4, 1
    while True:
        k = max(LEAST_MATCH, 3 * lag)
        # a gram of k words is two of `width` words that overlap
        gram = wider(rank, k - width)
        at = np.flatnonzero(gram >= 0)
        if len(at):
            yield lag, k, at, gram[at]
        if not (rank >= 0).any():
            return
        lag *= 2
        # the next class has k = 3 * lag, and width has to be two thirds of it or less, half of it or more
        while 2 * width <= 2 * lag:
            rank, width = wider(rank, width), 2 * width


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements agree, looked up in pieces that double."""
    done, step, most = 0, 64, min(len(a), len(b))
    while done < most:
        end = min(done + step, most)
        differ = np.flatnonzero(a[done:end] != b[done:end])
        if len(differ):
            return done + int(differ[0])
        done, step = end, 2 * step
    return done


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a row of numbers, where documents end in numbers of their own."""
    found = []
    furthest: dict[int, int] = {}
    for first, k, at, gram in _grams(ids):
        order = np.lexsort((at, gram))
        at, gram = at[order], gram[order]
        near = np.flatnonzero((gram[1:] == gram[:-1]) & (np.diff(at) >= first) & (np.diff(at) < 2 * first))
        start, lag = at[near], at[near + 1] - at[near]
        order = np.lexsort((start, lag))
        start, lag = start[order], lag[order]
        # a seed right behind another of its lag is covered by that one's extension
        fresh = np.ones(len(start), bool)
        fresh[1:] = (np.diff(start) != 1) | (np.diff(lag) != 0)
        for i, q in zip(start[fresh].tolist(), lag[fresh].tolist()):
            if i < furthest.get(q, 0):
                continue
            right = i + k + _matches(ids[i + k :], ids[i + q + k :])
            left = i - _matches(ids[:i][::-1], ids[q : i + q][::-1])
            furthest[q] = right
            length = right + q - left
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((left, length, q))
    return sorted(found)


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers, a number of its own after each text; where each text begins."""
    known: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    ids = np.empty(begins[-1], np.int64)
    for words, at in zip(texts, begins):
        ids[at : at + len(words)] = [known.setdefault(w, len(known)) for w in words]
    ids[begins[1:] - 1] = np.arange(len(texts)) + len(known)
    return ids, begins


# words of one index, about; a document is never cut
INDEX_WORDS = 500_000


def _cut(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    part, held = [], 0
    for words in texts:
        part.append(words)
        held += len(words)
        if held >= INDEX_WORDS:
            yield part
            part, held = [], 0
    if part:
        yield part


def _rows(texts: list[list[bytes]]) -> Iterator[tuple[int, list[dict], bytes]]:
    for part in _cut(texts):
        ids, begins = _numbered(part)
        runs = find_runs(ids)
        of = np.searchsorted(begins, [r[0] for r in runs], "right") - 1
        mine: dict[int, list] = {}
        for doc, (start, length, period) in zip(of.tolist(), runs):
            mine.setdefault(doc, []).append((start - int(begins[doc]), length, period))
        for doc, words in enumerate(part):
            own = sorted(mine.get(doc, ()), key=lambda r: (r[0], r[2]))
            if own:
                change = np.zeros(len(words) + 1, np.int64)
                for start, length, period in own:
                    change[start + period] += 1
                    change[start + length] -= 1
                words = [w for w, gone in zip(words, np.cumsum(change)) if not gone]
            yield len(part[doc]), [dict(zip(("start", "length", "period"), r)) for r in own], b" ".join(words)


def periodic_runs(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), collapsed, for every row.

    `collapsed` is the text's words joined by one space, without those that a run holds after its first period.
    """
    source = whole(docs, *extra)
    kept = [f for f in source.schema if f.name != "text"]
    schema = T.StructType([
        *kept, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType())])
    run = pa.struct([(f.name, pa.int64()) for f in RUN])

    def found(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(records):
            texts = [_WORD.findall(t) for t in utf8(batch.column("text"))]
            rows = list(_rows(texts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.list_(run)),
                 pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())],
                names=[f.name for f in schema])

    return source.mapInArrow(found, schema)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """The rows with a tail of the text made periodic in one of ten, by the crc of the id; other texts as they are."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = docs.withColumns({
        "_g": F.floor(h / 10).cast("bigint"),
        "_words": F.when(h % 10 == 0, F.array_remove(F.split("text", SPACES), ""))})
    words, n = F.col("_words"), F.size("_words")
    a = F.pmod(F.col("_g"), n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod("_g", F.lit(8))))).cast("int")
    # as many periods as the tail needs, cut to its length
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    edited = F.array_join(F.concat(F.slice(words, 1, a), tail), " ")
    return chosen.withColumn("text", F.when(n > 0, edited).otherwise(F.col("text"))).drop("_g", "_words")


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document: number of runs, its longest one, digests of all runs and of the collapsed text."""
    found = periodic_runs(docs)
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
