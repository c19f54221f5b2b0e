"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: every stored row is the index of one block of documents, with the sorted
term hashes of the block, the number of postings per term, and all postings as word numbers in the block.
A query term's list is found by bisection, lists are intersected from the rarest term of a phrase on,
each shifted by its offset, and a block answers for its own documents alone. Nothing of the index is
shuffled. The queries (benchmark items) are hashed in tasks into a stored table of pieces, each with a bounded
number of words. The pieces go to the blocks in groups of bounded size: the driver fetches the hashes of one
group, holds it against all blocks and writes the answers before it fetches the next, so neither the driver
nor a task holds more than one group however large the benchmark is; each group reads the index once. The
answers are merged per document.

Defined results: null texts and texts without words have no words and no hits; items without words
match nothing; null or repeated ids stay separate rows; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import batches, hashes, shared_folder, stored, utf8, whole, word_hashes, words

WINDOW = 13
# words of one group of items, and window starts of one piece; the driver holds one group at a time
GROUP_WORDS = 500_000
PIECE = 20_000
# documents and bytes of text of one block of the index
BLOCK_ROWS, BLOCK_BYTES = 2_000, 8_000_000
SEGMENT = 4_000_000


def text_hashes(data: bytes, memo) -> np.ndarray:
    """Word hashes of a text, long texts by segments that end between words."""
    if len(data) <= SEGMENT:
        return hashes(words(data), memo)
    parts, start = [], 0
    while start < len(data):
        end = min(len(data), start + SEGMENT)
        while end < len(data) and words(data[end : end + 1]):
            end += 1
        parts.append(hashes(words(data[start:end]), memo))
        start = end
    return np.concatenate(parts)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Block:
    """The positional index of some documents."""

    def __init__(self, terms, counts, positions, starts):
        self.terms, self.counts, self.positions, self.starts = terms, counts, positions, starts
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Block:
        sizes = np.array([len(t) for t in texts], np.int64)
        every = np.concatenate([*texts, np.empty(0, np.uint64)])
        terms, number = np.unique(every, return_inverse=True)
        postings = np.sort(number.astype(np.uint64) << np.uint64(32) | np.arange(len(every), dtype=np.uint64))
        counts = np.bincount(number, minlength=len(terms))
        return cls(terms, counts, (postings & np.uint64(0xFFFFFFFF)).astype(np.int64),
                   np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    def row(self) -> tuple[bytes, bytes, bytes, bytes]:
        gaps = np.diff(self.positions, prepend=0)  # differences wrap where a list ends
        return (_packed(np.diff(self.terms, prepend=np.uint64(0))), _packed(self.counts.astype("<u4")),
                _packed(gaps.astype("<i4")), _packed(self.starts))

    @classmethod
    def read(cls, terms: bytes, counts: bytes, positions: bytes, starts: bytes) -> Block:
        return cls(np.cumsum(_unpacked(terms, "<u8"), dtype=np.uint64), _unpacked(counts, "<u4").astype(np.int64),
                   np.cumsum(_unpacked(positions, "<i4"), dtype=np.int64), _unpacked(starts, "<i8"))

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number in the block and length of the postings list of each term; length 0 for unknown ones."""
        at = np.searchsorted(self.terms, terms)
        at = np.minimum(at, max(0, len(self.terms) - 1))
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return at, np.where(known, self.counts[at] if len(self.terms) else 0, 0)

    def postings(self, number: int) -> np.ndarray:
        return self.positions[self.first[number] : self.first[number + 1]]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def phrase(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places where the terms stand one after the other within one document."""
        order = np.argsort(lengths, kind="stable")
        places = self.postings(numbers[order[0]]) - order[0]
        places = places[places >= 0]
        for k in order[1:]:
            if not len(places):
                return places
            listed = self.postings(numbers[k])
            at = np.searchsorted(listed, places + k)
            at[at == len(listed)] = 0
            places = places[listed[at] == places + k]
        return places[self.document(places) == self.document(places + len(numbers) - 1)]

    def near(self, numbers: np.ndarray, lengths: np.ndarray, slop: int) -> np.ndarray:
        """Places of the rarest term that have every other term at most `slop` words away, same document."""
        order = np.argsort(lengths, kind="stable")
        places = self.postings(numbers[order[0]])
        document = self.document(places)
        for k in order[1:]:
            listed = self.postings(numbers[k])
            low = np.maximum(places - slop, self.starts[document])
            high = np.minimum(places + slop, self.starts[document + 1] - 1)
            keep = np.searchsorted(listed, low) < np.searchsorted(listed, high, "right")
            places, document = places[keep], document[keep]
        return places


def build_index(docs: DataFrame) -> DataFrame:
    """One row per block: its name, doc_ids and index. To be stored, since names are drawn at random."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(records):
        memo = word_hashes()
        for batch in batches(records, BLOCK_ROWS, memo):
            ids, texts = batch.column(0), utf8(batch.column(1))
            start, size = 0, 0
            for end, text in enumerate([*texts, None]):
                if text is None or (size and size + len(text) > BLOCK_BYTES):
                    if end > start:
                        row = Block.of([text_hashes(t, memo) for t in texts[start:end]]).row()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int.from_bytes(os.urandom(7))], pa.int64()),
                             pa.array([ids.slice(start, end - start).to_pylist()], pa.list_(ids.type)),
                             *(pa.array([x], pa.binary()) for x in row)],
                            ["block", "doc_ids", "terms", "counts", "positions", "starts"])
                    start, size = end, 0
                size += len(text or b"")

    return whole(docs).mapInArrow(
        build, f"block bigint, doc_ids array<{kind}>, terms binary, counts binary, positions binary, starts binary")


class Phrases:
    """Distinct windows of some items, ready to be held against blocks."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        of = defaultdict(set)
        for number, (_, own) in enumerate(items):
            width = min(window, len(own))
            for start in range(len(own) - width + 1 if width else 0):
                of[own[start : start + width].tobytes()].add(number)
        self.names = [name for name, _ in items]
        self.items = [sorted(x) for x in of.values()]
        self.windows = [np.frombuffer(x, np.uint64) for x in of]
        self.terms, place = np.unique(np.concatenate([*self.windows, np.empty(0, np.uint64)]), return_inverse=True)
        ends = np.cumsum([len(w) for w in self.windows]).astype(int)
        self.places = np.split(place, ends[:-1]) if len(ends) else []
        self.flat, self.first = place, np.concatenate([[0], ends])[:-1].astype(int)

    def matches(self, block: Block):
        """(window, places) of each window that occurs in the block."""
        if not self.windows:
            return
        numbers, lengths = block.find(self.terms)
        rarest = np.minimum.reduceat(lengths[self.flat], self.first)
        for window in np.flatnonzero(rarest):
            own = self.places[window]
            places = block.phrase(numbers[own], lengths[own])
            if len(places):
                yield window, places


def item_pieces(items: DataFrame, window: int, piece: int = PIECE) -> DataFrame:
    """name, words, hashes: distinct pieces of the items, which overlap so that each window lies in one."""

    def cut(records):
        memo = word_hashes()
        for batch in batches(records, 100, memo):
            names, sizes, values = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                own = text_hashes(text, memo)
                last = max(1, len(own) - window + 1) if len(own) else 0
                for start in range(0, last, piece):
                    part = own[start : start + piece + window - 1]
                    names.append(name)
                    sizes.append(len(part))
                    values.append(part.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(values, pa.binary())],
                ["name", "words", "hashes"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"),
                         F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInArrow(cut, "name string, words bigint, hashes binary").distinct()


def item_groups(pieces: DataFrame, group_words: int) -> list[DataFrame]:
    """The pieces in groups of about so many words."""
    total = pieces.agg(F.sum("words")).first()[0] or 0
    groups = int(total // group_words) + 1
    dealt = F.pmod(F.xxhash64("name", "hashes"), F.lit(groups))
    return [pieces.where(dealt == group) for group in range(groups)]


def fetched(group: DataFrame, window: int) -> Phrases:
    """One group's windows, on the driver."""
    rows = group.select("name", "hashes").collect()
    return Phrases(sorted(((r[0], np.frombuffer(r[1], "<u8")) for r in rows), key=lambda r: (r[0], r[1].tobytes())), window)


def search(index: DataFrame, phrases: Phrases, every: bool = True) -> DataFrame:
    """block, place, doc_id, n_words, spans and items of every document, or those hit, for one group of phrases."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def ask(records):
        for batch in batches(records, 1):
            row = batch.to_pylist()[0]
            block = Block.read(*(row[c] for c in ("terms", "counts", "positions", "starts")))
            starts, lengths = defaultdict(list), defaultdict(set)
            edge = np.zeros(block.starts[-1] + 1, np.int32)
            for window, places in phrases.matches(block):
                np.add.at(edge, places, 1)
                np.add.at(edge, places + len(phrases.places[window]), -1)
                for document in np.unique(block.document(places)):
                    lengths[document].update(phrases.items[window])
            hit = np.cumsum(edge[:-1]) > 0
            for begin, end in _runs(hit, block.starts):
                starts[block.document(np.array([begin]))[0]].append((begin, end))
            own = range(len(row["doc_ids"])) if every else sorted(starts)
            sizes = np.diff(block.starts)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["block"]] * len(own), pa.int64()), pa.array(own, pa.int64()),
                pa.array([row["doc_ids"][k] for k in own], batch.schema.field("doc_ids").type.value_type),
                pa.array([int(sizes[k]) for k in own], pa.int64()),
                pa.array([[{"start": int(a - block.starts[k]), "stop": int(b - block.starts[k])}
                           for a, b in starts[k]] for k in own],
                         pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array([sorted({phrases.names[i] for i in lengths[k]}) for k in own], pa.list_(pa.string())),
            ], ["block", "place", "doc_id", "n_words", "spans", "items"])

    return index.mapInArrow(
        ask, f"block bigint, place bigint, doc_id {kind}, n_words bigint, "
             "spans array<struct<start:bigint,stop:bigint>>, items array<string>")


def _runs(hit: np.ndarray, starts: np.ndarray):
    """Maximal runs of hit words, cut where documents meet."""
    marks = np.zeros(len(hit) + 1, np.int8)
    marks[:-1] = hit
    borders = np.flatnonzero(np.diff(np.concatenate([[0], marks])))
    for begin, end in zip(borders[::2], borders[1::2]):
        inner = starts[np.searchsorted(starts, begin, "right") : np.searchsorted(starts, end, "left")]
        edges = [begin, *inner.tolist(), end]
        yield from ((a, b) for a, b in zip(edges, edges[1:]) if a < b)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, n_words, spans of hit words, n_hit and items of every document."""
    index = stored(build_index(docs))
    groups = item_groups(stored(item_pieces(items, window)), group_words)
    if len(groups) == 1:
        merged = search(index, fetched(groups[0], window))
    else:
        folder = shared_folder(docs.sparkSession)
        for number, group in enumerate(groups):
            # the first group's answers have all documents
            answer = search(index, fetched(group, window), number == 0)
            answer.write.mode("append").parquet(folder)
        merged = docs.sparkSession.read.schema(answer.schema).parquet(folder).groupBy("block", "place").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans in order; each adds what lies beyond the words already counted
    hit = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["upto"]))).alias("n"),
            F.greatest(s["upto"], x["stop"]).alias("upto")),
        lambda s: s["n"])
    return merged.select("doc_id", "n_words", "spans", hit.alias("n_hit"), "items")


def contaminated():
    """At least one hit word in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def proximity(index: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """doc_id and word place where all terms stand within `slop` words of the rarest of them."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    wanted = np.unique(hashes([w for t in terms for w in words(t.encode())], word_hashes()))

    def ask(records):
        for batch in batches(records, 1):
            row = batch.to_pylist()[0]
            block = Block.read(*(row[c] for c in ("terms", "counts", "positions", "starts")))
            numbers, lengths = block.find(wanted)
            if len(wanted) and lengths.min() > 0:
                places = block.near(numbers, lengths, slop)
                document = block.document(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_ids"][d] for d in document], batch.schema.field("doc_ids").type.value_type),
                     pa.array(places - block.starts[document], pa.int64())], ["doc_id", "place"])

    return index.mapInArrow(ask, f"doc_id {kind}, place bigint")
