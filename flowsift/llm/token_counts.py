"""Token counts by prefix dynamic programming.

For every prefix of a piece one cell holds the last token of its encoding and the number of tokens:
the last token of a prefix is the one vocabulary entry `t` ending there that may follow the encoding
of what is before it, and its count is one more than that prefix's. Two tokens may follow each other
when encoding both together gives just these two. Pieces, chunks and texts add up, so one pass gives
the exact count of every prefix, and questions on truncation and budgets are look-ups.

Defined results: a null text has no tokens; a null doc_id stays null; repeated rows stay repeated;
white space alone has no tokens; texts of any length are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import Memo, batches, utf8, whole
from flowsift.llm.pretokens import Cutter, byte_letters

CHUNKS = 700_000
PAIRS = 1_000_000
NEVER = 1 << 60
BYTES = {c: b for b, c in enumerate(byte_letters())}


class PrefixCounter:
    """Prefix tables for one tokenizer file."""

    def __init__(self, path: str):
        self.cutter = Cutter(path)
        model = self.cutter.description["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocabulary = model["vocab"]
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for token, number in vocabulary.items():
            if suffix and token.endswith(suffix):
                self.final[token[: -len(suffix)]] = number
            else:
                self.inner[token] = number
        if not suffix:
            self.final = self.inner
        self.merges: dict[tuple[int, int], int] = {}
        self.rank = dict.fromkeys(vocabulary.values(), -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocabulary[left], vocabulary[right]
            self.merges[pair] = self.rank[vocabulary[left + right]] = rank
            self.halves[vocabulary[left + right]] = pair
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.follows = Memo(self._follows, PAIRS)
        self.table = Memo(self._table, CHUNKS)
        self.total_of = Memo(self._total_of, CHUNKS)
        self.count = Memo(self._count, CHUNKS)

    def _follows(self, pair: int) -> bool:
        """Whether both tokens stay themselves next to each other; left is 0xFFFFF for a piece's start.

        Undoes the later of the two last merges step by step, as far as the border between the tokens
        is concerned: a merge over the border that would have come earlier breaks the pair.
        """
        left, right = pair >> 20, pair & 0xFFFFF
        rank, halves, merges = self.rank, self.halves, self.merges
        if left == 0xFFFFF:
            return rank[right] < 0 or merges.get(halves[right]) is not None
        limit = NEVER
        while True:
            if merges.get((left, right), NEVER) < limit:
                return False
            if max(rank[left], rank[right]) < 0:
                return True
            # of two equal merges BPE does the left one first
            if rank[left] > rank[right]:
                limit, left = rank[left], halves[left][1]
            else:
                limit, right = rank[right] + 1, halves[right][0]

    def piece(self, text: str) -> list[int]:
        """Token count of every prefix of a piece, each prefix taken as a piece of its own."""
        inner, final, follows, longest = self.inner, self.final, self.follows, self.longest
        last, counts, out = [0xFFFFF], [0], []
        for end in range(1, len(text) + 1):
            start = max(0, end - longest)
            closed = opened = None
            for begin in range(start, end):
                part = text[begin:end]
                if closed is None and (number := final.get(part)) is not None and follows[last[begin] << 20 | number]:
                    closed = counts[begin] + 1
                if opened is None and (number := inner.get(part)) is not None and follows[last[begin] << 20 | number]:
                    opened = number, counts[begin] + 1
                if closed is not None and opened is not None:
                    break
            last.append(opened[0])
            counts.append(opened[1])
            out.append(closed)
        return out

    def _table(self, chunk: bytes) -> tuple[int, ...]:
        """Counts after every code point of a chunk."""
        text = chunk.decode()
        if self.cutter.plain(text) and "'" not in text:
            before, out = 0, []
            for piece in self.cutter.pieces(text):
                counts = self.piece(piece)
                at = -1
                for letter in piece_letters(piece):
                    at += letter
                    out.append(before + counts[at])
                before += counts[-1]
            return tuple(out)
        # a prefix of such a chunk may be cut or normalised otherwise than the chunk: each on its own
        return tuple(self._whole(text[:end]) for end in range(1, len(text) + 1))

    def _total_of(self, text: str) -> int:
        """Token count of a piece: the cells of its prefixes, closed at its end alone."""
        inner, follows, longest = self.inner, self.follows, self.longest
        if (number := self.final.get(text)) is not None and follows[0xFFFFF << 20 | number]:
            return 1
        last, counts, size = [0xFFFFF], [0], len(text)
        for end in range(1, size):
            for begin in range(max(0, end - longest), end):
                number = inner.get(text[begin:end])
                if number is not None and follows[last[begin] << 20 | number]:
                    last.append(number)
                    counts.append(counts[begin] + 1)
                    break
        for begin in range(max(0, size - longest), size):
            number = self.final.get(text[begin:])
            if number is not None and follows[last[begin] << 20 | number]:
                return counts[begin] + 1
        return 0

    def _whole(self, text: str) -> int:
        return sum(1 if isinstance(p, int) else self.total_of[p] for p in self.cutter.pieces(text) if p != "")

    def _count(self, chunk: bytes) -> int:
        return self._whole(chunk.decode())

    def total(self, data: bytes) -> int:
        return sum(map(self.count.__getitem__, data.split()))

    def prefix_table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


@lru_cache(maxsize=1)
def counter_of(path: str) -> PrefixCounter:
    """A worker's counter; it serves the worker's later tasks too, its tables bounded as ever."""
    return PrefixCounter(path)


def piece_letters(piece: str) -> list[int]:
    """How many byte letters each code point of a piece takes."""
    if piece.isascii():
        return [1] * len(piece)
    return [len(c.encode()) for c in bytes(BYTES[c] for c in piece).decode()]


class PrefixTable:
    """Counts of all prefixes of one text: chunk totals added up, and a table per chunk."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        spans = [m.span() for m in re.finditer(r"[^\t\n\x0b\x0c\r ]+", text)]
        self.starts = [a for a, _ in spans]
        self.chunks = [text[a:b].encode() for a, b in spans]
        self.before = [0, *accumulate(counter.count[c] for c in self.chunks)]

    def at(self, end: int) -> int:
        """Tokens of text[:end]."""
        k = bisect_right(self.starts, end - 1) - 1
        if k < 0:
            return 0
        table = self.counter.table[self.chunks[k]]
        inside = min(end - self.starts[k], len(table))
        return self.before[k] + table[inside - 1]

    def longest_prefix(self, budget: int) -> int:
        """Code points of the longest prefix that has at most `budget` tokens and no longer prefix within it.

        Whole chunks are found by bisection; inside the last chunk every prefix is looked up.
        """
        k = bisect_right(self.before, budget) - 1
        if k >= len(self.chunks):
            return len(self.text)
        table = self.counter.table[self.chunks[k]]
        fits = [i + 1 for i, n in enumerate(table) if self.before[k] + n <= budget]
        return self.starts[k] + fits[-1] if fits else self.starts[k]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text."""

    def count(records):
        counter = counter_of(path)
        for batch in batches(records):
            texts = utf8(batch.column(1))
            tokens = [counter.total(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = whole(docs).mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def truncation_points(docs: DataFrame, path: str, budgets: list[int]) -> DataFrame:
    """doc_id, budget, n_chars: how much of each text fits into each budget, answered from one table per text."""

    def cut(records):
        counter = counter_of(path)
        for batch in batches(records):
            ids, limits, chars = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                table = counter.prefix_table(text.decode())
                for budget in budgets:
                    ids.append(doc)
                    limits.append(budget)
                    chars.append(table.longest_prefix(budget))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(limits, pa.int64()), pa.array(chars, pa.int64())],
                ["doc_id", "budget", "n_chars"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole(docs).mapInArrow(cut, f"doc_id {kind}, budget bigint, n_chars bigint")
