"""Removal of repeated passages with sparse suffix arrays sorted deep-shallow.

A 100-byte string that occurs twice has the same *anchor* both times: the least hash among its 64 runs of
37 bytes. Anchors are one byte in some thirty, and two strings can only be equal where their anchors'
runs are. So only suffixes that start at anchors are held against each other, and of these only the ones
whose run occurs again:

1. Each task cuts its texts into anchors. Of anchors whose whole neighbourhood (63 bytes before, 100 from
   the anchor on) repeats inside the task the first goes on and the others are settled: every string
   around them occurs earlier. Anchors go to buckets of hashes as packed arrays.
2. A bucket finds runs that occur more than once. Equal neighbourhoods are settled as above; where
   neighbourhoods differ, one of each kind is asked for.
3. The texts asked for give the neighbourhoods. Their suffixes (to the right, and reversed to the left)
   are sorted deep-shallow: multikey quicksort on eight bytes at a time to a shallow depth, then a blind
   trie per group with a longer common prefix. Common prefix lengths of neighbours in both orders tell for
   each of the 64 strings around an anchor which others are equal to it; all but the first are repeats.
   A run with more kinds of neighbourhoods than a task should hold is dealt out by whole strings instead.
4. The strings found cover bytes; those are removed.

"First" is by doc_id (null before all), then by the row where ids repeat, then by place.

Defined results: a null text is empty; texts under 100 bytes have nothing to remove; repeated rows are
repeats of the first of them; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import batches, mix, stored, utf8, whole, wide

LENGTH, RUN = 100, 37
OFFSETS = LENGTH - RUN + 1  # 64, the bits of a mask
BEFORE = OFFSETS - 1
SEGMENT = 1 << 19
# anchors that a task holds before it sends them on, and kinds of neighbourhoods a task may get of one run
HELD, KINDS = 250_000, 20_000
SHALLOW = 40

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Roller:
    """Hashes of byte runs by prefix sums, for texts up to a segment with its margins."""

    def __init__(self, size: int):
        def powers(base: int) -> np.ndarray:
            with np.errstate(over="ignore"):
                return np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]))

        self.power, self.inverse = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * self.power[: len(data)])])

    def hashes(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[begin]) * self.inverse[begin])


def anchors(data: np.ndarray, roller: Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, run hash and neighbourhood hash of a text's anchors, by segments for long texts."""
    found = []
    for start in range(0, len(data) - LENGTH + 1, SEGMENT):
        low = max(0, start - BEFORE)
        part = data[low : start + SEGMENT + 2 * LENGTH]
        sums = roller.sums(part)
        runs = min(SEGMENT + OFFSETS - 1, len(part) - (start - low) - RUN + 1)
        first = np.arange(start - low, start - low + runs)
        run = mix((sums[first[0] + RUN : first[0] + RUN + runs] - sums[first[0] : first[0] + runs])
                  * roller.inverse[first[0] : first[0] + runs])
        # hash above, place below: the least key is the leftmost of the least hashes
        key = (run & ~np.uint64(0xFFFFF)) | np.arange(runs, dtype=np.uint64)
        span = 1
        while span < OFFSETS:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        at = (key[np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))] & np.uint64(0xFFFFF)).astype(np.int64)
        inside = at + first[0]
        left = np.minimum(inside + low, BEFORE)
        right = np.minimum(len(data) - (inside + low), LENGTH)
        around = roller.hashes(sums, inside - left, inside + right)
        found.append((inside + low, run[at], mix(around + (left * 128 + right).astype(np.uint64))))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    place, run, around = map(np.concatenate, zip(*found))
    place, once = np.unique(place, return_index=True)
    return place, run[once], around[once]


ANCHOR = np.dtype([("run", "<u8"), ("around", "<u8"), ("order", "<i8"), ("row", "<i8"), ("place", "<i4")])


def settle(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts anchors by run, neighbourhood and document; which of them are the first of their neighbourhood."""
    table = table[np.lexsort((table["place"], table["row"], table["order"], table["around"], table["run"]))]
    first = np.ones(len(table), bool)
    first[1:] = (table["run"][1:] != table["run"][:-1]) | (table["around"][1:] != table["around"][:-1])
    return table, first


def _columns(table: np.ndarray) -> bytes:
    """Field after field, which compresses better than record after record."""
    return b"".join(np.ascontiguousarray(table[name]).tobytes() for name in ANCHOR.names)


def _table(data: bytes) -> np.ndarray:
    out = np.empty(len(data) // ANCHOR.itemsize, ANCHOR)
    at = 0
    for name in ANCHOR.names:
        kind = ANCHOR[name]
        out[name] = np.frombuffer(data, kind, len(out), at)
        at += kind.itemsize * len(out)
    return out


def _cut(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, anchors: packed anchors; settled ones under bucket -1."""

    def cut(records):
        roller = Roller(SEGMENT + 4 * LENGTH)
        held, count = [], 0

        def sent():
            table, first = settle(np.concatenate(held))
            open_ = table[first]
            bucket = (open_["run"] >> np.uint64(8)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            full = [k for k in range(buckets) if edge[k] < edge[k + 1]]
            values = [_columns(open_[order[edge[k] : edge[k + 1]]]) for k in full]
            if not first.all():
                full.append(-1)
                values.append(_columns(table[~first]))
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array(values, pa.binary())], ["bucket", "anchors"])

        for batch in batches(records):
            numbers = batch.column(0).to_pylist()
            orders = batch.column(1).to_pylist()
            for row, order, text in zip(numbers, orders, utf8(batch.column(2))):
                place, run, around = anchors(np.frombuffer(text, np.uint8), roller)
                own = np.empty(len(place), ANCHOR)
                for name, value in zip(ANCHOR.names, (run, around, order, row, place)):
                    own[name] = value
                held.append(own)
                count += len(own)
                if count >= HELD:
                    yield sent()
                    held, count = [], 0
        if count:
            yield sent()

    return rows.select("row", "order", "text").mapInArrow(cut, "bucket int, anchors binary")


def _repeated(cut: DataFrame) -> DataFrame:
    """row, order, place, run: settled anchors with run null, and the ones whose neighbourhoods are needed."""

    def find(table: pa.Table) -> pa.Table:
        every = np.concatenate([_table(x) for x in table.column("anchors").to_pylist()])
        if table.column("bucket")[0].as_py() < 0:
            settled, asked, kinds = every, every[:0], np.empty(0, np.int64)
        else:
            every, first = settle(every)
            settled, kept = every[~first], every[first]
            _, number, count = np.unique(kept["run"], return_inverse=True, return_counts=True)
            asked, kinds = kept[count[number] > 1], count[number][count[number] > 1]
        rows = np.concatenate([settled, asked])
        none = np.concatenate([np.ones(len(settled), bool), np.zeros(len(asked), bool)])
        return pa.table({
            "row": rows["row"], "order": rows["order"], "place": rows["place"],
            "run": pa.array(rows["run"].view(np.int64) if len(rows) else np.empty(0, np.int64), pa.int64(), mask=none),
            "kinds": np.concatenate([np.zeros(len(settled), np.int64), kinds])})

    # settled anchors need nothing more, so they are dealt out by what they are
    key = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("anchors"), F.lit(1 << 20)).cast("int")).otherwise(
        F.col("bucket"))
    return cut.withColumn("bucket", key).groupBy("bucket").applyInArrow(
        find, "row bigint, order bigint, place int, run bigint, kinds bigint")


def _neighbourhoods(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """run, order, row, place, before, from: bytes around every anchor asked for."""
    wanted = asked.groupBy("row").agg(F.collect_list(F.struct("place", "run", "kinds")).alias("wanted"))

    def show(records):
        for batch in batches(records, 200):
            out = ([], [], [], [], [], [], [])
            numbers, orders, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for row, order, text, places in zip(numbers, orders, utf8(batch.column(2)), lists):
                for x in places:
                    at = x["place"]
                    for values, value in zip(out, (x["run"], x["kinds"], order, row, at,
                                                   text[max(0, at - BEFORE) : at], text[at : at + LENGTH])):
                        values.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds)],
                ["run", "kinds", "order", "row", "place", "before", "after"])

    return rows.join(wanted, "row").select("row", "order", "text", "wanted").mapInArrow(
        show, "run bigint, kinds bigint, order bigint, row bigint, place int, before binary, after binary")


def blind_trie_order(strings: list[bytes], group: list[int]) -> list[int]:
    """Orders strings by a blind trie: inner nodes keep a place and its bytes only, leaves the strings.

    A string goes down by the bytes at the places alone, is then compared once with the leaf it reached,
    and is hung in where the two first differ.
    """
    root: list | int = group[0]
    same: dict[int, list[int]] = {}
    for number in group[1:]:
        text = strings[number]
        node, path = root, []
        while isinstance(node, list):
            path.append(node)
            at, sons = node
            byte = text[at] if at < len(text) else -1
            node = sons[byte] if byte in sons else next(iter(sons.values()))
        other = strings[node]
        limit = min(len(text), len(other))
        lcp = _common(text, other, limit)
        if lcp == limit and len(text) == len(other):
            same.setdefault(node, []).append(number)
            continue
        mine = text[lcp] if lcp < len(text) else -1
        theirs = other[lcp] if lcp < len(other) else -1
        above, hung = None, root
        for inner in path:
            if inner[0] >= lcp:
                hung = inner
                break
            above = inner
            byte = text[inner[0]] if inner[0] < len(text) else -1
            hung = inner[1].get(byte)
        if isinstance(hung, list) and hung[0] == lcp:
            hung[1][mine] = number
            continue
        fresh = [lcp, {theirs: hung, mine: number}]
        if above is None:
            root = fresh
        else:
            above[1][text[above[0]] if above[0] < len(text) else -1] = fresh
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += [node, *same.get(node, ())]
    return out


def _common(a: bytes, b: bytes, limit: int) -> int:
    """Length of the common prefix, by halving."""
    if a[:limit] == b[:limit]:
        return limit
    low, high = 0, limit
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> np.ndarray:
    """Order of the strings: multikey quicksort by words of eight bytes to `shallow`, then blind tries."""
    n = len(strings)
    order = np.arange(n)
    if n < 2:
        return order
    words = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").astype(np.uint64)
    words = words.reshape(n, shallow // 8)
    groups = [(0, n, 0)]
    deep = []
    while groups:
        begin, end, depth = groups.pop()
        if depth == words.shape[1]:
            deep.append((begin, end))
            continue
        part = order[begin:end]
        part = part[np.argsort(words[part, depth], kind="stable")]
        order[begin:end] = part
        values = words[part, depth]
        edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [end - begin]])
        wide_ones = np.flatnonzero(np.diff(edges) > 1)
        groups += [(begin + int(edges[k]), begin + int(edges[k + 1]), depth + 1) for k in wide_ones]
    for begin, end in deep:
        order[begin:end] = blind_trie_order(strings, order[begin:end].tolist())
    return order


def common_prefixes(strings: list[bytes], order: np.ndarray, size: int) -> np.ndarray:
    """Length of the common prefix of each string in order and the one before it."""
    n = len(strings)
    matrix = np.frombuffer(b"".join(s.ljust(size, b"\0") for s in strings), np.uint8).reshape(n, size)[order]
    lengths = np.fromiter(map(len, strings), np.int64, n)[order]
    out = np.zeros(n, np.int64)
    differ = matrix[1:] != matrix[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def repeats(before: list[bytes], after: list[bytes], earlier: np.ndarray) -> np.ndarray:
    """Mask per anchor: bit o is set when the string from o bytes before it on also occurs earlier.

    `earlier` ranks the anchors by document and place.
    """
    n = len(after)
    reverse = [b[::-1] for b in before]
    right, left = deep_shallow_order(after), deep_shallow_order(reverse)
    right_common = common_prefixes(after, right, LENGTH)
    left_common = common_prefixes(reverse, left, BEFORE)
    sizes = np.fromiter(map(len, after), np.int64, n), np.fromiter(map(len, before), np.int64, n)
    masks = np.zeros(n, np.uint64)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    by_rank = np.argsort(earlier)
    for offset in range(OFFSETS):
        right_class[right] = np.cumsum(right_common < LENGTH - offset)
        left_class[left] = np.cumsum(left_common < offset)
        there = (sizes[0] >= LENGTH - offset) & (sizes[1] >= offset)
        ranked = by_rank[there[by_rank]]
        if len(ranked) < 2:
            continue
        key = right_class[ranked] * (n + 1) + left_class[ranked]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(ranked), bool)
        again[first] = False
        masks[ranked[again]] |= np.uint64(1 << offset)
    return masks


def _compared(around: DataFrame, buckets: int) -> DataFrame:
    """row, place, mask of anchors that differ in their neighbourhoods, sorted in buckets of runs."""

    def compare(table: pa.Table) -> pa.Table:
        order, row, place = (table.column(c).to_numpy() for c in ("order", "row", "place"))
        rank = np.empty(len(row), np.int64)
        rank[np.lexsort((place, row, order))] = np.arange(len(row))
        masks = repeats(table.column("before").to_pylist(), table.column("after").to_pylist(), rank)
        some = masks != 0
        return pa.table({"row": row[some], "place": place[some], "mask": masks[some].view(np.int64)})

    return (around.withColumn("bucket", F.pmod("run", F.lit(buckets))).groupBy("bucket")
            .applyInArrow(compare, "row bigint, place int, mask bigint"))


def _dealt_out(around: DataFrame) -> DataFrame:
    """The same for runs in very many neighbourhoods: every string is a row, equal strings meet by digest."""

    def strings(records):
        for batch in batches(records, 500):
            rows, places, offsets, digests, orders = [], [], [], [], []
            for x in batch.to_pylist():
                text, at = x["before"] + x["after"], len(x["before"])
                for offset in range(OFFSETS):
                    if offset <= at and at - offset + LENGTH <= len(text):
                        rows.append(x["row"])
                        places.append(x["place"])
                        orders.append(x["order"])
                        offsets.append(offset)
                        digests.append(hashlib.blake2b(text[at - offset : at - offset + LENGTH], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(orders, pa.int64()),
                 pa.array(offsets, pa.int32()), pa.array(digests, pa.binary())],
                ["row", "place", "order", "offset", "digest"])

    every = stored(around.mapInArrow(strings, "row bigint, place int, order bigint, offset int, digest binary"))
    first = every.groupBy("digest").agg(
        F.min(F.struct("order", "row", (F.col("place") - F.col("offset")).alias("start"))).alias("first"),
        F.count("*").alias("n")).where("n > 1")
    again = every.join(first, "digest").where(
        F.struct("order", "row", (F.col("place") - F.col("offset")).alias("start")) != F.col("first"))
    return again.groupBy("row", "place").agg(F.expr("bit_or(shiftleft(1L, offset))").alias("mask"))


def covered(size: int, places: np.ndarray, masks: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that the masks name."""
    offsets = np.arange(OFFSETS)
    chosen = (masks[:, None] >> offsets.astype(np.uint64)) & np.uint64(1) == 1
    start = (places[:, None] - offsets)[chosen]
    start = start[(start >= 0) & (start + LENGTH <= size)]
    edge = np.bincount(start, minlength=size + 1) - np.bincount(start + LENGTH, minlength=size + 1)
    hit = np.concatenate([[0], np.cumsum(edge[:size]) > 0, [0]]).astype(np.int8)
    borders = np.flatnonzero(np.diff(hit))
    return list(zip(borders[::2].tolist(), borders[1::2].tolist()))


def repeated_spans(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null as empty), the named other columns and spans: bytes [start, stop) to remove."""
    rows = whole(docs, *extra).withColumn("row", F.monotonically_increasing_id()).withColumn(
        "order", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))))
    buckets = 4 * wide(docs)
    found = stored(_repeated(_cut(rows, buckets)))
    around = stored(_neighbourhoods(rows, found.where("run is not null")))
    masks = (
        found.where("run is null").select("row", "place", F.lit(-1).cast("bigint").alias("mask"))
        .union(_compared(around.where(F.col("kinds") <= KINDS), buckets))
        .union(_dealt_out(around.where(F.col("kinds") > KINDS))))
    by_row = masks.groupBy("row").agg(F.collect_list(F.struct("place", "mask")).alias("marks"))
    marked = rows.drop("order").join(by_row, "row", "left").drop("row")
    names = [f for f in marked.columns if f != "marks"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name != "marks")

    def span(records):
        for batch in batches(records, 200):
            out = []
            for text, marks in zip(utf8(batch.column("text")), batch.column("marks").to_pylist()):
                marks = marks or []
                found = covered(len(text), np.array([m["place"] for m in marks], np.int64),
                                np.array([m["mask"] for m in marks], np.int64).view(np.uint64)) if marks else []
                out.append([{"start": a, "stop": b} for a, b in found])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, kind)], [*names, "spans"])

    return marked.select(*names, "marks").mapInArrow(span, f"{kinds}, spans array<struct<start:bigint,stop:bigint>>")


def kept_bytes(text: bytes, spans: list[dict]) -> bytes:
    at, parts = 0, []
    for s in spans:
        parts.append(text[at : s["start"]])
        at = s["stop"]
    return b"".join([*parts, text[at:]])


def kept_text(text: bytes, spans: list[dict]) -> str:
    """What is left as text: a letter of which a span takes some bytes only stays whole."""
    at, parts = 0, []
    for s in spans:
        start, stop = s["start"], s["stop"]
        while start < stop and start < len(text) and text[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop -= 1
        parts.append(text[at:start])
        at = stop
    return b"".join([*parts, text[at:]]).decode()


def kept_texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text without its repeated bytes, the named other columns, and whether anything was cut."""
    found = repeated_spans(docs, *extra)
    names = [c for c in found.columns if c != "spans"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "spans")

    def keep(records):
        for batch in batches(records, 500):
            spans = batch.column("spans").to_pylist()
            texts = [kept_text(t, x) for t, x in zip(utf8(batch.column("text")), spans)]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(x) for x in spans])], [*names, "cut"])

    return found.mapInArrow(keep, f"{kinds}, cut boolean")


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = repeated_spans(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(records):
        for batch in batches(records, 500):
            texts, spans = utf8(batch.column("text")), batch.column("spans").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()),
                 pa.array([sum(s["stop"] - s["start"] for s in x) for x in spans], pa.int64()),
                 pa.array(map(len, spans), pa.int64()),
                 pa.array([hashlib.sha256(kept_bytes(t, x)).hexdigest() for t, x in zip(texts, spans)], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(
        digest, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
