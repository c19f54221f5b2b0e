"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

A sequence is filled greedily with the longest piece that still fits. Then its shortest piece is taken
out again if two unpacked pieces fill the gap it leaves more tightly. Pieces are packed in blocks, each
a task of its own; a block holds so many pieces that its one unfilled sequence is no loss worth naming,
and so few that it fits into memory. Only lengths take part: ids never leave the task that made them.

Defined results: a null or empty text is one piece of the closing id; a null doc_id stays null, repeated
rows are packed once each; only documents longer than a sequence are cut; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import Memo, batches, stored, whole
from flowsift.llm.pretokens import Cutter

PIECES = 500_000
CHUNKS = 100_000
# bytes of texts whose chunks are told apart together
GROUP = 16_000_000
# stands between chunks where ids do: no id is so large
BETWEEN = b"\xff\xff\xff\xff"
# pieces of one block, on average
BLOCK = 50_000


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids; a new chunk has few, for which an array would cost more than the ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkIds:
    """Ids of texts as bytes: each distinct chunk of some texts is cut once, and a piece seen before is not encoded again.

    The bounds limit memory only: ids are the same whenever they are computed.
    """

    def __init__(self, path: str, bound: int = PIECES):
        self.cutter, self.bound = Cutter(path), bound
        self.pieces = {"\n": BETWEEN}
        # chunks that the library has to cut
        self.others = Memo(lambda chunk: id_bytes(self.cutter.ids(chunk)), CHUNKS)

    def clear(self) -> None:
        self.pieces = {"\n": BETWEEN}
        self.others.clear()

    def of(self, chunks: pa.Array) -> list[bytes]:
        """Ids of each chunk."""
        if not len(chunks):
            return []
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), "\n")[0].as_py()
        cut = self.cutter.lines(joined)
        if cut is None:
            texts = chunks.to_pylist()
            plain = [self.cutter.plain(chunk) for chunk in texts]
            known = iter(self.of(chunks.filter(pa.array(plain))))
            return [next(known) if fine else self.others[chunk] for chunk, fine in zip(texts, plain)]
        new = set(cut) - self.pieces.keys()
        if len(self.pieces) + len(new) > self.bound:
            self.pieces = {"\n": BETWEEN}
            new = set(cut) - self.pieces.keys()
        encode = self.cutter.line_ids
        for piece in new:
            self.pieces[piece] = id_bytes(encode(piece))
        return b"".join(map(self.pieces.__getitem__, cut)).split(BETWEEN)

    def texts(self, column: pa.Array) -> Iterator[memoryview]:
        """Ids of each text."""
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        distinct = []
        for start in range(0, len(coded.dictionary), CHUNKS):
            distinct += self.of(coded.dictionary.slice(start, CHUNKS))
        ids = pa.array(distinct, pa.large_binary()).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False))])
        at = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return (data[start:end] for start, end in zip(at, at[1:]))


def grouped(records: Iterator[pa.RecordBatch], size: int = GROUP) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose texts have at most so many bytes besides their longest text."""
    held, total = [], 0
    for batch in records:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        borders = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
        for start, end in zip(borders, borders[1:]):
            part = batch.slice(start, end - start)
            own = part.column(1).nbytes
            if held and total + own > size:
                yield pa.concat_batches(held)
                held, total = [], 0
            held.append(part)
            total += own
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row's whole text."""

    def cut(records):
        ids = ChunkIds(path)
        closing = id_bytes([end_id])
        for batch in batches(grouped(records), GROUP, ids):
            rows = ([], [], [], [], [])
            for doc, own in zip(batch.column(0).to_pylist(), ids.texts(pc.fill_null(batch.column(1), ""))):
                data = b"".join([own, closing])
                for piece, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    for values, value in zip(rows, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()),
                 *(pa.array(values, pa.int64()) for values in rows[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole(docs).mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place of each piece; every piece is at most `size` long."""
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=size + 1)
    # pieces of one length are handed out in order
    following = np.zeros(size + 2, np.int64)
    following[:-1] = len(lengths) - np.cumsum(left)
    # fits[g]: greatest length of which pieces are left, at most g; kept up as lengths run out
    fits = np.maximum.accumulate(np.where(left > 0, np.arange(size + 1), 0))
    sequence = np.empty(len(lengths), np.int64)
    place = np.empty(len(lengths), np.int64)

    def take(length: int) -> int:
        left[length] -= 1
        if not left[length]:
            below = fits[length - 1]
            stop = length + int(np.searchsorted(fits[length:], length, "right"))
            fits[length:stop] = below
        following[length] += 1
        return order[following[length] - 1]

    def put_back(length: int) -> None:
        if not left[length]:
            stop = length + int(np.searchsorted(fits[length:], length, "left"))
            fits[length:stop] = length
        left[length] += 1
        following[length] -= 1

    count = 0
    while fits[size]:
        chosen: list[tuple[int, int]] = []
        gap = size
        while fits[gap]:
            length = int(fits[gap])
            chosen.append((length, take(length)))
            gap -= length
        if gap and chosen[-1][0] + gap > 1 and fits[size]:
            shortest, piece = chosen[-1]
            room = gap + shortest
            first = np.flatnonzero(left[1 : room // 2 + 1]) + 1
            if len(first):
                second = fits[room - first]
                total = first + second
                total[(second == first) & (left[first] < 2)] = 0
                total[second == 0] = 0
                best = int(np.argmax(total))
                if total[best] > shortest:
                    one, two = int(first[best]), int(second[best])
                    chosen.pop()
                    put_back(shortest)
                    chosen += [(two, take(two)), (one, take(one))]
        at = 0
        for length, piece in chosen:
            sequence[piece], place[piece] = count, at
            at += length
        count += 1
    return sequence, place


def packed(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, block: int = BLOCK) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    cut = stored(pieces(docs, path, size, end_id))
    blocks = max(1, round(cut.count() / block))
    # stored pieces are numbered by file and place, so rows equal in all columns go to different blocks too
    dealt = cut.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        # the result shouldn't depend on the order in which rows arrive
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, place = best_two_fit(table.column("length").to_numpy().astype(np.int64), size)
        table = table.drop_columns(["block"])
        table = table.append_column("sequence_id", pa.array(sequence * blocks + number, pa.int64()))
        return table.append_column("offset", pa.array(place, pa.int64()))

    return (
        dealt.groupBy("block")
        .applyInArrow(pack, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                            "sequence_id bigint, offset bigint")
    )
