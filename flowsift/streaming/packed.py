"""Rows as packed Arrow tables: one value that holds many rows with all their types.

Workers that only pack or unpack load nothing but Arrow, which keeps them small.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# rows of a task are dealt out to buckets in groups of so many bytes
PACK_BYTES = 8 << 20


def pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _dealt(batches: list) -> pa.RecordBatch:
    """One packed table per bucket."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    bucket = rows["_bucket"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows.drop_columns(["_bucket"]).take(pa.array(order)), bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    packed = [pack(rows.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(bucket)])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "rows"])


def pack_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACK_BYTES:
            yield _dealt(held)
            held, size = [], 0
    if held:
        yield _dealt(held)
    held = None
    # the worker stays for later tasks
    pa.default_memory_pool().release_unused()


def whole_rows(rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Rows with all columns; those that they lack are null."""
    return pa.RecordBatch.from_arrays([
        rows.column(f.name).cast(f.type) if f.name in rows.schema.names else pa.nulls(len(rows), f.type) for f in schema], schema=schema)


def unpack_rows(schema: pa.Schema):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                for part in unpack(packed.as_py()).to_batches():
                    yield whole_rows(part, schema)

    return rows
