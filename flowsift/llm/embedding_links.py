"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, exact cosines.

A hash function turns a unit vector by three rounds of random signs and fast Hadamard transforms and takes
the axis, with its sign, that the result is nearest to. A table joins several functions; their number grows
with the logarithm of the vectors, so a bucket holds about `LOAD` vectors whatever there are. A vector goes
into the bucket of its nearest axes and into those of the `PROBES` next best choices, and all vectors of a
bucket are compared. How many tables are needed is measured: pairs drawn at exactly the least cosine meet in
a table with some probability, and tables are added until they meet nowhere with a probability below
`MISS` (4 tables of 4 buckets for 64 numbers and some ten thousand vectors).

Equal vectors are one vector with a count. Buckets of up to `BLOCK` vectors are compared whole, many buckets
in a task. Larger ones are cut into blocks, and pairs of blocks are tasks. Only counts per vector and a
spanning forest of a task's links leave it, never pairs. A pair that meets in several buckets counts in
the one with the least key: both vectors' keys follow from the vectors, so that is decided on the spot.

Groups of very many near copies need no comparisons: a large bucket has a centre (the mean of about `DRAWN` of
its vectors; centres that share a vector go together), and two vectors whose angles to one centre are at most
half the angle of the least cosine link by the triangle inequality. Each vector belongs to one centre at
most; such pairs count by the group's size, and blocks of one group don't meet. A large group
that is no such ball is compared in blocks: its square in CPU time, and each vector once per block.

Defined results: null vectors, those without numbers, of zeros only or with a null, NaN or infinite number
link with nothing; vectors of different lengths don't link; equal vectors in rows of their own do; rows without an id have
components like others, whose id is the least one there is, and null if there is none; a row is kept if its
id equals that (null with null); other columns are ignored; an empty table has no rows. Pairs at the least
cosine are missed with a probability below `MISS`, nearer ones more rarely.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import acos, ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.llm.common import batches, mix, stored
from flowsift.llm.graph import components

LEAST = 0.95
LOAD = 64
PROBES = 3
MISS = 1e-4
BLOCK = 1_024
DRAWN = 64
# entries of one task of small buckets, about
CELL = 8_192
# angles closer to a limit than this are left to the comparison
MARGIN = 1e-7


def _transform(x: np.ndarray) -> np.ndarray:
    """Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Hashing:
    """Bucket keys of unit vectors; small enough to go to every task, and the same in all of them."""

    def __init__(self, dimension: int, functions: int, tables: int, seed: int = 5):
        self.dimension, self.functions, self.tables = dimension, functions, tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, functions, 3, dimension))
        # at most two functions deviate from their nearest axis
        steps = range(min(3, 2 * dimension))
        self.choices = np.array([c for c in product(steps, repeat=functions) if sum(x > 0 for x in c) <= 2])

    def _axes(self, x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best three axes of each vector with their signs, and what the later ones lack."""
        for turn in signs:
            x = _transform(x * turn)
        x = np.concatenate([x, -x], axis=1)
        best = np.argsort(-x, axis=1, kind="stable")[:, :3]
        height = np.take_along_axis(x, best, axis=1)
        return best, (height[:, :1] - height) ** 2

    def keys(self, unit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Distinct keys per row, PROBES + 1 for each table (fewer choices: repeated ones)."""
        out = np.empty((len(unit), self.tables, min(PROBES + 1, len(self.choices))), np.uint64)
        for t in range(self.tables):
            found = [self._axes(unit, self.signs[t, f]) for f in range(self.functions)]
            lack = sum(lost[:, self.choices[:, f]] for f, (_, lost) in enumerate(found))
            chosen = np.argsort(lack, axis=1, kind="stable")[:, : out.shape[2]]
            code = np.full(chosen.shape, t, np.uint64) + (lengths.astype(np.uint64) * np.uint64(4_096))[:, None]
            for f, (axis, _) in enumerate(found):
                code = mix(code * np.uint64(2 * self.dimension + 1)
                           + np.take_along_axis(axis, self.choices[chosen, f], axis=1).astype(np.uint64))
            out[:, t] = code
        return out.reshape(len(unit), -1).view(np.int64)


def hashing(dimension: int, vectors: int, least: float, miss: float = MISS) -> Hashing:
    """Functions by the number of vectors; tables until pairs at the least cosine meet nowhere too rarely."""
    functions = max(1, ceil(log(max(vectors, 1) / LOAD) / log(2 * dimension))) if vectors > LOAD else 1
    draw = np.random.default_rng(3)
    a, b = draw.normal(size=(2, 2_000, dimension))
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    if dimension > 1:
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        b = least * a + np.sqrt(1 - least * least) * b
    else:
        b = a
    trial = Hashing(dimension, functions, 8, seed=7)
    size = np.full(len(a), dimension)
    x, y = (trial.keys(v, size).reshape(len(a), 8, -1) for v in (a, b))
    apart = 1 - (x[..., :, None] == y[..., None, :]).any((2, 3)).mean()
    # a few more meetings fewer than were seen
    apart = min(0.999, apart + 0.01)
    return Hashing(dimension, functions, max(1, ceil(log(miss) / log(apart))))


def _unit(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of unit length, filled up with zeros, and their own lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), dimension))
    out[np.arange(dimension) < sizes[:, None]] = flat
    # numbers near the ends of the range would overflow or vanish as squares
    out /= np.abs(out).max(axis=1, keepdims=True, initial=0)
    return out / np.linalg.norm(out, axis=1, keepdims=True), sizes


def _entries(vectors: DataFrame, tables: Hashing) -> DataFrame:
    """node, keys of all vectors."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def hashed(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(records):
            keys = tables.keys(*_unit(batch.column("v"), tables.dimension))
            offsets = pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["node", "keys"])

    return vectors.select("node", "v").mapInArrow(hashed, schema)


def _centred(large: DataFrame, vectors: DataFrame, dimension: int, least: float) -> DataFrame:
    """node, ball of vectors within half the angle of a ball's centre; balls are named by one of their buckets.

    large: bucket, n, node of all entries of large buckets.
    """
    kind = vectors.schema["v"].dataType
    drawn = large.where(F.pmod(F.xxhash64("bucket", "node"), F.col("n")) < DRAWN).join(vectors, "node")
    centre = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("centre", T.ArrayType(T.DoubleType()))])

    def mean(group: pa.Table) -> pa.Table:
        unit, _ = _unit(group["v"], dimension)
        total = unit.sum(axis=0)
        size = np.linalg.norm(total)
        return pa.table({"bucket": group["bucket"][:1],
                         "centre": pa.array([(total / size if size > 1e-9 else total).tolist()])})

    # about DRAWN vectors in each group
    centres = stored(drawn.select("bucket", "v").groupBy("bucket").applyInArrow(mean, centre))
    limit = acos(least) / 2 - MARGIN
    held = T.StructType([T.StructField("node", T.LongType()), T.StructField("bucket", T.LongType())])

    def close(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(records):
            unit, _ = _unit(batch.column("v"), dimension)
            middle = np.array(batch.column("centre").to_pylist()).reshape(len(unit), dimension)
            inside = pa.array(np.einsum("ij,ij->i", unit, middle) >= np.cos(limit))
            yield batch.select(["node", "bucket"]).filter(inside)

    def within(pairs: DataFrame) -> DataFrame:
        """Those (node, bucket) where the vector is that near to the bucket's centre."""
        of = pairs.join(vectors.select("node", "v"), "node").join(centres, "bucket")
        return stored(of.select("node", "bucket", F.col("v").cast(kind).alias("v"), "centre").mapInArrow(close, held))

    inside = within(large.select("node", "bucket"))
    first = stored(inside.groupBy("node").agg(F.min("bucket").alias("first")))
    shared = inside.join(first, "node").where("bucket != first").select(F.col("first").alias("a"), F.col("bucket").alias("b"))
    together = components(shared.distinct()).select(F.col("node").alias("first"), "label")
    chosen = first.join(together, "first", "left").select("node", F.coalesce("label", "first").alias("bucket"))
    return within(chosen).select("node", F.col("bucket").alias("ball"))


def _tasks(entries: DataFrame, sizes: DataFrame, balls: DataFrame | None, count: int) -> DataFrame:
    """task, part, side, node, ball: what is compared where.

    Rows of one part are compared with each other (side 2), or those of side 0 with those of side 1.
    """
    cells = max(1, -(-count // CELL))
    met = entries.join(sizes, "bucket")
    task = F.pmod(F.xxhash64("bucket"), F.lit(cells))
    small = met.where(F.col("n") <= BLOCK).select(task.alias("task"), F.col("bucket").alias("part"), F.lit(2).alias("side"), "node")
    if balls is None:
        return small.withColumn("ball", F.lit(None).cast("bigint"))
    large = met.where(F.col("n") > BLOCK).join(balls, "node", "left")
    of_ball = stored(large.where("ball is not null").groupBy("bucket", "ball").agg(F.count("*").alias("held")))
    # few of a ball in a bucket are compared like others, but for pairs of their own
    own = of_ball.where(F.col("held") >= BLOCK // 4).select("bucket", F.col("ball").alias("group"), "held")
    rest = sizes.where(F.col("n") > BLOCK).join(
        own.groupBy("bucket").agg(F.sum("held").alias("gone")), "bucket", "left").select(
        "bucket", F.lit(None).cast("bigint").alias("group"),
        (F.col("n") - F.coalesce("gone", F.lit(0))).alias("held"))
    groups = stored(own.union(rest).where("held > 0").select(
        "bucket", "group", F.ceil(F.col("held") / BLOCK).cast("bigint").alias("blocks")))
    other = groups.select("bucket", F.col("group").alias("group2"), F.col("blocks").alias("blocks2"))
    # blocks of one ball are never compared
    pairs = stored(groups.join(other, "bucket").where("group is null or group2 is null or group != group2"))
    in_group = large.join(own.select("bucket", F.col("group").alias("ball"), F.lit(True).alias("big")),
                          ["bucket", "ball"], "left").select(
        "bucket", "node", "ball", F.when(F.col("big"), F.col("ball")).alias("group"))
    met_blocks = in_group.join(pairs, (in_group.bucket == pairs.bucket) & in_group.group.eqNullSafe(pairs.group)).select(
        in_group.bucket, "node", "ball", in_group.group, "group2",
        F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks2") - 1)).alias("block2"))
    mine, theirs = F.struct("group", "block"), F.struct(F.col("group2").alias("group"), F.col("block2").alias("block"))
    side = F.when(mine == theirs, 2).when(mine < theirs, 0).otherwise(1)
    part = F.xxhash64("bucket", F.least(mine, theirs), F.greatest(mine, theirs))
    tiles = met_blocks.select("bucket", "node", "ball", side.alias("side"), part.alias("part"))
    return small.join(balls, "node", "left").select("task", "part", "side", "node", "ball").withColumn("bucket", F.col("part")).union(
        tiles.select(F.col("part").alias("task"), "part", "side", "node", "ball", "bucket")).select(
        "task", "bucket", "part", "side", "node", "ball")


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The least index each of `size` indices is connected with by pairs (a, b)."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _near(unit: np.ndarray, side: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one part with at least that cosine."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    alone = bool((side == 2).any())
    step = 256
    for start in range(0, len(left), step):
        rows = left[start : start + step]
        i, j = np.nonzero(unit[rows] @ unit[right].T >= least)
        i, j = rows[i], right[j]
        if alone:
            i, j = i[i < j], j[i < j]
        yield i, j


# parts of up to these many vectors are compared as stacks of equal blocks
STACKED = (4, 16, 64)


def _near_stacked(unit: np.ndarray, start: np.ndarray, size: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of many small parts (start and size, all pairs wanted) at once, padded to one width."""
    for below, width in zip((1, *STACKED), STACKED):
        chosen = np.flatnonzero((size > below) & (size <= width))
        place = np.arange(width)
        later = place[:, None] < place
        step = max(1, (1 << 15) // width)
        for at in range(0, len(chosen), step):
            parts = chosen[at : at + step]
            there = place < size[parts, None]
            rows = np.where(there, start[parts, None] + place, start[parts, None])
            block = unit[rows]
            near = block @ block.transpose(0, 2, 1) >= least
            part, i, j = np.nonzero(near & later & there[:, None, :])
            yield rows[part, i], rows[part, j]


def _linked(tasks: DataFrame, tables: Hashing, least: float) -> DataFrame:
    """node, links (copies of the vectors it links with, in this task), root (a vector it is connected with)."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "links", "root")])

    def compared(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        node, part, bucket, side, copies = (group[c].to_numpy() for c in ("node", "part", "bucket", "side", "copies"))
        ball = group["ball"].fill_null(0).to_numpy()
        in_ball = ~np.asarray(group["ball"].is_null())
        unit, lengths = _unit(group["v"], tables.dimension)
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        keys: dict[int, np.ndarray] = {}

        def keys_of(rows: np.ndarray) -> np.ndarray:
            new = np.array([r for r in np.unique(rows).tolist() if r not in keys], np.int64)
            for begin in range(0, len(new), 1_024):
                some = new[begin : begin + 1_024]
                keys.update(zip(some.tolist(), tables.keys(unit[some], lengths[some])))
            return np.array([keys[r] for r in rows.tolist()])

        first, second, links = [], [], np.zeros(len(node), np.int64)
        begins, sizes = edges[:-1], np.diff(edges)
        stacked = (sizes <= STACKED[-1]) & (np.minimum.reduceat(side, begins) == 2)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from _near_stacked(unit, begins[stacked], sizes[stacked], least)
            for begin, size in zip(begins[~stacked], sizes[~stacked]):
                for i, j in _near(unit[begin : begin + size], side[begin : begin + size], least):
                    yield i + begin, j + begin

        for i, j in pairs():
            known = in_ball[i] & in_ball[j] & (ball[i] == ball[j])
            i, j = i[~known], j[~known]
            for at in range(0, len(i), 4_096):
                a, b = i[at : at + 4_096], j[at : at + 4_096]
                x, y = keys_of(a), keys_of(b)
                same = (x[:, :, None] == y[:, None, :]).any(2)
                lowest = np.where(same, x, np.iinfo(np.int64).max).min(1)
                here = lowest == bucket[a]
                a, b = a[here], b[here]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                # a spanning forest of these is enough
                ends, both = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = _forest(both[: len(a)], both[len(a) :], len(ends))
                first.append(ends)
                second.append(ends[root])
        if not first:
            return pa.table({n: pa.array([], pa.int64()) for n in ("node", "links", "root")})
        first, second = np.concatenate(first), np.concatenate(second)
        root = _forest(first, second, len(node))
        touched = np.unique(first)
        return pa.table({"node": node[touched], "links": links[touched], "root": node[root[touched]]})

    return tasks.groupBy("task").applyInArrow(compared, schema)


def vector_links(table: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    rows = stored(table.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").alias("v")))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = rows.where(F.forall("v", number) & F.exists("v", lambda x: x != 0))
    vectors = stored(usable.groupBy("v").agg(F.min("row").alias("node"), F.count("*").alias("copies")))
    count, longest = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    members = stored(usable.select("row", "v").join(vectors.select("v", "node"), "v").select("row", "node"))
    dimension = 1 << max(0, (longest or 1) - 1).bit_length()
    tables = hashing(dimension, count, least)
    entries = stored(_entries(vectors, tables).select("node", F.explode(F.array_distinct("keys")).alias("bucket")))
    sizes = stored(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    hot = sizes.where(F.col("n") > BLOCK)
    balls = None
    if not hot.isEmpty():
        balls = stored(_centred(stored(entries.join(hot, "bucket")), vectors, dimension, least))
    tasks = _tasks(entries, sizes, balls, entries.count())
    if balls is None:
        tasks = tasks.withColumn("bucket", F.col("part"))
    found = stored(_linked(tasks.join(vectors, "node"), tables, least))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    weighed = vectors.select("node", "copies").join(links, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    if balls is not None:
        counted = balls.join(vectors.select("node", "copies"), "node")
        total = stored(counted.groupBy("ball").agg(F.sum("copies").alias("in_ball"), F.min("node").alias("hub")))
        placed = stored(balls.join(total, "ball"))
        edges = edges.union(placed.select("node", "hub"))
        weighed = weighed.join(placed.select("node", "in_ball"), "node", "left").withColumn(
            "links", F.col("links") + F.coalesce(F.col("in_ball") - F.col("copies"), F.lit(0)))
    label = components(edges)
    classes = stored(weighed.join(label, "node", "left").select(
        "node", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "node").alias("label")))
    labelled = stored(rows.select("row", "vec_id").join(members.join(classes, "node"), "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("label", "row").alias("label")))
    least_id = stored(labelled.groupBy("label").agg(F.min("vec_id").alias("component_id")))
    return labelled.join(least_id, "label").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
