"""Boosted trees of all classes at once: softmax loss, histograms of gradients and Hessians.

Features are cut into bins once, and a row is kept as one byte per feature. A round grows one tree per class,
level by level. In a pass each task sums gradients, Hessians and rows per class, open node, feature and bin;
those sums are added up by a grouping with map-side combine, running sums over the bins give every split's
gain, and one row per class and open node comes to the driver. Everything summed is a whole number
(fixed point), so the trees depend neither on the partitions nor on a repeated task.

What a task holds is bounded by classes * 2 ** (maxDepth - 1) * features * bins, whatever the table's size.
Margins are written every KEPT rounds; in between tasks apply the few trees grown since.

Defined results: rows whose label is no class, or whose weight is no positive number, are left out; a null
or NaN feature ends the job; a table without rows gives no trees, so every class is equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsift.functions.scalar import class_index
from flowsift.operators.steps import stored

PARAMS = {"rounds": 30, "maxDepth": 4, "rate": 0.3, "bins": 64, "penalty": 1.0, "minInstancesPerNode": 1}
# search space of the random trials
SPACE = {"rounds": [10, 20, 40], "maxDepth": [3, 4, 6], "rate": [0.1, 0.3], "minInstancesPerNode": [1, 2, 5]}
# rounds between two writings of the margins
KEPT = 10
# one, in the fixed point of the sums
ONE = float(1 << 24)

NODES = "round int, class int, node int, feature int, threshold double, value double, cover bigint"
_SUMS = "class int, node int, feature int, bin int, g bigint, h bigint, n bigint"
_LOSS = -1  # the class of the row that carries the loss


@dataclass
class Round:
    """One tree per class; children of node i are 2 i and 2 i + 1, the root is 1."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(classes: int, depth: int) -> Round:
        shape = (classes, 2 << depth)
        return Round(np.full(shape, -1), np.zeros(shape, int), np.zeros(shape), np.zeros(shape, int))

    def nodes(self, bins: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """The node that each row of bins reaches in `levels` steps at most."""
        at, rows = np.ones(len(bins), int), np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[tree, at]
            above = bins[rows, np.maximum(feature, 0)] > self.bin[tree, at]
            at = np.where(feature >= 0, 2 * at + above, at)
        return at

    def add_to(self, margins: np.ndarray, bins: np.ndarray, depth: int) -> None:
        for tree in range(len(self.feature)):
            margins[:, tree] += self.value[tree, self.nodes(bins, tree, depth)]


@dataclass
class SoftmaxTrees:
    """Rows of NODES, a bounded number; `losses` holds the mean log loss before each round."""

    nodes: list[tuple]
    class_count: int
    losses: list[float] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, class_count: int) -> SoftmaxTrees:
        return SoftmaxTrees([tuple(r) for r in spark.read.schema(NODES).parquet(path).collect()], class_count)


def softmax(margins: np.ndarray) -> np.ndarray:
    odds = np.exp(margins - margins.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """At most bins - 1 ascending cuts per feature, from one pass of quantile sketches."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares).alias(c) for c in features]).first()
    return [np.unique(np.array(cuts or [], dtype=float)) for cuts in found]


def _value(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value), value).otherwise(
        F.raise_error(F.lit(f"invalid training value: {name}")).cast("double"))


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def _binned(cuts: list[np.ndarray], classes: int):
    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(classes).tobytes()
        for batch in batches:
            bins = np.empty((batch.num_rows, len(cuts)), np.uint8)
            for i, cut in enumerate(cuts):
                # cuts below the value: it lies in the bins up to b just if it is not above cut b
                bins[:, i] = np.searchsorted(cut, batch.column(2 + i).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([row.tobytes() for row in bins], pa.binary()),
                 pa.array([none] * batch.num_rows, pa.binary())], names=["y", "w", "bins", "margins"])

    return to_bins


def _margins(batch: pa.RecordBatch, recent: list[Round], features: int, classes: int, depth: int):
    bins = _matrix(batch.column(2), np.uint8, features)
    margins = _matrix(batch.column(3), np.float64, classes).copy()
    for each in recent:
        each.add_to(margins, bins, depth)
    return bins, margins


def _rewritten(recent: list[Round], features: int, classes: int, depth: int):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, margins = _margins(batch, recent, features, classes, depth)
            kept = pa.array([row.tobytes() for row in margins], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], kept], names=["y", "w", "bins", "margins"])

    return rewrite


def _histograms(recent: list[Round], growing: Round, level: int, features: int, classes: int, depth: int, bins: int):
    """Sums of a task's rows: one row per class, open node, feature and bin that has any."""
    first, size = 1 << level, (1 << level) * features * bins

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, 3, size), np.int64)
        loss = weights = count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, margins = _margins(batch, recent, features, classes, depth)
            y, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            p = softmax(margins)
            loss += int(np.rint(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)) * w * ONE).sum())
            weights, count = weights + int(np.rint(w * ONE).sum()), count + len(y)
            for k in range(classes):
                node = growing.nodes(x, k, level)
                rows = np.flatnonzero(node >= first)
                if not len(rows):
                    continue
                place = (((node[rows] - first)[:, None] * features + np.arange(features)) * bins + x[rows]).ravel()
                # twice the diagonal bounds the softmax Hessian from above
                for i, value in enumerate((p[rows, k] - (y[rows] == k), 2 * p[rows, k] * (1 - p[rows, k]))):
                    fixed = np.repeat(np.rint(value * w[rows] * ONE), features)
                    total[k, i] += np.bincount(place, fixed, size).astype(np.int64)
                total[k, 2] += np.bincount(place, minlength=size)
        if count:
            yield _sums_batch(np.array([_LOSS]), np.zeros((3, 1), int), np.array([[loss], [weights], [count]]))
        for k in range(classes):
            met = np.flatnonzero(total[k, 2])
            where = np.array([met // (features * bins) + first, met // bins % features, met % bins])
            yield _sums_batch(np.full(len(met), k), where, total[k][:, met])

    return sums


def _sums_batch(kind: np.ndarray, where: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(c, pa.int32()) for c in (kind, *where)] + [pa.array(c, pa.int64()) for c in values]
    return pa.RecordBatch.from_arrays(arrays, names=["class", "node", "feature", "bin", "g", "h", "n"])


def best_splits(sums: DataFrame, penalty: float, least: int) -> DataFrame:
    """class, node, g, h, n and the split (feature, bin, sums below) of the highest gain above 0, or null.

    Ties go to the smallest feature, then the smallest bin.
    """
    total = sums.groupBy("class", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    place = Window.partitionBy("class", "node", "feature")
    running = place.orderBy("bin")

    def worth(g, h):
        g, h = (c.cast("double") / F.lit(ONE) for c in (g, h))
        return g * g / (h + F.lit(float(penalty)))

    below = total.select("class", "node", "feature", "bin", *[F.sum(c).over(running).alias(f"{c}_below") for c in ("g", "h", "n")],
                         *[F.sum(c).over(place).alias(c) for c in ("g", "h", "n")])
    n_above = F.col("n") - F.col("n_below")
    gain = (worth(F.col("g_below"), F.col("h_below")) + worth(F.col("g") - F.col("g_below"), F.col("h") - F.col("h_below"))
            - worth(F.col("g"), F.col("h")))
    split = F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"),
                     "g_below", "h_below", "n_below")
    allowed = (F.col("n_below") >= least) & (n_above >= least) & (n_above > 0) & (gain > 1e-9)
    # every feature has the same totals
    return below.groupBy("class", "node").agg(
        *[F.max(c).alias(c) for c in ("g", "h", "n")], F.max(F.when(allowed, split)).alias("split"))


def train(rows: DataFrame, features: list[str], classes: list[str], params: dict | None = None,
          label: str = "label", weight: str | None = "weight") -> SoftmaxTrees:
    """Fits on (features..., label[, weight])."""
    params = {**PARAMS, **(params or {})}
    depth, width, many = params["maxDepth"], len(features), len(classes)
    weighted = rows.select(class_index(label, classes).cast("int").alias("y"),
                           (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                           *[_value(c).alias(f"x{i}") for i, c in enumerate(features)])
    known = weighted.filter("y >= 0 AND w > 0 AND NOT isnan(w)")
    cuts = cut_points(known, [f"x{i}" for i in range(width)], params["bins"])
    state = stored(known.mapInArrow(_binned(cuts, many), "y int, w double, bins binary, margins binary"), "boosting")
    grown, recent, losses = [], [], []
    for turn in range(params["rounds"]):
        tree = Round.empty(many, depth)

        def settle(k: int, node: int, g: int, h: int, n: int) -> None:
            tree.value[k, node] = -params["rate"] * (g / ONE) / (h / ONE + params["penalty"])
            tree.cover[k, node] = n

        for level in range(depth):
            sums = state.mapInArrow(
                _histograms(recent, tree, level, width, many, depth, params["bins"]), _SUMS)
            # a row per class and open node, and the loss
            found = best_splits(sums, params["penalty"], params["minInstancesPerNode"]).collect()
            going = False
            for r in found:
                if r["class"] == _LOSS:
                    if level == 0:
                        losses.append(r["g"] / r["h"])
                    continue
                k, node, split = r["class"], r["node"], r["split"]
                settle(k, node, r["g"], r["h"], r["n"])
                if split is None:
                    continue
                going = True
                tree.feature[k, node], tree.bin[k, node] = -split["feature"], -split["bin"]
                settle(k, 2 * node, split["g_below"], split["h_below"], split["n_below"])
                settle(k, 2 * node + 1, *(r[c] - split[f"{c}_below"] for c in ("g", "h", "n")))
            if not going:
                break
        if not tree.cover.any():
            break
        grown.append(tree)
        recent.append(tree)
        if len(recent) == KEPT and turn + 1 < params["rounds"]:
            state = stored(state.mapInArrow(_rewritten(recent, width, many, depth), state.schema), "boosting")
            recent = []
    nodes = []
    for turn, tree in enumerate(grown):
        for k, node in zip(*np.nonzero(tree.cover)):
            feature = int(tree.feature[k, node])
            threshold = float(cuts[feature][tree.bin[k, node]]) if feature >= 0 else 0.0
            nodes.append((turn, int(k), int(node), feature, threshold, float(tree.value[k, node]), int(tree.cover[k, node])))
    return SoftmaxTrees(nodes, many, losses)
