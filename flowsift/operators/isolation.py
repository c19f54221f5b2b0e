"""Isolation forest: fit on a bounded sample per tree, score every row in place.

Spark draws the samples and grows each tree in its own group; a tree never sees more than
sample_size rows. The fitted forest is a table of at most trees * (2 * sample_size - 1) nodes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.operators.ordering import first_in_groups

# fixed values: forest size, sample and seed of the anomaly model
TREES = 200
SAMPLE = 256
SEED = 42
THRESHOLD_QUANTILE = 0.99

NODE_SCHEMA = "tree int, node int, feature int, threshold double, below int, above int, path double"


def mean_path(size) -> np.ndarray:
    """Expected search depth among n points: 2 H(n-1) - 2 (n-1) / n."""
    n = np.asarray(size, dtype=float)
    inner = np.maximum(n - 1, 1)
    estimate = 2.0 * (np.log(inner) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, estimate))


def tree_samples(rows: DataFrame, features: list[str], row_id: str, trees: int = TREES,
                 sample: int = SAMPLE, seed: int = SEED) -> tuple[DataFrame, int]:
    """(tree, x) rows and the sample size per tree.

    Every tree draws without replacement from all rows: those of the smallest hashes of tree and row
    id. A bound on the hash, which about twice the sample passes, is met before a row is copied for a
    tree, so the copies are bounded by trees and sample whatever the table holds.
    """
    total = rows.count()
    if total == 0:
        raise ValueError("cannot fit on an empty table")
    size = min(sample, total)
    bound = math.ceil(min(1.0, (2.0 * size + 100.0) / total) * (1 << 62))
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), F.pmod(F.xxhash64(F.lit(seed), t, F.col(row_id)), F.lit(1 << 62)).alias("draw")))
    near = F.filter(draws, lambda d: d["draw"] < F.lit(bound))
    # few rows are near for any tree; one compiled expression finds them before the draws are made one by one
    least = F.least(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(t), F.col(row_id)), F.lit(1 << 62))
                      for t in range(trees)], F.lit(1 << 62))
    rows = rows.where(least < F.lit(bound))
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    copies = rows.select(x, F.col(row_id).alias("_id"), F.explode(near).alias("_d")).select("x", "_id", "_d.*")
    return first_in_groups(copies, ["tree"], [F.col("draw"), F.col("_id")], size).select("tree", "x"), size


def fit(rows: DataFrame, features: list[str], row_id: str, trees: int = TREES, sample: int = SAMPLE,
        seed: int = SEED) -> DataFrame:
    """The node table of the forest."""
    samples, size = tree_samples(rows, features, row_id, trees, sample, seed)
    height = math.ceil(math.log2(size)) if size > 1 else 0

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        points = np.stack(group["x"].to_numpy())
        points = points[np.lexsort(points.T)]  # the same tree whatever order rows arrive in
        random = np.random.default_rng([seed, tree])
        nodes, pending = [], [(0, points, 0)]
        made = 1
        while pending:
            node, inside, depth = pending.pop()
            low, high = inside.min(axis=0), inside.max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= height or len(inside) <= 1 or len(open_features) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, depth + float(mean_path(len(inside)))))
                continue
            feature = int(random.choice(open_features))
            cut = float(random.uniform(low[feature], high[feature]))
            side = inside[:, feature] <= cut
            nodes.append((tree, node, feature, cut, made, made + 1, 0.0))
            pending += [(made, inside[side], depth + 1), (made + 1, inside[~side], depth + 1)]
            made += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "below", "above", "path"])

    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).withColumn("sample", F.lit(size))


class Forest:
    """The node table as flat arrays: a bounded, broadcastable model."""

    def __init__(self, nodes: pd.DataFrame):
        ordered = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        offsets = ordered.groupby("tree").size().cumsum().shift(fill_value=0)
        base = ordered["tree"].map(offsets).to_numpy()
        inner = ordered["feature"].to_numpy() >= 0
        itself = np.arange(len(ordered))
        self.roots = offsets.to_numpy().astype(np.int32)
        self.feature = np.where(inner, ordered["feature"], 0).astype(np.int32)
        self.threshold = np.where(inner, ordered["threshold"], np.inf)
        # children of node i at 2 i and 2 i + 1; a leaf leads back to itself
        pairs = [np.where(inner, ordered[side] + base, itself) for side in ("below", "above")]
        self.children = np.stack(pairs, axis=1).ravel().astype(np.int32)
        self.path = ordered["path"].to_numpy()
        size = int(ordered["sample"].iloc[0])
        self.height = math.ceil(math.log2(size)) if size > 1 else 0
        self.scale = float(mean_path(size)) or 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(x).ravel()
        starts = (np.arange(len(x), dtype=np.int32) * x.shape[1])[:, None]
        at = np.tile(self.roots, (len(x), 1))
        for _ in range(self.height):
            above = flat.take(starts + self.feature.take(at)) > self.threshold.take(at)
            at = self.children.take(2 * at + above)
        return np.power(2.0, -self.path.take(at).mean(axis=1) / self.scale)


def load(nodes: DataFrame) -> Forest:
    """Collects the node table: bounded by trees * (2 * sample - 1) rows."""
    return Forest(nodes.toPandas())


def matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Arrow rows of so many doubles each as one array; nulls are NaN."""
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)


def score_column(forest: Forest, features: list[str]) -> Column:
    """Raw isolation score in (0, 1): near 1 is easy to isolate.

    The forest travels inside the function, which Spark broadcasts once it is over 1 MB.
    """
    batch = 512  # rows times trees fit the processor cache

    width = len(features)

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        x = matrix(rows, width)
        pieces = [forest.score(x[i:i + batch]) for i in range(0, len(x), batch)]
        return pa.array(np.concatenate(pieces) if pieces else np.empty(0), pa.float64())

    return score(F.array(*[F.col(c).cast("double") for c in features]))


def with_score(rows: DataFrame, forest: Forest, features: list[str], output: str = "raw_score") -> DataFrame:
    return rows.withColumn(output, score_column(forest, features))
