"""Weighted multi-class trees, search, prediction and exact Shapley values."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import (
    GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.functions.scalar import class_index, class_name
from flowsift.operators import boosting
from flowsift.operators.evaluate import macro_f1, pair_counts
from flowsift.operators.isolation import matrix
from flowsift.schema import CLASSES, FEATURE_COLUMNS

DEFAULT_PARAMS = {"numTrees": 40, "maxDepth": 8, "minInstancesPerNode": 1}
# search space of the random trials
SPACE = {"numTrees": [20, 40, 80], "maxDepth": [4, 6, 8, 10], "minInstancesPerNode": [1, 2, 5]}
TRIALS = 20
BOOSTED_PARAMS = {"maxIter": 20, "maxDepth": 4}
BOOSTED_SPACE = {"maxIter": [10, 20, 40], "maxDepth": [3, 4, 6], "minInstancesPerNode": [1, 2, 5]}
SEED = 42


def assemble(rows: DataFrame, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(rows)


def train(rows: DataFrame, features: list[str] = FEATURE_COLUMNS, classes: list[str] = CLASSES,
          params: dict | None = None, label: str = "label", weight: str | None = "weight",
          seed: int = SEED) -> RandomForestClassificationModel:
    """Fits on (features..., label[, weight]); class indices are alphabetical."""
    indexed = rows.withColumn("label_index", class_index(label, classes).cast("double"))
    classifier = RandomForestClassifier(
        featuresCol="features", labelCol="label_index", seed=seed,
        **({"weightCol": weight} if weight else {}), **{**DEFAULT_PARAMS, **(params or {})},
    )
    return classifier.fit(assemble(indexed, features))


def train_boosted(rows: DataFrame, features: list[str] = FEATURE_COLUMNS, classes: list[str] = CLASSES,
                  params: dict | None = None, label: str = "label", weight: str | None = "weight",
                  seed: int = SEED) -> OneVsRestModel:
    """One boosted ensemble per class: slower to fit than the forest, one pass per class and tree."""
    indexed = rows.withColumn("label_index", class_index(label, classes).cast("double"))
    booster = GBTClassifier(seed=seed, **{**BOOSTED_PARAMS, **(params or {})})
    each = OneVsRest(classifier=booster, featuresCol="features", labelCol="label_index",
                     **({"weightCol": weight} if weight else {}))
    return each.fit(assemble(indexed, features))


# families of models and their search spaces
SPACES = {"forest": SPACE, "per_class": BOOSTED_SPACE, "softmax": boosting.SPACE}


def fit(family: str, rows: DataFrame, features: list[str] = FEATURE_COLUMNS, classes: list[str] = CLASSES,
        params: dict | None = None, seed: int = SEED):
    """A forest, one boosted ensemble per class, or boosted trees of all classes at once."""
    if family == "softmax":
        return boosting.train(rows, features, classes, params)
    return {"forest": train, "per_class": train_boosted}[family](rows, features, classes, params, seed=seed)


def save(model, spark: SparkSession, path: str) -> None:
    if isinstance(model, boosting.SoftmaxTrees):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)


def load(family: str, spark: SparkSession, path: str, class_count: int):
    if family == "softmax":
        return boosting.SoftmaxTrees.load(spark, path, class_count)
    return {"forest": RandomForestClassificationModel, "per_class": OneVsRestModel}[family].load(path)


def predict(model, rows: DataFrame, features: list[str] = FEATURE_COLUMNS,
            classes: list[str] = CLASSES) -> DataFrame:
    """Adds probabilities (one per class), class_index, predicted and confidence."""
    if isinstance(model, (OneVsRestModel, boosting.SoftmaxTrees)):
        scored = rows.withColumn("probabilities", boosted_probabilities(paths_of(model, len(classes)), features))
    else:
        # classes above the largest label seen in training have no entry in the vector
        given = F.concat(vector_to_array("probability"), F.array(*[F.lit(0.0)] * len(classes)))
        scored = model.transform(assemble(rows, features)).withColumn("probabilities", F.slice(given, 1, len(classes)))
    best = F.array_max("probabilities")
    out = scored.withColumn("confidence", best)
    index = (F.array_position("probabilities", F.col("confidence")) - 1).cast("int")
    out = out.withColumn("class_index", index).withColumn("predicted", class_name("class_index", classes))
    return out.select(*rows.columns, "probabilities", "class_index", "predicted", "confidence")


def search(training: DataFrame, validation: DataFrame | None, features: list[str] = FEATURE_COLUMNS,
           classes: list[str] = CLASSES, trials: int = TRIALS, seed: int = SEED,
           space: dict | None = None, family: str = "forest") -> tuple[dict, float]:
    """Random search for the highest macro F1; without validation rows it uses training rows."""
    draw = random.Random(seed)
    options = space or SPACES[family]
    combinations = 1
    for values in options.values():
        combinations *= len(values)
    tried, best, best_score = set(), None, -1.0
    judged = training if validation is None or validation.isEmpty() else validation
    while len(tried) < min(trials, combinations):
        params = {name: draw.choice(values) for name, values in options.items()}
        key = tuple(sorted(params.items()))
        if key in tried:
            continue
        tried.add(key)
        model = fit(family, training, features, classes, params, seed)
        score = macro_f1(pair_counts(predict(model, judged, features, classes)), classes)
        if score > best_score:
            best, best_score = params, score
    return best, best_score


def _orders(most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of features, the points and weights that integrate their polynomial exactly."""
    out = []
    for count in range(most + 1):
        point, weight = np.polynomial.legendre.leggauss(max(1, (count + 1) // 2))
        out.append(((point + 1) / 2, weight / 2))
    return out


def subset_weights(zero: np.ndarray, one: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For every row of `one` (rows, features) and feature i: the sum over sets S of the other features of
    |S|! (m - |S| - 1)! / m! times the product of `one` over S and of `zero` over the rest.

    The factorials are integrals of t^|S| (1 - t)^(m - |S| - 1), so the sum is the integral of the product of
    (one t + zero (1 - t)) over the others: a polynomial of degree m - 1.
    """
    out = np.zeros(one.shape)
    for t, weight in zip(*order):
        term = one * t + zero * (1 - t)
        out += weight * term.prod(axis=1, keepdims=True) / term
    return out


class TreePaths:
    """Splits of an ensemble, how many training rows met each node and what leaves say about every class.

    Size is fixed by the parameters: at most trees * 2 ** (maxDepth + 1) nodes.
    """

    def __init__(self):
        self.feature, self.threshold, self.below, self.above, self.said, self.roots = [], [], [], [], [], []
        self.cover: list[float] = []

    def _add(self, node, value) -> int:
        at = len(self.feature)
        self.said.append(value(node))
        self.cover.append(float(node.impurityStats().count()))
        for values in (self.feature, self.below, self.above):
            values.append(-1)
        self.threshold.append(0.0)
        if node.subtreeDepth() > 0:
            split = node.split()
            self.feature[at], self.threshold[at] = split.featureIndex(), split.threshold()
            self.below[at] = self._add(node.leftChild(), value)
            self.above[at] = self._add(node.rightChild(), value)
        return at

    def _freeze(self):
        for name in ("feature", "below", "above", "roots"):
            setattr(self, name, np.array(getattr(self, name), dtype=np.int64))
        self.threshold, self.said, self.cover = (np.array(x, dtype=float) for x in (self.threshold, self.said, self.cover))
        # an inner node says what its leaves say, weighted by their rows; children stand behind their parents
        for at in range(len(self.feature) - 1, -1, -1):
            if self.feature[at] >= 0:
                share = self._share(at)
                self.said[at] = share[0] * self.said[self.below[at]] + share[1] * self.said[self.above[at]]

    def _share(self, at: int) -> np.ndarray:
        """Parts of a node's training rows that went below and above its threshold."""
        both = self.cover[[self.below[at], self.above[at]]]
        return both / both.sum() if both.sum() > 0 else np.array([0.5, 0.5])

    def base(self) -> np.ndarray:
        """What the ensemble says about each class on average over the training rows."""
        return self.said[self.roots].sum(axis=0)

    def _walk(self, x: np.ndarray, root: int):
        """Yields (rows, nodes, next nodes) of each step until all rows reach a leaf."""
        rows, at = np.arange(len(x)), np.full(len(x), root)
        while len(rows):
            inner = self.feature[at] >= 0
            rows, at = rows[inner], at[inner]
            if len(rows):
                goes_below = x[rows, self.feature[at]] <= self.threshold[at]
                following = np.where(goes_below, self.below[at], self.above[at])
                yield rows, at, following
                at = following

    def contributions(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Exact Shapley values of each feature for the target class of each row.

        A feature outside a set is averaged out by the training rows of the branches. A leaf contributes by
        the features on its path alone: each has the part of training rows that its splits let through, and is
        met by the row or not, so a leaf has one small table of what each combination of met features gives.
        base()[target] plus the row sum is what the ensemble says about the target.

        Rows that take the same side at all splits of a tree and have one target get the same from it, so each such
        kind of rows is reckoned once.
        """
        out = np.zeros(x.shape)
        columns = np.ascontiguousarray(x.T)
        for root in self.roots:
            inner = self._inner(int(root))
            if len(inner) > MOST_SPLITS:
                out += self._tree_contributions(x, target, root)
                continue
            kind = target.astype(np.int64) << len(inner)
            for k, at in enumerate(inner):
                kind |= (columns[self.feature[at]] <= self.threshold[at]).astype(np.int64) << k
            _, some, of = np.unique(kind, return_index=True, return_inverse=True)
            out += self._tree_contributions(x[some], target[some], root)[of]
        return out

    def _inner(self, root: int) -> list[int]:
        """The splits of a tree."""
        found, pending = [], [root]
        while pending:
            at = pending.pop()
            if self.feature[at] >= 0:
                found.append(at)
                pending += [int(self.below[at]), int(self.above[at])]
        return found

    def _tree_contributions(self, x: np.ndarray, target: np.ndarray, root: int) -> np.ndarray:
        out = np.zeros(x.shape)
        for leaf, features, zero, met in self._leaves(x, root):
            said = self.said[leaf, target]
            if not features or not said.any():
                continue
            m = len(features)
            code = (met.astype(np.int64) << np.arange(m)[:, None]).sum(axis=0)
            some, code = (np.arange(1 << m), code) if 1 << m <= 4 * len(x) + 64 else np.unique(code, return_inverse=True)
            one = (some[:, None] >> np.arange(m) & 1).astype(float)
            table = (one - zero) * subset_weights(np.array(zero), one, _ORDERS[m])
            out[:, features] += table[code] * said[:, None]
        return out

    def _leaves(self, x: np.ndarray, root: int):
        """(leaf, features on its path, part of the training rows each lets through, rows that meet each)."""
        stack = [(int(root), [], [], [])]
        while stack:
            at, features, zero, met = stack.pop()
            if self.feature[at] < 0:
                yield at, features, zero, np.array(met)
                continue
            feature, share = int(self.feature[at]), self._share(at)
            goes_below = x[:, feature] <= self.threshold[at]
            for child, part, follows in ((self.below[at], share[0], goes_below), (self.above[at], share[1], ~goes_below)):
                if part == 0:
                    continue  # no training row went there: its weight is nothing in any average
                if feature in features:
                    k = features.index(feature)
                    again = [*zero[:k], zero[k] * part, *zero[k + 1:]], [*met[:k], met[k] & follows, *met[k + 1:]]
                    stack.append((int(child), features, *again))
                else:
                    stack.append((int(child), [*features, feature], [*zero, part], [*met, follows]))

    def totals(self, x: np.ndarray) -> np.ndarray:
        """What the ensemble says about every class, per row."""
        out = np.tile(self.base(), (len(x), 1))
        for root in self.roots:
            for rows, node, following in self._walk(x, root):
                out[rows] += self.said[following] - self.said[node]
        return out


# sides at so many splits and a class fit into one 64-bit number
MOST_SPLITS = 48
# paths are at most this deep
_ORDERS = _orders(31)


class ForestPaths(TreePaths):
    """Class probabilities: the mean of the trees' class shares."""

    def __init__(self, model: RandomForestClassificationModel, class_count: int):
        super().__init__()
        trees = model.trees

        def share(node) -> np.ndarray:
            stats = np.array(list(node.impurityStats().stats()), dtype=float)
            padded = np.zeros(class_count)
            padded[: len(stats)] = stats / stats.sum() / len(trees)
            return padded

        self.roots = [self._add(tree._call_java("rootNode"), share) for tree in trees]
        self._freeze()


class BoostedPaths(TreePaths):
    """Class margins: the weighted sum of the trees of the class's own ensemble."""

    def __init__(self, model: OneVsRestModel, class_count: int):
        super().__init__()
        for position, ensemble in enumerate(model.models):
            for tree, weight in zip(ensemble.trees, ensemble.treeWeights):
                def margin(node, position=position, weight=weight) -> np.ndarray:
                    value = np.zeros(class_count)
                    value[position] = node.prediction() * weight
                    return value

                self.roots.append(self._add(tree._call_java("rootNode"), margin))
        self.known = len(model.models)
        self._freeze()

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Logistic of the margins, scaled to sum to one; classes never trained get none."""
        odds = 1.0 / (1.0 + np.exp(-2.0 * self.totals(x)))
        odds[:, self.known:] = 0.0
        return odds / odds.sum(axis=1, keepdims=True)


class SoftmaxPaths(TreePaths):
    """Class margins: the sum of the trees of the class."""

    def __init__(self, model: boosting.SoftmaxTrees, class_count: int):
        super().__init__()
        place: dict[tuple, int] = {}
        # ordered by round, class and node, so children stand behind their parents
        for turn, k, node, feature, threshold, value, cover in sorted(model.nodes):
            at = place[turn, k, node] = len(self.feature)
            said = np.zeros(class_count)
            said[k] = value
            self.feature.append(feature)
            self.threshold.append(threshold)
            self.said.append(said)
            self.cover.append(float(cover))
            self.below.append(-1)
            self.above.append(-1)
            if node == 1:
                self.roots.append(at)
            else:
                (self.above if node % 2 else self.below)[place[turn, k, node // 2]] = at
        self._freeze()
        self.said = self.said.reshape(-1, class_count)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return boosting.softmax(self.totals(x))


def paths_of(model, class_count: int) -> TreePaths:
    if isinstance(model, boosting.SoftmaxTrees):
        return SoftmaxPaths(model, class_count)
    return (BoostedPaths if isinstance(model, OneVsRestModel) else ForestPaths)(model, class_count)


def boosted_probabilities(paths: BoostedPaths | SoftmaxPaths, features: list[str]) -> Column:
    @F.pandas_udf("array<double>")
    def probabilities(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(list(paths.probabilities(np.stack(x.to_numpy()))) if len(x) else [], dtype=object)

    return probabilities(F.array(*[F.col(c).cast("double") for c in features]))


def attribution_column(paths: TreePaths, features: list[str], target: str) -> Column:
    """array<double> in feature order: contributions to the class of index column `target`."""
    width = len(features)

    @F.arrow_udf("array<double>")
    def attribute(x: pa.Array, wanted: pa.Array) -> pa.Array:
        moved = paths.contributions(matrix(x, width), wanted.to_numpy(zero_copy_only=False).astype(int))
        return pa.ListArray.from_arrays(np.arange(0, moved.size + 1, width, np.int32), moved.ravel())

    return attribute(F.array(*[F.col(c).cast("double") for c in features]), F.col(target))
