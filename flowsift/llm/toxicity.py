"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters by its embedding, if the sample has it in `LEAST_DOCS` documents, and by the mean embedding of
its character trigrams. A network
reads windows of words in both directions, pools its states by attention, and gives one logit per window;
windows overlap and cover the whole text, and a text is as toxic as its most toxic window. Training takes
a bounded sample of labelled documents (`SAMPLE` of label 0 and 1, by a hash of their ids, whole texts of at most
`SAMPLE_BYTES` bytes): first on windows drawn from each document, then on the windows that decide.
The last logit is scaled by a logistic fit on the same sample.

Defined results: null, empty and wordless texts are one empty window; repeated rows and null ids are scored
row by row; labels of unknown ids, null labels and repeated labels add nothing; without documents of both
labels all texts score 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import Memo, batches, held_out, mix, stored, utf8, whole, words

WINDOW, STRIDE = 32, 24
CHAR_BUCKETS = 1 << 13
# documents of the sample that a word needs for an embedding of its own
LEAST_DOCS, DRAWN = 4, 6
WORD_SIZE, CHAR_SIZE, STATE = 8, 8, 8
# training documents per label 0 and 1, and bytes of each
SAMPLE, SAMPLE_BYTES = (3_000, 1_500), 20_000
ROUNDS = 5
# windows of repeated words per round, and steps of 256 windows in a round
ECHOES, LEAST_STEPS = 3_000, 40
WORDS_HELD = 120_000


def trigram_numbers(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram of the words, and where each word's begin."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in items), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, items), np.int64, len(items)) + 2
    ends = np.cumsum(sizes)
    inside = np.ones(len(data), bool)
    inside[ends - 1] = inside[ends - 2] = False
    key = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    return ((mix(key + np.uint64(1)) >> np.uint64(20))[inside[:-2]] % np.uint64(CHAR_BUCKETS)).astype(np.int64), (
        np.concatenate([[0], np.cumsum(sizes - 2)[:-1]]))


def odds(labels: np.ndarray, docs: np.ndarray, number: np.ndarray, size: int) -> np.ndarray:
    """Log odds of a number in documents of label 1 against label 0, drawn to 0 as if seen `DRAWN` times evenly."""
    with_one = np.bincount(number[labels[docs] == 1], minlength=size)
    with_zero = np.bincount(number[labels[docs] == 0], minlength=size)
    ones, zeros = (labels == 1).mean(), (labels == 0).mean()
    return np.log((with_one / ones + DRAWN) / (with_zero / zeros + DRAWN))


def window_starts(n: int) -> np.ndarray:
    """Overlapping windows that cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.minimum(np.arange(0, n - WINDOW + STRIDE, STRIDE), n - WINDOW)


def windows(numbers: np.ndarray, starts: np.ndarray, pad: int) -> np.ndarray:
    if len(numbers) < WINDOW:
        numbers = np.concatenate([numbers, np.full(WINDOW - len(numbers), pad, numbers.dtype)])
    return numbers[starts[:, None] + np.arange(WINDOW)]


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """Parameters by name; gates are update, reset and candidate, for both directions."""

    p: dict[str, np.ndarray]
    known: np.ndarray  # sorted hashes of the words with embeddings; all others have the last one, zero
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, known: np.ndarray, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        size = WORD_SIZE + CHAR_SIZE

        def matrix(*shape):
            return draw.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        return cls({
            "word": np.concatenate([draw.normal(0, 0.02, (len(known), WORD_SIZE)), np.zeros((1, WORD_SIZE))]
                                   ).astype(np.float32),
            "char": draw.normal(0, 0.05, (CHAR_BUCKETS, CHAR_SIZE)).astype(np.float32),
            "into": matrix(size, 6 * STATE), "bias": np.zeros(6 * STATE, np.float32),
            "f": matrix(STATE, 3 * STATE), "b": matrix(STATE, 3 * STATE),
            "attend": matrix(2 * STATE), "out": matrix(2 * STATE), "level": np.zeros(1, np.float32)}, known)

    def word_numbers(self, items: list[bytes]) -> np.ndarray:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))
        if not len(self.known):
            return np.zeros(len(items), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, len(self.known))

    def inputs(self, items: list[bytes]) -> np.ndarray:
        """Word and character inputs of words."""
        trigram, begin = trigram_numbers(items)
        sizes = np.diff(np.append(begin, len(trigram)))
        mean = np.add.reduceat(self.p["char"][trigram], begin) / sizes[:, None]
        return np.concatenate([self.p["word"][self.word_numbers(items)], mean], axis=1).astype(np.float32)

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        return inputs @ self.p["into"] + self.p["bias"]

    def forward(self, gates: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows; gates (windows, words, 6 states), real marks words that aren't padding."""
        n = len(gates)
        states = np.empty((WINDOW, n, 2 * STATE), np.float32)
        trace = []
        padded = not real.all()
        for side, (name, steps) in enumerate((("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1)))):
            weight = self.p[name]
            at = 3 * STATE * side
            h = np.zeros((n, STATE), np.float32)
            for t in steps:
                x = gates[:, t, at : at + 3 * STATE]
                inner = h @ weight
                zr = sigmoid(x[:, : 2 * STATE] + inner[:, : 2 * STATE])
                z, r = zr[:, :STATE], zr[:, STATE:]
                c = np.tanh(x[:, 2 * STATE :] + r * inner[:, 2 * STATE :])
                new = c + z * (h - c)
                if padded:
                    new = np.where(real[:, t, None], new, h)
                if keep:
                    trace.append((side, t, h, z, r, c, inner[:, 2 * STATE :]))
                h = new
                states[t, :, side * STATE : (side + 1) * STATE] = h
        score = states @ self.p["attend"]
        if padded:
            score = np.where(real.T, score, np.float32(-1e9))
        share = np.exp(score - score.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.einsum("tn,tns->ns", share, states)
        logit = pooled @ self.p["out"] + self.p["level"][0]
        return (logit, states, share, pooled, trace) if keep else logit

    def gradients(self, gates: np.ndarray, real: np.ndarray, error_of) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all but the inputs' parameters, and of the gates."""
        logit, states, share, pooled, trace = self.forward(gates, real, keep=True)
        error = error_of(logit).astype(np.float32)
        g = {"out": pooled.T @ error, "level": error.sum(keepdims=True), "f": 0, "b": 0}
        d_pooled = error[:, None] * self.p["out"]
        along = np.einsum("tns,ns->tn", states, d_pooled)
        d_score = share * (along - (share * along).sum(axis=0))
        g["attend"] = np.einsum("tn,tns->s", d_score, states)
        d_states = share[:, :, None] * d_pooled + d_score[:, :, None] * self.p["attend"]
        d_gates = np.zeros_like(gates)
        carried = np.zeros((len(gates), STATE), np.float32)
        last = None
        for side, t, h, z, r, c, inner in reversed(trace):
            if side != last:
                carried, last = np.zeros((len(gates), STATE), np.float32), side
            d = carried + d_states[t, :, side * STATE : (side + 1) * STATE]
            live = real[:, t, None]
            dn = np.where(live, d, 0)
            dz = dn * (h - c) * z * (1 - z)
            dc = dn * (1 - z) * (1 - c * c)
            dr = dc * inner * r * (1 - r)
            d_inner = np.concatenate([dz, dr, dc * r], axis=1)
            d_gates[:, t, 3 * STATE * side : 3 * STATE * (side + 1)] = np.concatenate([dz, dr, dc], axis=1)
            name = "f" if side == 0 else "b"
            g[name] = g[name] + h.T @ d_inner
            carried = np.where(live, dn * z, d) + d_inner @ self.p[name].T
        return g, d_gates


class Trainer:
    """Adam on the words of a sample."""

    def __init__(self, texts: list[bytes], labels: np.ndarray, seed: int = 7):
        self.labels, self.draw = labels, np.random.default_rng(seed)
        number = Memo(lambda w: len(number), 1 << 60)
        self.docs = [np.fromiter(map(number.__getitem__, words(t)), np.int64) for t in texts]
        self.items = list(number) or [b"-"]
        self.pad = len(self.items)
        distinct = [np.unique(d) for d in self.docs]
        of = np.repeat(np.arange(len(texts)), [len(d) for d in distinct])
        flat = np.concatenate(distinct)
        common = np.flatnonzero(np.bincount(flat, minlength=len(self.items)) >= LEAST_DOCS)
        known = np.fromiter((xxhash.xxh3_64_intdigest(self.items[k]) for k in common), np.uint64, len(common))
        self.net = Network.fresh(np.sort(known), seed)
        self.word = self.net.word_numbers(self.items)
        self.trigram, self.begin = trigram_numbers(self.items)
        self.sizes = np.diff(np.append(self.begin, len(self.trigram)))
        # words start from what they say by themselves
        p = self.net.p
        p["word"][:-1, 0] = odds(labels, of, self.word[flat], len(p["word"]))[:-1] / 2
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.net.p.items()}
        self.turn = 0
        self.starts = [window_starts(len(d)) for d in self.docs]

    def _inputs(self, used: np.ndarray) -> np.ndarray:
        p = self.net.p
        rows = np.repeat(np.arange(len(used)), self.sizes[used])
        flat = self.trigram[_ranges(self.begin[used], self.sizes[used])]
        mean = np.zeros((len(used), CHAR_SIZE), np.float32)
        np.add.at(mean, rows, p["char"][flat])
        return np.concatenate([p["word"][self.word[used]], mean / self.sizes[used][:, None]], axis=1).astype(np.float32)

    def _gates(self, rows: np.ndarray):
        used, inverse = np.unique(rows, return_inverse=True)
        real = rows != self.pad
        known = used[used != self.pad]
        inputs = self._inputs(known)
        table = self.net.gates(inputs)
        if len(known) < len(used):
            table = np.concatenate([table, np.zeros((1, table.shape[1]), np.float32)])
        return known, inputs, inverse.reshape(rows.shape), table, real

    def step(self, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, rate: float) -> None:
        known, inputs, inverse, table, real = self._gates(rows)
        g, d_gates = self.net.gradients(
            table[inverse], real, lambda logit: (sigmoid(logit) - labels) * weight / weight.sum())
        d_table = np.zeros_like(table)
        np.add.at(d_table, inverse.ravel(), d_gates.reshape(-1, d_gates.shape[2]))
        d_table = d_table[: len(known)]
        g["into"], g["bias"] = inputs.T @ d_table, d_table.sum(axis=0)
        d_inputs = d_table @ self.net.p["into"].T
        g["word"] = np.zeros_like(self.net.p["word"])
        np.add.at(g["word"], self.word[known], d_inputs[:, :WORD_SIZE])
        g["word"][-1] = 0
        g["char"] = np.zeros_like(self.net.p["char"])
        rows_of = np.repeat(np.arange(len(known)), self.sizes[known])
        np.add.at(g["char"], self.trigram[_ranges(self.begin[known], self.sizes[known])],
                  (d_inputs[:, WORD_SIZE:] / self.sizes[known][:, None])[rows_of])
        self.turn += 1
        for name, value in self.net.p.items():
            m, v = self.moments[name]
            m += 0.1 * (g[name] - m)
            v += 0.001 * (np.square(g[name]) - v)
            value -= (rate * m / (1 - 0.9**self.turn) / (np.sqrt(v / (1 - 0.999**self.turn)) + 1e-8)).astype(np.float32)

    def logits(self) -> list[np.ndarray]:
        """Logits of all windows of every document."""
        table = np.concatenate([self.net.gates(self._inputs(np.arange(self.pad))), np.zeros((1, 6 * STATE), np.float32)])
        rows = np.concatenate([windows(d, s, self.pad) for d, s in zip(self.docs, self.starts)])
        out = [self.net.forward(table[part], part != self.pad)
               for part in (rows[k : k + 4096] for k in range(0, len(rows), 4096))]
        return np.split(np.concatenate(out), np.cumsum([len(s) for s in self.starts])[:-1])

    def _with_echoes(self, rows, which, weight):
        """Adds windows of a few words of clean documents said over and over, which real texts have too."""
        clean = np.flatnonzero((self.labels[which] == 0) & (rows != self.pad).all(axis=1))
        if not len(clean):
            return rows, which, weight
        count = min(ECHOES, len(rows))
        of = self.draw.choice(clean, count)
        size = self.draw.integers(1, WINDOW // 2, count)
        begin = self.draw.integers(0, WINDOW // 2, count)
        place = begin[:, None] + np.arange(WINDOW) % size[:, None]
        return (np.concatenate([rows, rows[of[:, None], place]]), np.concatenate([which, which[of]]),
                np.concatenate([weight, np.full(count, weight[of].mean())]))

    def train(self, rounds: int = ROUNDS) -> Network:
        balance = np.where(self.labels == 1, (self.labels == 0).sum(), (self.labels == 1).sum()) / len(self.labels)
        for turn in range(rounds):
            if turn == 0:
                picked = [self.draw.choice(s, 8) for s in self.starts]
            else:
                # the window that decides, of clean documents the three most suspicious ones
                picked = []
                for starts, logit, label in zip(self.starts, self.logits(), self.labels):
                    top = starts[np.argsort(-logit)[: 1 if label else 3]]
                    picked.append(top)
            rows = np.concatenate([windows(d, s, self.pad) for d, s in zip(self.docs, picked)])
            which = np.repeat(np.arange(len(picked)), [len(s) for s in picked])
            weight = balance[which] / np.array([len(s) for s in picked])[which]
            rows, which, weight = self._with_echoes(rows, which, weight)
            # small samples are gone over several times, for as many steps as a network needs
            passes = max(1, -(-LEAST_STEPS * 256 // len(rows)))
            order = np.concatenate([self.draw.permutation(len(rows)) for _ in range(passes)])
            for k in range(0, len(order), 256):
                part = order[k : k + 256]
                self.step(rows[part], self.labels[which[part]], weight[part], 0.01 if turn < 3 else 0.003)
        top = np.array([x.max() for x in self.logits()], np.float64)
        self.net.scale, self.net.shift = logistic_fit(top, self.labels)
        return self.net


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for every start and size."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through logits, by Newton steps; the scale stays positive."""
    scale, shift = 1.0, 0.0
    for _ in range(30):
        q = sigmoid(scale * x + shift)
        w = q * (1 - q) + 1e-6
        g = np.array([((q - y) * x).sum() + 0.01 * (scale - 1), (q - y).sum()])
        hess = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        scale, shift = max(0.1, scale - move[0]), shift - move[1]
    return float(scale), float(shift)


def sample(docs: DataFrame, labels: DataFrame, column: str = "toxic", count: tuple[int, int] = SAMPLE,
           size: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most `count` training documents of label 0 and 1 that `docs` has.

    Of a text of more than `size` bytes a drawn stretch of at most `size` characters is taken.
    """
    usable = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(3, 1)).select(
        "doc_id", F.col(column).cast("int").alias("label")).distinct()
    usable = stored(usable.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi"))
    chosen = [usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(count[k]) for k in (0, 1)]
    # the sample's size bounds these rows; they stay with Spark, local rows would start Python workers on every executor
    ids = stored(chosen[0].unionAll(chosen[1]))
    start = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.lit(1), F.length("text") - size + 1)).cast("int") + 1
    part = F.when(F.octet_length("text") <= size, F.col("text")).otherwise(F.substring("text", start, F.lit(size)))
    rows = (
        docs.where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "label", part.alias("text"))
        .select("text", "label", F.xxhash64("doc_id", "text").alias("draw")).orderBy("draw", "text").limit(sum(count))
        .collect())
    return [r[0].encode() for r in rows], np.array([r[1] for r in rows], np.float32)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", **bounds) -> Network | None:
    """A network trained on a bounded sample; None without documents of both labels."""
    texts, y = sample(docs, labels, column, **bounds)
    if len(set(y.tolist())) < 2:
        return None
    return Trainer(texts, y).train()


class Scorer:
    """Scores of texts; gates of words seen before are kept up to a bound."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self):
        self.fresh: list[bytes] = []
        self.known = Memo(self._number, 1 << 60)
        # row 0 is padding; rows take memory only once they are written, so there is room for those of a last batch too
        self.table = np.zeros((2 * WORDS_HELD, 6 * STATE), np.float32)

    def _number(self, word: bytes) -> int:
        self.fresh.append(word)
        return len(self.known) + 1

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if len(self.known) > WORDS_HELD:
            self.clear()
        numbers = [np.fromiter(map(self.known.__getitem__, words(t)), np.int32) for t in texts]
        if self.fresh:
            end = len(self.known) + 1
            while len(self.table) < end:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for k in range(0, len(self.fresh), 20_000):
                part = self.fresh[k : k + 20_000]
                at = end - len(self.fresh) + k
                self.table[at : at + len(part)] = self.net.gates(self.net.inputs(part))
            self.fresh = []
        starts = [window_starts(len(n)) for n in numbers]
        rows = np.concatenate([windows(n, s, 0) for n, s in zip(numbers, starts)])
        logits = np.concatenate([self.net.forward(self.table[part], part != 0)
                                 for part in (rows[k : k + 512] for k in range(0, len(rows), 512))])
        first = np.concatenate([[0], np.cumsum([len(s) for s in starts])[:-1]])
        top = np.maximum.reduceat(logits, first)
        return sigmoid(self.net.scale * top.astype(np.float64) + self.net.shift)


def scored(docs: DataFrame, net: Network | None, *extra: str) -> DataFrame:
    """doc_id, text (null as empty), the named other columns and score of every row."""
    rows = whole(docs, *extra)
    if net is None:
        return rows.withColumn("score", F.lit(0.5))
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def score(records):
        scorer = Scorer(net)
        for batch in batches(records, 200, scorer):
            values = scorer.scores(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*names, "score"])

    return rows.mapInArrow(score, f"{kinds}, score double")
