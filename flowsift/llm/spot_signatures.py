"""SpotSigs fingerprints: chains of content words that follow common words.

Every common word of a text starts a chain: the common word and the next content words, one in
`distance` of them. A text's fingerprint is its set of chains, written as sorted hexadecimal hashes. The
text's start counts as one more common word, so any text with a content word has a chain; a text of
common words only has one chain of all its words, a text without words has none.

Stretches of content words that are longer than a chain draw further starts from their own words: of every
run of as many words as a start and its chain span, the one with the least hash. Chains therefore cover all
content words of a text in any language, of code and of tables, and an edit changes the chains around it only.

Likeness is the Jaccard index of two sets; two empty sets are alike. A pair need not be merged when the
lengths of its sets, or what is left to merge, cannot reach the threshold (`pruned_jaccard`).

Defined results: a null text is empty; documents are taken by descending doc_id, nulls last, equal ids by
a hash of the text; after the last comes the first, so a single document is its own next; repeated rows
stay rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.common import batches, hashes, mix, stored, utf8, whole, wide, word_hashes, words

# common words of four languages that start a chain
ANCHORS = frozenset(
    "the a an and of to in is was are were be been that this it for on with as by at from or not have has had do "
    "which there their they you he she we his her its but can will would "
    "der die das und ist in den von zu mit sich auf für im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des du et est un une que qui dans pour par sur pas plus au ce il ne se avec sont "
    "el los las del y en que es una por con para su lo al como se no más o pero sus".split())
CHAIN, DISTANCE = 3, 1


class Signer:
    def __init__(self, chain: int = CHAIN, distance: int = DISTANCE):
        self.chain, self.distance = chain, distance
        self.memo = word_hashes()
        self.anchors = np.sort(hashes([a.encode() for a in ANCHORS], self.memo))

    def drawn(self, content: np.ndarray, stretch: np.ndarray) -> np.ndarray:
        """Places of content words that start chains themselves; `stretch` numbers the stretches they stand in."""
        span = self.chain * self.distance + 1
        if len(content) < span:
            return np.empty(0, np.int64)
        least = np.lib.stride_tricks.sliding_window_view(mix(content), span).argmin(axis=1)
        inside = np.flatnonzero(stretch[span - 1 :] == stretch[: len(stretch) - span + 1])
        return np.unique(inside + least[inside])

    def signatures(self, text: bytes) -> np.ndarray:
        """Sorted distinct 32-bit chain hashes of a text."""
        word = hashes(words(text), self.memo)
        if not len(word):
            return np.empty(0, np.uint32)
        at = np.minimum(np.searchsorted(self.anchors, word), len(self.anchors) - 1)
        common = self.anchors[at] == word
        content = word[~common]
        if not len(content):
            content = word[:1] ^ np.bitwise_xor.reduce(word * np.arange(1, 2 * len(word), 2, dtype=np.uint64))
            common = np.zeros(1, bool)
        drawn = self.drawn(content, np.cumsum(common)[~common] if common.any() else np.zeros(len(content), np.int64))
        # content words before each anchor; the text's start is the first anchor
        begin = np.concatenate([[0], (np.cumsum(~common) - ~common)[common]]) if common.any() else np.zeros(1, np.int64)
        value = np.concatenate([np.zeros(1, np.uint64), word[common]]) if common.any() else np.zeros(1, np.uint64)
        keep = begin < len(content)
        begin, value = np.append(begin[keep], drawn + 1), np.append(value[keep], content[drawn])
        value = value * np.uint64(0x9E3779B97F4A7C15)
        ends = np.concatenate([content, np.zeros(self.chain * self.distance, np.uint64)])
        for k in range(self.chain):
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ends[begin + k * self.distance]
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return np.unique((value >> np.uint64(32)).astype(np.uint32))


def written(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard index of two sorted sets, or 0 as soon as it can't reach `least`."""
    if not len(a) and not len(b):
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) < least * len(long):
        return 0.0
    # so many signatures of the shorter set have to be in the longer one
    needed = least * (len(a) + len(b)) / (1 + least)
    common, step = 0, max(32, len(short) // 8) if least else max(1, len(short))
    for start in range(0, len(short), step):
        part = short[start : start + step]
        at = np.minimum(np.searchsorted(long, part), len(long) - 1)
        common += int((long[at] == part).sum())
        if common + len(short) - start - len(part) < needed - 1e-9:
            return 0.0
    return common / (len(a) + len(b) - common)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """bucket, extra, doc_id, text, tie: documents by id ranges, each range with the first row after it."""
    rows = whole(docs).withColumn("tie", F.xxhash64("text"))
    ids = docs.select("doc_id", F.col("doc_id").cast("double").alias("number"))
    inner = sorted(set(ids.where("number is not null").approxQuantile(
        "number", [k / parts for k in range(1, parts)], 1 / (20 * parts)))) if parts > 1 else []
    ranges = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="number", outputCol="bucket",
                        handleInvalid="keep") if inner else None

    def bucketed(df):
        df = df.withColumn("number", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan"))))
        if ranges is None:
            return df.withColumn("bucket", F.when(F.isnan("number"), 0.0).otherwise(1.0)).drop("number")
        # null ids, kept in a range of their own, come last
        return ranges.transform(df).withColumn(
            "bucket", F.when(F.isnan("number"), -1.0).otherwise(F.col("bucket"))).drop("number")

    # one row per range
    heads = sorted(((r["bucket"], r["head"]) for r in bucketed(docs.select("doc_id")).groupBy("bucket").agg(
        F.max("doc_id").alias("head")).collect()), reverse=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    after = docs.sparkSession.createDataFrame(
        [(heads[(k + 1) % len(heads)][1], bucket) for k, (bucket, _) in enumerate(heads)],
        f"head {kind}, bucket double")
    first = rows.join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("head"))).withColumn("extra", F.lit(1))
    names = ["bucket", "extra", "doc_id", "text", "tie"]
    every = bucketed(rows).withColumn("extra", F.lit(0)).select(names).unionByName(first.select(names))
    return every.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "extra", F.col("doc_id").desc_nulls_last(), "tie")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness."""
    rows = with_next(docs, parts or wide(docs))
    kind = docs.schema["doc_id"].dataType

    def sign(records):
        signer = Signer()
        kept = None  # bucket, doc_id, text, signatures of the row that waits for its next
        for batch in batches(records, 500):
            out = ([], [], [], [], [], [], [])
            buckets, extras, ids = (batch.column(k).to_pylist() for k in range(3))
            for bucket, extra, doc, data in zip(buckets, extras, ids, utf8(batch.column(3))):
                text = data.decode()
                own = signer.signatures(data)
                if kept is not None:
                    half = len(kept[2]) // 2
                    edited = (kept[2][: len(kept[2]) - half] + text[:half]).encode()
                    changed = signer.signatures(edited)
                    for values, value in zip(out, (
                            kept[1], len(kept[2]), hashlib.sha256(edited).hexdigest(), written(kept[3]),
                            written(changed), pruned_jaccard(kept[3], changed), pruned_jaccard(kept[3], own))):
                        values.append(value)
                kept = None if extra else (bucket, doc, text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.schema.field(2).type), pa.array(out[1], pa.int64()),
                 *(pa.array(v, pa.string()) for v in out[2:5]), *(pa.array(v, pa.float64()) for v in out[5:])],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(
        sign, f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")


def signature_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted signatures of each whole text."""

    def sign(records):
        signer = Signer()
        for batch in batches(records, 500):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([signer.signatures(t).astype(np.int64) for t in utf8(batch.column(1))],
                                           pa.list_(pa.int64()))], ["doc_id", "signatures"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole(docs).mapInArrow(sign, f"doc_id {kind}, signatures array<bigint>")


def similar_sets(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs of different signature sets with at least `threshold` likeness, and the documents of each set.

    Sets are grouped by length so that a set's partners are in its own group or the next; within a
    group they meet on their rarest signatures only, as many as a partner could not lack.
    """
    sets = stored(signature_sets(docs).where(F.size("signatures") > 0)
                  .withColumn("set_id", F.xxhash64("signatures", F.lit(1))))
    members = sets.select("set_id", "doc_id")
    each = stored(sets.groupBy("set_id").agg(F.first("signatures").alias("signatures")))
    flat = each.select("set_id", F.size("signatures").alias("n"), F.explode("signatures").alias("signature"))
    count = flat.groupBy("signature").agg(F.count("*").alias("df")).where("df > 1")
    # signatures that no other set has can't bring sets together, but they take up their share of the prefix
    ranked = flat.join(count, "signature", "left").withColumn("rank", F.row_number().over(
        Window.partitionBy("set_id").orderBy(F.coalesce("df", F.lit(0)), "signature")))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    group = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(threshold)))
    keys = ranked.where((F.col("rank") <= prefix) & F.col("df").isNotNull()).select(
        "signature", "set_id", "n", group.alias("group"))
    right = keys.select("signature", F.col("set_id").alias("other"), F.col("n").alias("m"),
                        F.explode(F.array("group", F.col("group") - 1)).alias("group"))
    met = keys.join(right, ["signature", "group"]).where(
        ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("set_id") < F.col("other"))))
        & (F.col("n") >= F.col("m") * threshold)).select("set_id", "other").distinct()
    a = each.select("set_id", F.col("signatures").alias("a"))
    b = each.select(F.col("set_id").alias("other"), F.col("signatures").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    likeness = common / (F.size("a") + F.size("b") - common)
    pairs = met.join(a, "set_id").join(b, "other").select("set_id", "other", likeness.alias("likeness")).where(
        F.col("likeness") >= threshold)
    return pairs, members
