"""Cleans a corpus and packs it: toxicity, near copies, repeated passages, benchmark passages, sequences.

Every stage takes (spark, docs, sf_dir) and works on what the stage before it kept. Stages but the last
return the columns of `documents` that the input has; columns of other names are left out, so they can't
clash with what a stage computes. Null texts come out empty. `docs` is read more than once and has to
give its rows in the same order each time, as tables read from files do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.llm import ngram_join, packing, positional_index, suffix_dedup, toxicity
from flowsift.llm.common import stored
from flowsift.llm.queries import WORD_BPE, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.7

# some stages have no SQL: models, suffix order, token ids
ORACLE_SQL = None


def _others(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS[2:] if c in docs.columns]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the network is trained on labelled documents of `docs`."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, net, *_others(docs))
    return scored.where(F.col("score") < TOXIC).drop("score")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near copies."""
    links = ngram_join.ngram_links(docs)
    rows = ngram_join.numbered(docs, *_others(docs))
    return rows.join(links.where(~F.col("first")).select("row"), "row", "left_anti").drop("row")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that occur earlier; texts of nothing else go."""
    found = suffix_dedup.kept_texts(docs, *_others(docs))
    kept = found.where((F.col("text") != "") | ~F.col("cut")).drop("cut")
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in kept.columns else kept


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    rows = ngram_join.numbered(docs, *_others(docs))
    found = positional_index.contamination(
        rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    marked = found.where(positional_index.contaminated()).select(F.col("doc_id").alias("row"))
    return rows.join(marked, "row", "left_anti").drop("row")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.packed(docs, WORD_BPE)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_copies),
    ("suffix_array_dedup", remove_repeated_passages),
    ("benchmark_decontamination", remove_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
