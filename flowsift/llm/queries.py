"""One query per corpus operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.llm import (
    embedding_links,
    language_model,
    license_scan,
    merkle,
    ngram_join,
    packing,
    periodic_runs,
    positional_index,
    sharding,
    spot_signatures,
    suffix_dedup,
    token_counts,
    toxicity,
    twins,
)

from flowsift.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


@query("op5_best_fit_packing")
def op5(spark, directory):
    return packing.packed(table(spark, directory, "documents"), WORD_BPE)


@query("op7_token_counts")
def op7(spark, directory):
    return token_counts.token_counts(table(spark, directory, "documents"), WORD_BPE)


@query("op9_decontamination")
def op9(spark, directory):
    found = positional_index.contamination(
        table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        positional_index.contaminated().alias("contaminated"))


@query("op4_balanced_sharding")
def op4(spark, directory):
    return sharding.balanced_shards(table(spark, directory, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op6_license_scan")
def op6(spark, directory):
    return license_scan.license_scan(table(spark, directory, "documents"))


@query("op2_spot_signatures")
def op2(spark, directory):
    return spot_signatures.fingerprints(table(spark, directory, "documents"))


@query("op3_suffix_dedup")
def op3(spark, directory):
    return suffix_dedup.dedup_digest(table(spark, directory, "documents"))


@query("op10_ngram_jaccard_join")
def op10(spark, directory):
    return ngram_join.ngram_links(table(spark, directory, "documents")).select("doc_id", "class_id", "n_links")


@query("op8_toxicity")
def op8(spark, directory):
    docs = table(spark, directory, "documents")
    scored = toxicity.scored(docs, toxicity.fit(docs, table(spark, directory, "labels")))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op1_lm_scoring")
def op1(spark, directory):
    words = language_model.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return language_model.language_scores(table(spark, directory, "documents"), words)


@query("op11_embedding_near_dedup", twins.EMBEDDING_LINKS)
def op11(spark, directory):
    return embedding_links.vector_links(table(spark, directory, "embeddings"))


@query("op12_periodic_runs")
def op12(spark, directory):
    return periodic_runs.run_digests(periodic_runs.with_repeated_tails(table(spark, directory, "documents")))


@query("op13_merkle_manifest", twins.MERKLE_MANIFEST)
def op13(spark, directory):
    return merkle.verified_rows(table(spark, directory, "documents"))
