"""License scan over a positional index of rare license words; DataFrame expressions only.

Every template is a run of words with one mandatory key phrase. A file's license words (template words
that are no function words or numbers) are indexed with their positions and the words around them. The
words of a template that have the highest inverse document frequency over the corpus are looked up,
their positions shifted to the template's start and intersected; an alignment holds when all looked-up
words meet there and the key phrase stands in the file at its place, word by word. The score of an
alignment is the share of the template's weight found around it.

A phrase occurs only where its rarest words do, so the look-up loses none. Files are never cut; a row
of the index holds a bounded number of neighbouring words.

Defined results: null and empty texts have no words, labels or places and score 0; repeated rows and
null ids stay rows of their own; several places are counted each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.common import stored, whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FUNCTION_WORDS = frozenset(
    "a an and any are as at be by for free from in into is it no not of on or that the this to under use with without"
    .split())
LOOKED_UP = 3
COVERED = 0.6
BEFORE, AFTER = 24, 24


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False


BASE = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
)
TEMPLATES = (
    *BASE,
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy",
             "permission is hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2", "licensed under the apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("gpl-2", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3", "gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mpl-2", "mozilla public license version 2", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "permission to use copy modify and or distribute"),
    Template("unlicense", "free and unencumbered software released into the public domain",
             "unencumbered software released into the public domain"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    Template("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
)


def license_words(text: str) -> list[tuple[int, str]]:
    return [(i, w) for i, w in enumerate(text.split()) if w not in FUNCTION_WORDS and not w.isdigit()]


def _anchor_table(spark, templates) -> DataFrame:
    rows = []
    for number, t in enumerate(templates):
        own = f" {t.text} "
        if f" {t.key} " not in own:
            raise ValueError(f"the key phrase of {t.label} is no part of its template")
        offset = own[: own.index(f" {t.key} ")].count(" ")
        if not license_words(t.key) or len(t.text.split()) > min(BEFORE, AFTER):
            raise ValueError(f"the template of {t.label} has no license word in its key phrase, or is too long")
        span = range(offset, offset + len(t.key.split()))
        rows += [(number, t.label, t.base, at, word, at in span, offset, t.key) for at, word in license_words(t.text)]
    return spark.createDataFrame(
        rows, "template int, label string, base boolean, at int, word string, in_key boolean, offset int, key string")


def license_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """row, doc_id, n_words, pos, word, around, first: a row per license word, and one per file with word null.

    `around` holds the lower-cased words from position `first` on.
    """
    cut = whole(docs).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.split("text", SEPARATORS).alias("parts"))
    lead = (F.element_at("parts", 1) == "").cast("int")
    tail = (F.element_at("parts", -1) == "").cast("int")
    sized = cut.select("row", "doc_id", "parts", lead.alias("lead"),
                       F.greatest(F.lit(0), F.size("parts") - lead - tail).cast("bigint").alias("n_words"))
    each = sized.select("row", "doc_id", "n_words", "lead", "parts", F.posexplode("parts").alias("at", "part"))
    wanted = F.lower("part").isin(vocabulary)  # translate, not lower, decides; this is the cheap filter
    word = F.when(wanted, F.translate("part", UPPER, LOWER))
    begin = F.greatest(F.lit(0), F.col("at") - BEFORE)
    return each.where((F.col("at") == 0) | wanted).select(
        "row", "doc_id", "n_words", (F.col("at") - F.col("lead")).alias("pos"),
        F.when(word.isin(vocabulary), word).alias("word"), (F.col("at") == 0).alias("head"),
        F.when(wanted, F.translate(F.array_join(F.slice("parts", begin + 1, BEFORE + AFTER), " "), UPPER, LOWER))
        .alias("around"),
        (begin - F.col("lead")).alias("first"))


def license_places(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """Files (row, doc_id, n_words) and verified alignments (row, label, base, start, coverage)."""
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for _, w in license_words(t.text)})
    index = stored(license_index(docs, vocabulary))
    files = index.where("head").select("row", "doc_id", "n_words")
    hits = index.where("word is not null")
    frequency = hits.groupBy("row", "word").agg(F.lit(1).alias("n")).groupBy("word").agg(F.count("*").alias("df"))
    total = files.count()  # one number, from the stored index
    # tables of templates and of the vocabulary: fixed in size by the templates
    weight = F.log(F.lit(total + 1.0) / (F.coalesce("df", F.lit(0)) + 0.5))
    anchors = (
        _anchor_table(spark, templates).join(F.broadcast(frequency), "word", "left")
        .withColumn("weight", F.greatest(weight, F.lit(1e-3)))
        .withColumn("rank", F.row_number().over(
            Window.partitionBy("template", "in_key").orderBy(F.desc("weight"), "at")))
        .withColumn("rare", F.col("in_key") & (F.col("rank") <= LOOKED_UP))
        .withColumn("n_rare", F.sum(F.col("rare").cast("int")).over(Window.partitionBy("template")))
        .withColumn("all_weight", F.sum("weight").over(Window.partitionBy("template"))))
    aligned = (
        hits.join(F.broadcast(anchors), "word")
        .withColumn("start", F.col("pos") - F.col("at"))
        .groupBy("row", "template", "start").agg(
            F.first("label").alias("label"), F.first("base").alias("base"), F.first("offset").alias("offset"),
            F.first("key").alias("key"), F.sum(F.col("rare").cast("int")).alias("met"),
            F.first("n_rare").alias("n_rare"), (F.sum("weight") / F.first("all_weight")).alias("coverage"),
            # the neighbourhood of the first rare word that met here
            F.min(F.when(F.col("rare"), F.struct("pos", "first", "around"))).alias("seen")))
    met = aligned.where(F.col("met") == F.col("n_rare")).withColumn("begin", F.col("start") + F.col("offset"))
    near = F.split("seen.around", " ")
    width = F.size(F.split("key", " "))
    at = F.col("begin") - F.col("seen.first") + 1
    checked = met.where(
        (F.col("begin") >= 0) & (at >= 1) & (F.array_join(F.slice(near, F.greatest(at, F.lit(1)), width), " ")
                                             == F.col("key")))
    return files, checked.select("row", "label", "base", F.col("begin").cast("bigint").alias("start"),
                                 F.least("coverage", F.lit(1.0)).alias("coverage"))


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Counts, places, labels and score of every file."""
    files, places = license_places(docs, templates)
    kept = places.where(F.col("base") | (F.col("coverage") >= COVERED))
    of_base = lambda value: F.when(F.col("base"), value)
    found = kept.groupBy("row").agg(
        F.count(of_base(F.lit(1))).alias("n_base"), F.min(of_base(F.col("start"))).alias("first_word"),
        F.max(of_base(F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(of_base(F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"))
    return files.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
