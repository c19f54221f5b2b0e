"""Small corpora with the awkward cases, and plain versions of the word cuts."""

import re

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CHUNK = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("row", T.LongType()), T.StructField("score", T.StringType()), T.StructField("shard", T.StringType())])

PASSAGE = ("it was the third of the long winters and nobody in the valley could say when the river had last been "
           "free of ice nor who had seen the ferry move in it")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies, passages, license lines."""
    long = " ".join(f"w{k * k % 997} the {k % 89}" for k in range(20_000))
    texts = [
        (1, PASSAGE), (2, PASSAGE), (3, PASSAGE + " and more"), (4, None), (5, ""), (6, " \n\t "), (7, "..., !"),
        (8, "one"), (9, "One"), (10, long), (11, long + " tail"), (12, "é" * 150 + " Über " + "日本語" * 60),
        (13, "Licensed under the Apache License, Version 2.0. Released UNDER the MIT-License; cc/by/nc CC BY NC"),
        (14, "the the the the"), (15, "it's <|endoftext|> we'll 12 ﬁ"), (None, PASSAGE), (None, None), (16, PASSAGE[:99]),
        (17, "x" * 100), (18, "x" * 350), (19, "a b c d e f g h i j k l m n o p"), (19, "a b c d e f g h i j k l m n o p"),
        (19, "same id other text"), (2, PASSAGE)]
    return [(i, t, "en", "s", None if t is None else len(t), 7, "9", None) for i, t in texts]


def corpus(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def stored_corpus(spark, tmp_path_factory):
    """The corpus as a table read from files."""
    folder = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    corpus(spark).write.parquet(folder)
    return spark.read.parquet(folder)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
