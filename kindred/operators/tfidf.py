"""Blocked TF-IDF over character trigrams: many small indexes as one table.

Documents are rows (index_id, pos, entity_id, text).  All statistics are keyed
by index_id, so one job fits every index at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import trigrams, truncate

KEY = "index_id"


@dataclass(frozen=True)
class Vectorizer:
    """binary: a gram counts once; sublinear: 1 + ln(tf); use_idf: else all weights are 1 before the norm; norm: l2, l1 or none; max_features: keep so many grams with the largest idf."""

    binary: bool = False
    use_idf: bool = True
    sublinear: bool = False
    norm: str = "l2"
    max_features: int | None = None


def gram_counts(docs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, gram, tf) of the texts' indexed prefixes, counted inside each row: ``by`` names one row, so nothing is shuffled."""
    grams = docs.select(*by, trigrams(truncate(F.col("text"))).alias("grams"))
    each = grams.withColumn("unlike", F.array_distinct("grams")).select(*by, F.when(F.size("grams") > F.size("unlike"), F.col("grams")).alias("grams"), F.explode("unlike").alias("gram"))
    times = F.when(F.col("grams").isNull(), F.lit(1)).otherwise(F.size(F.filter("grams", lambda g: g == F.col("gram"))))
    return each.select(*by, "gram", times.cast("long").alias("tf"))


def classes(docs: DataFrame) -> DataFrame:
    """(index_id, pos, text, copies): the indexed prefixes, each at its first position, and how many documents have it."""
    return docs.groupBy(KEY, truncate(F.col("text")).alias("text")).agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("copies"))


def class_counts(rows: DataFrame) -> DataFrame:
    """``gram_counts`` of ``classes``, with ``copies``."""
    return gram_counts(rows, [KEY, "pos", "copies"])


def index_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, how: Vectorizer = Vectorizer(), counts: DataFrame | None = None) -> DataFrame:
    """Vocabulary: (index_id, gram, df, idf).  ``counts``: of the documents, or of their classes."""
    counts = gram_counts(docs, [KEY, "pos"]) if counts is None else counts
    df = F.sum("copies") if "copies" in counts.columns else F.count(F.lit(1))
    vocabulary = counts.groupBy(KEY, "gram").agg(df.alias("df")).join(index_sizes(docs), KEY)
    vocabulary = vocabulary.select(KEY, "gram", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    if how.max_features is not None:
        order = Window.partitionBy(KEY).orderBy(F.desc("idf"), F.desc("gram"))
        vocabulary = vocabulary.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= how.max_features).drop("k")
    return vocabulary


def _raw(how: Vectorizer, length: Column) -> Column:
    tf = F.lit(1.0) if how.binary else F.col("tf") / length
    if how.sublinear:
        tf = 1 + F.log(tf)
    return tf * F.col("idf") if how.use_idf else F.lit(1.0)


def weigh(counts: DataFrame, vocabulary: DataFrame, by: list[str], how: Vectorizer = Vectorizer(), *, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*by, gram, *keep, w), normalised for each ``by``; grams outside the vocabulary drop out before the norm."""
    own = Window.partitionBy(*by)
    # a text's length cancels under a norm unless tf is sublinear
    needed = not how.binary and (how.sublinear or how.norm == "none")
    counts = counts.withColumn("length", F.sum("tf").over(own) if needed else F.lit(1.0))
    rows = counts.join(vocabulary.select(KEY, "gram", "idf"), [KEY, "gram"]).withColumn("raw", _raw(how, F.col("length")))
    if how.norm == "none":
        return rows.select(*by, "gram", *keep, F.col("raw").alias("w"))
    size = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(own)) if how.norm == "l2" else F.sum(F.abs("raw")).over(own)
    return rows.withColumn("size", size).select(*by, "gram", *keep, F.when(F.col("size") == 0, 0.0).otherwise(F.col("raw") / F.col("size")).alias("w"))


def build(docs: DataFrame, how: Vectorizer = Vectorizer()) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, weights) of all indexes; empty in, empty out."""
    counts = gram_counts(docs, [KEY, "pos"])
    vocabulary = fit(docs, how, counts)
    return vocabulary, weigh(counts, vocabulary, [KEY, "pos"], how)
