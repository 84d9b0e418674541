"""Blocked fuzzy search: cosine top-k with a threshold, then an edit-distance re-rank of long texts.

Queries (q, index_id, text) meet documents of the same index, one part of it in a
task (``cosine``), so blocking is one shuffle and nothing of a pair but a hit leaves
the task.

Candidates share one of the query's rarest grams: with unit vectors, grams whose
own norm stays under the threshold can't reach it alone, so only the others are
looked up.  Each distinct text of an index is searched once, and documents that
share their indexed prefix are compared once, at the first one's position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.distance import distance_confidence
from kindred.functions.text import PREFIX, truncate
from kindred.sources.scratch import stored

from . import tfidf
from .cosine import part_of, products

THRESHOLD = 0.7
K, MAX_K = 10, 1000
#: Confidences are rounded to so many digits.
DIGITS = 6


@dataclass(frozen=True)
class Index:
    """Documents (index_id, pos, entity_id, text) with their vocabulary and weights; of documents that share their indexed prefix one has weights at least.

    Without both, each search weighs the documents itself, which costs less where an index is searched once.
    """

    docs: DataFrame
    vocabulary: DataFrame | None = None
    weights: DataFrame | None = None
    #: No vector is longer than 1 (else all grams are looked up).
    unit: bool = True


def build_index(docs: DataFrame, how: tfidf.Vectorizer = tfidf.Vectorizer()) -> Index:
    counts = tfidf.class_counts(tfidf.classes(docs))
    vocabulary = tfidf.fit(docs, how, counts)
    return Index(docs, vocabulary, tfidf.weigh(counts, vocabulary, [tfidf.KEY, "pos"], how), how.norm != "none")


def _cosine(texts: DataFrame, index: Index, threshold: float, *, least: float | None = None) -> DataFrame:
    """(index_id, query, pos, confidence) of the texts (index_id, query); all pairs that reach the threshold, perhaps others.  ``least``: none much below."""
    reach = threshold - 2 * 10**-DIGITS if index.unit and threshold > 0 else 0.0
    least = None if least is None else least - 10**-DIGITS
    parts = lambda docs: docs.select(tfidf.KEY, part_of(F.col("pos")).alias("part")).filter("part <> 0").distinct()
    if index.weights is not None:
        found = products(texts, parts(index.docs), index.vocabulary, reach, least, weights=index.weights)
    else:
        classes = stored(tfidf.classes(index.docs), "classes", tidy=True)
        others = parts(classes)
        vocabulary = None
        if others.head(1):  # the grams of an index of several parts are counted over all of them
            large = others.select(tfidf.KEY).distinct()
            counts = tfidf.class_counts(classes.join(large, tfidf.KEY, "left_semi"))
            vocabulary = stored(tfidf.fit(index.docs.join(large, tfidf.KEY, "left_semi"), counts=counts), "vocabulary", tidy=True)
        found = products(texts, others, vocabulary, reach, least, classes=classes)
    return found.withColumn("confidence", F.round("confidence", DIGITS))


def kept(perfect: Column) -> Column:
    """How many hits stay: k grows by K while all of them are perfect, up to MAX_K."""
    return F.least(F.lit(MAX_K), K * (F.floor(perfect / K) + 1))


def _expanded(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(index_id, query, confidence, kept, pos, entity_id, text): the documents of the classes found, those that may be among the ``kept`` best."""
    same = [tfidf.KEY, "prefix"]
    prefixed = docs.withColumn("prefix", truncate(F.col("text")))
    found = found.join(prefixed.select(tfidf.KEY, "pos", "prefix"), [tfidf.KEY, "pos"])
    found = found.groupBy(*same, "query").agg(F.max("confidence").alias("confidence"))
    reached = prefixed.join(found.select(*same), same, "left_semi")
    own = Window.partitionBy(tfidf.KEY, "query")
    found = found.join(reached.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")), same)
    found = found.withColumn("kept", kept(F.sum(F.when(F.col("confidence") >= 1, F.col("copies")).otherwise(0)).over(own)))
    # a class whose betters fill the places has none; of a class, the first MAX_K at most
    better = F.sum("copies").over(own.orderBy(F.desc("confidence"))) - F.sum("copies").over(Window.partitionBy(tfidf.KEY, "query", "confidence"))
    found = found.withColumn("better", better).filter(F.col("better") < F.col("kept")).drop("better", "copies")
    first = F.row_number().over(Window.partitionBy(*same).orderBy("pos"))
    members = reached.withColumn("nth", first).filter(F.col("nth") <= MAX_K).select(*same, "pos", "entity_id", "text")
    return found.join(members, same).drop("prefix")


def search(queries: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """(q, index_id, pos, entity_id, text, confidence, rank): hits of at least the threshold, best first, ties by position."""
    own = Window.partitionBy(tfidf.KEY, "query")
    best = own.orderBy(F.desc("confidence"), "pos")
    asked = queries.select("q", tfidf.KEY, F.col("text").alias("query"))
    found = _cosine(asked.select(tfidf.KEY, "query").distinct(), index, threshold, least=threshold).filter(F.col("confidence") >= threshold)
    rows = _expanded(stored(found, "found", tidy=True), index.docs)
    rows = rows.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= F.col("kept"))
    long = F.max(F.greatest(F.length("text"), F.length("query")) > PREFIX).over(own)
    rows = rows.withColumn("long", long).withColumn("confidence", F.when(F.col("long"), F.round(distance_confidence(F.col("query"), F.col("text")), DIGITS)).otherwise(F.col("confidence")))
    rows = rows.filter(F.col("confidence") >= threshold).withColumn("rank", F.row_number().over(best))
    return rows.join(asked, [tfidf.KEY, "query"]).select("q", tfidf.KEY, "pos", "entity_id", "text", "confidence", "rank")


def exact(docs: DataFrame, text: str) -> DataFrame:
    """Positions and entities whose indexed text is exactly this."""
    return docs.filter(F.col("text") == text).select(tfidf.KEY, "pos", "entity_id", "text")
