"""Listings of the mapping, indexes and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.config import NONE_ID


def shown_id(x: Column) -> Column:
    return F.when(x == NONE_ID, F.lit("---")).otherwise(x.cast("string"))


def recordings_of(mapping: DataFrame, credit: int) -> DataFrame:
    rows = mapping.filter((F.col("artist_credit_id") == credit) | (F.col("release_artist_credit_id") == credit))
    return rows.select("recording_id", "recording_name").distinct().orderBy("recording_name", "recording_id")


def releases_of(mapping: DataFrame, credit: int) -> DataFrame:
    rows = mapping.filter((F.col("artist_credit_id") == credit) | (F.col("release_artist_credit_id") == credit))
    return rows.select("release_id", "release_name").distinct().orderBy("release_name", "release_id")


def index_texts(docs: DataFrame, index_id: int) -> DataFrame:
    return docs.filter(F.col("index_id") == index_id).select("pos", "entity_id", "text").orderBy("text", "pos")


def links_of(links: DataFrame, block: int, *, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of one block's links, ids for none shown as dashes."""
    rows = links.filter(F.col("block") == block).orderBy("recording_pos", "release_id", "recording_id", "release_pos").offset(offset)
    rows = rows if limit is None else rows.limit(limit)
    return rows.select("recording_pos", "recording_id", "release_pos", shown_id(F.col("release_id")).alias("release"), "score")


def one_link_per_release(links: DataFrame) -> DataFrame:
    """For each collection of a block the link of the best score."""
    return links.groupBy("block", "release_pos").agg(F.min(F.struct("score", "release_id", "recording_pos")).alias("x")).select("block", "release_pos", "x.*")


def credit_name(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("artist_credit_id").agg(F.min("artist_credit_name").alias("artist_credit_name"))


def credits_per_artist(artist_credit_name: DataFrame) -> DataFrame:
    """Creators with several credits."""
    return artist_credit_name.groupBy("artist").agg(F.array_sort(F.collect_set("artist_credit")).alias("credits")).filter(F.size("credits") > 1)


def link_counts(links: DataFrame) -> DataFrame:
    """How many links each block has."""
    return links.groupBy("block").agg(F.count(F.lit(1)).alias("n"))


def row_counts(relations: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several relations, empty ones included; one small row each."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in relations.items()]
    return reduce(DataFrame.unionByName, counts)
