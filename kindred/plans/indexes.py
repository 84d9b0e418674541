"""Index documents and links.

One table of documents (index_id, pos, entity_id, text) holds all indexes:
-1 single creators, -2 joint credits, -3 names without letters, and for each
block (a credit id) 2 * id for its items and 2 * id + 1 for its collections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.config import MULTIPLE, SINGLE, SYMBOLS
from kindred.functions.text import byte_view, encode_name, encode_symbols, is_transliterated, joined_sort_names
from kindred.sources.scratch import stored


def items_index(block: Column) -> Column:
    return block * 2


def collections_index(block: Column) -> Column:
    return block * 2 + 1


def credit_names(artist_credit: DataFrame, artist_credit_name: DataFrame, artist: DataFrame, *, min_artist: int = 1) -> DataFrame:
    """(id, name, artist_count, sort_name): credits with their creators' sort names and join phrases in order."""
    rows = artist_credit.alias("ac").join(artist_credit_name.alias("acn"), F.col("ac.id") == F.col("acn.artist_credit")).join(artist.alias("a"), F.col("acn.artist") == F.col("a.id")).filter(F.col("a.id") > min_artist)
    parts = F.array_sort(F.collect_list(F.struct("acn.position", "a.sort_name", "acn.join_phrase")))
    grouped = rows.groupBy("ac.id", "ac.name", "ac.artist_count").agg(parts.alias("p"))
    return grouped.select("id", "name", "artist_count", joined_sort_names(F.transform("p", lambda x: x["sort_name"]), F.transform("p", lambda x: x["join_phrase"])).alias("sort_name"))


def _with_transliterations(credits: DataFrame) -> DataFrame:
    names = credits.select("id", "name")
    return names.unionByName(credits.filter(is_transliterated(F.col("name"), F.col("sort_name"))).select("id", F.col("sort_name").alias("name")))


def _placed(docs: DataFrame) -> DataFrame:
    """Positions by entity and text.  One index may hold most rows, so they are sorted by range and numbered by each range's offset."""
    order = ["index_id", "entity_id", "text"]
    rows = docs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "placed")
    parts = rows.groupBy("index_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # as many rows as partitions, or a few more
    before = Window.partitionBy("index_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("index_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(parts), ["index_id", "part"]).select("index_id", (F.col("at") + F.col("shift")).alias("pos"), "entity_id", "text")


def creator_docs(credits: DataFrame, aliases: DataFrame) -> DataFrame:
    """Documents of the three creator indexes; credits as from ``credit_names``, aliases (id, name) of single creators.

    A single name without letters or digits goes to the symbols index, in bytes.
    """
    single = _with_transliterations(credits.filter("artist_count = 1")).select("id", encode_name(F.col("name")).alias("text"), encode_symbols(F.col("name")).alias("symbols"), F.lit(False).alias("alias"))
    named = aliases.select("id", encode_name(F.col("name")).alias("text"), F.lit("").alias("symbols"), F.lit(True).alias("alias")).filter("text <> ''")
    single = single.unionByName(named)
    odd = (F.col("text") == "") & (F.col("symbols") != "")
    joint = _with_transliterations(credits.filter("artist_count > 1")).select("id", encode_name(F.col("name")).alias("text")).filter("text <> ''")
    rows = single.select(F.when(odd, SYMBOLS).otherwise(SINGLE).cast("long").alias("index_id"), F.col("id").alias("entity_id"), F.when(odd, byte_view(F.col("symbols"))).otherwise(F.col("text")).alias("text")).distinct()
    return _placed(rows.unionByName(joint.select(F.lit(MULTIPLE).cast("long").alias("index_id"), F.col("id").alias("entity_id"), "text")))


def block_rows(mapping: DataFrame) -> DataFrame:
    """Each mapping row in the block of its credit and in that of its collection's credit, with encoded names; items that encode to nothing drop out."""
    blocks = F.explode(F.array_distinct(F.array("artist_credit_id", "release_artist_credit_id"))).alias("block")
    rows = mapping.select(blocks, "score", "release_id", "recording_id", encode_name(F.col("release_name")).alias("release_text"), encode_name(F.col("recording_name")).alias("recording_text"))
    return rows.filter("recording_text <> ''")


def _first_seen(rows: DataFrame, entity: str, text: str) -> DataFrame:
    """(block, pos, entity_id, text): distinct texts in the order in which they first appear, with the entity of that row."""
    order = F.struct("score", "release_id", "recording_id")
    seen = rows.groupBy("block", F.col(text).alias("text")).agg(F.min(order).alias("at"))
    pos = F.row_number().over(Window.partitionBy("block").orderBy("at", "text")).cast("long") - 1
    return seen.select("block", pos.alias("pos"), F.col(f"at.{entity}").alias("entity_id"), "text")


def first_seen_recordings(rows: DataFrame) -> DataFrame:
    return _first_seen(rows, "recording_id", "recording_text")


def first_seen_releases(rows: DataFrame) -> DataFrame:
    return _first_seen(rows, "release_id", "release_text")


def links(rows: DataFrame, recordings: DataFrame, releases: DataFrame) -> DataFrame:
    """(block, recording_pos, recording_id, release_pos, release_id, score): which item is on which collection."""
    r = recordings.select("block", F.col("text").alias("recording_text"), F.col("pos").alias("recording_pos"))
    l = releases.select("block", F.col("text").alias("release_text"), F.col("pos").alias("release_pos"))
    return rows.join(r, ["block", "recording_text"]).join(l, ["block", "release_text"]).select("block", "recording_pos", "recording_id", "release_pos", "release_id", "score").distinct()


def add_aliases(recordings: DataFrame, linked: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases (recording_id, name) of first-seen items, unless their text is an item's own already; they take over the item's links."""
    named = aliases.select(F.col("recording_id").alias("entity_id"), encode_name(F.col("name")).alias("text")).filter("text <> ''").distinct()
    new = recordings.select("block", F.col("pos").alias("of"), "entity_id").join(named, "entity_id").join(recordings.select("block", "text"), ["block", "text"], "left_anti")
    size = recordings.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("of", "text")).cast("long") - 1
    new = new.withColumn("k", place).join(size, "block").select("block", (F.col("size") + F.col("k")).alias("pos"), "entity_id", "text", "of")
    taken = new.select("block", F.col("of").alias("recording_pos"), F.col("pos").alias("alias_pos")).join(linked, ["block", "recording_pos"])
    taken = taken.select("block", F.col("alias_pos").alias("recording_pos"), "recording_id", "release_pos", "release_id", "score")
    return recordings.unionByName(new.drop("of")), linked.unionByName(taken)


def block_docs(mapping: DataFrame, aliases: DataFrame | None = None, *, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Index documents of all blocks, and their links; ``rows``: the mapping's ``block_rows`` if they are stored."""
    rows = block_rows(mapping) if rows is None else rows
    recordings, releases = first_seen_recordings(rows), first_seen_releases(rows)
    linked = links(rows, recordings, releases)
    if aliases is not None:
        recordings, linked = add_aliases(recordings, linked, aliases)
    docs = recordings.select(items_index(F.col("block")).alias("index_id"), "pos", "entity_id", "text").unionByName(releases.select(collections_index(F.col("block")).alias("index_id"), "pos", "entity_id", "text"))
    return docs, linked
