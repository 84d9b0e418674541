"""The canonical mapping: one row per (creator credit, collection, item)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.config import NONE_ID


def _ordered(value: str, by: str):
    """All values in the order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col(value).alias("v")))), lambda x: x["v"])


def canonical_rows(support: DataFrame, recording: DataFrame, release: DataFrame, artist_credit_name: DataFrame, artist: DataFrame, *, min_credit: int = 1) -> DataFrame:
    """Canonical data with internal ids; credited creators' sort names in credit order."""
    s = support.alias("s")
    rows = (
        s.join(recording.alias("r"), F.col("s.recording_mbid") == F.col("r.gid"))
        .join(release.alias("rl"), F.col("s.release_mbid") == F.col("rl.gid"))
        .join(artist_credit_name.alias("acn"), F.col("s.artist_credit_id") == F.col("acn.artist_credit"))
        .join(artist.alias("a"), F.col("acn.artist") == F.col("a.id"))
        .filter(F.col("s.artist_credit_id") > min_credit)
    )
    keys = [
        F.col("s.artist_credit_id"), F.array_join("s.artist_mbids", ",").alias("artist_mbids"), F.col("s.artist_credit_name"), F.col("rl.id").alias("release_id"), F.col("s.release_mbid"),
        F.col("rl.artist_credit").alias("release_artist_credit_id"), F.col("s.release_name"), F.col("r.id").alias("recording_id"), F.col("s.recording_mbid"), F.col("s.recording_name"), F.col("s.score").cast("long").alias("score"),
    ]
    rows = rows.select(*keys, "acn.position", "a.sort_name")
    names = [c for c in rows.columns if c not in ("position", "sort_name")]
    return rows.groupBy(*names).agg(F.element_at(_ordered("sort_name", "position"), 1).alias("artist_credit_sortname"))


def standalone_rows(recording: DataFrame, track: DataFrame, artist_credit_name: DataFrame, artist: DataFrame) -> DataFrame:
    """Items on no collection; one row for each credited name."""
    alone = recording.join(track, recording["id"] == track["recording"], "left_anti").alias("r")
    rows = alone.join(artist_credit_name.alias("acn"), F.col("r.artist_credit") == F.col("acn.artist_credit")).join(artist.alias("a"), F.col("acn.artist") == F.col("a.id"))
    rows = rows.select(F.col("r.artist_credit").alias("artist_credit_id"), F.col("acn.name").alias("artist_credit_name"), F.col("r.id").alias("recording_id"), F.col("r.gid").alias("recording_mbid"), F.col("r.name").alias("recording_name"), "acn.position", "a.gid", "a.sort_name")
    keys = ["artist_credit_id", "artist_credit_name", "recording_id", "recording_mbid", "recording_name"]
    grouped = rows.groupBy(*keys).agg(F.array_join(_ordered("gid", "position"), ",").alias("artist_mbids"), F.element_at(_ordered("sort_name", "position"), 1).alias("artist_credit_sortname"))
    return grouped.select(
        "*", F.lit(NONE_ID).alias("release_id"), F.lit("").alias("release_mbid"), F.lit(NONE_ID).alias("release_artist_credit_id"), F.lit("").alias("release_name"), F.lit(NONE_ID).alias("score")
    )


def build_mapping(support: DataFrame, recording: DataFrame, release: DataFrame, artist_credit_name: DataFrame, artist: DataFrame, track: DataFrame, *, min_credit: int = 1) -> DataFrame:
    """Both.  Each is grouped, and only stand-alone rows have no collection, so there are no duplicates."""
    tied = canonical_rows(support, recording, release, artist_credit_name, artist, min_credit=min_credit)
    return tied.unionByName(standalone_rows(recording, track, artist_credit_name, artist))


def restrict(credits: DataFrame, mapping: DataFrame, key: str = "id") -> DataFrame:
    """Credits that the mapping holds."""
    return credits.join(mapping.select(F.col("artist_credit_id").alias(key)), key, "left_semi")


def pending(mapping: DataFrame, built: DataFrame, *, min_credit: int = 2) -> DataFrame:
    """Credits whose block is not built yet: (artist_credit_id, n)."""
    ids = mapping.select("artist_credit_id").distinct().filter(F.col("artist_credit_id") > min_credit)
    return ids.join(built.select(F.col("index_id").alias("artist_credit_id")), "artist_credit_id", "left_anti").groupBy("artist_credit_id").agg(F.count(F.lit(1)).alias("n"))
