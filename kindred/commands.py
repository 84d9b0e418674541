"""Command line: the mapping, the indexes and batches of requests as Spark jobs.

    spark-submit --py-files kindred.zip commands.py mapping --source DIR --out DIR/mapping
    spark-submit ... commands.py indexes --source DIR --mapping DIR/mapping --out DIR/index [--rebuild]
    spark-submit ... commands.py lookup --requests FILE --mapping DIR/mapping --index DIR/index --out DIR/answers

A source is a folder of Parquet tables or a JDBC url; ``SOURCE_URL`` and ``INDEX_DIR`` in a settings file (``--env``) or the environment are the defaults.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import Settings
from kindred.functions.text import parse_array_literal
from kindred.plans import indexes, lookup, mapping
from kindred.sources import scratch, tables
from kindred.streaming.serve import extend_blocks


def relation(spark: SparkSession, source: str, name: str) -> DataFrame:
    return tables.read_jdbc(spark, source, name) if source.startswith("jdbc:") else spark.read.parquet(f"{source.rstrip('/')}/{name}")


def build_mapping(spark: SparkSession, source: str, out: str) -> None:
    """Writes the fact table; refuses to replace one."""
    support = relation(spark, source, "support")
    if dict(support.dtypes)["artist_mbids"] == "string":
        support = support.withColumn("artist_mbids", parse_array_literal(F.col("artist_mbids")))
    others = (relation(spark, source, n) for n in ("recording", "release", "artist_credit_name", "artist", "track"))
    tables.write_mapping(tables.defaults(mapping.build_mapping(support, *others)), out)


def build_indexes(spark: SparkSession, source: str, facts: str, out: str, *, min_artist: int = 1, rebuild: bool = False) -> int:
    """The creator indexes, new each time, and the blocks that are not there yet (all with ``rebuild``); returns the number of blocks built."""
    rows = spark.read.parquet(facts)
    credits = mapping.restrict(relation(spark, source, "artist_credit"), rows)
    names = indexes.credit_names(credits, relation(spark, source, "artist_credit_name"), relation(spark, source, "artist"), min_artist=min_artist)
    aliases = mapping.restrict(relation(spark, source, "artist_alias"), rows)
    docs = scratch.stored(indexes.creator_docs(names, aliases), "creators")
    tables.save_index(tables.store_index(docs, scratch.path(spark, "creator-index")), f"{out}/creators", mode="overwrite")
    return extend_blocks(rows, f"{out}/blocks", relation(spark, source, "recording_alias"), rebuild=rebuild)


def load_engine(spark: SparkSession, facts: str, index: str) -> lookup.Engine:
    return lookup.Engine(spark.read.parquet(facts), tables.load_index(spark, f"{index}/creators"), tables.load_index(spark, f"{index}/blocks"), spark.read.parquet(f"{index}/blocks/links"))


def answer(spark: SparkSession, requests: str, facts: str, index: str, out: str, threshold: float, *, clean: bool = False) -> None:
    """Requests (req_id, artist, release, recording) to JSON rows; refuses to replace a folder."""
    tables.to_response(lookup.lookup(spark.read.parquet(requests), load_engine(spark, facts, index), threshold, clean=clean)).write.json(out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kindred")
    parser.add_argument("--env", help="settings file")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in (("mapping", ("source", "out")), ("indexes", ("source", "mapping", "out")), ("lookup", ("requests", "mapping", "index", "out"))):
        command = commands.add_parser(name)
        for option in options:
            command.add_argument(f"--{option}", required=option in ("mapping", "requests") or (option == "out" and name != "indexes"))
    commands.choices["indexes"].add_argument("--rebuild", action="store_true")
    commands.choices["lookup"].add_argument("--clean", action="store_true")
    args = parser.parse_args(argv)
    settings = Settings.load(args.env)
    spark = spark or SparkSession.builder.appName(f"kindred {args.command}").getOrCreate()
    if args.command == "mapping":
        build_mapping(spark, args.source or settings.source_url, args.out)
    elif args.command == "indexes":
        build_indexes(spark, args.source or settings.source_url, args.mapping, args.out or settings.index_dir, min_artist=settings.min_credit, rebuild=args.rebuild)
    else:
        answer(spark, args.requests, args.mapping, args.index or settings.index_dir, args.out, settings.threshold, clean=args.clean or settings.clean_names)


if __name__ == "__main__":
    main()
