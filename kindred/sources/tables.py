"""Sources and sinks: JDBC, CSV, Parquet index tables, JSON responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from kindred.functions.text import null_to_default
from kindred.operators.fuzzy import Index
from kindred.operators.tfidf import KEY, Vectorizer, class_counts, classes, fit, weigh

from .scratch import release

FETCH_ROWS = 25_000

MAPPING = T.StructType(
    [
        T.StructField("artist_credit_id", T.LongType(), False),
        T.StructField("artist_mbids", T.StringType(), False),
        T.StructField("artist_credit_name", T.StringType(), False),
        T.StructField("artist_credit_sortname", T.StringType()),
        T.StructField("release_id", T.LongType(), False),
        T.StructField("release_mbid", T.StringType(), False),
        T.StructField("release_artist_credit_id", T.LongType(), False),
        T.StructField("release_name", T.StringType()),
        T.StructField("recording_id", T.LongType(), False),
        T.StructField("recording_mbid", T.StringType(), False),
        T.StructField("recording_name", T.StringType()),
        T.StructField("score", T.LongType(), False),
    ]
)


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None, bounds: tuple[int, int] = (0, 1), partitions: int = 1) -> DataFrame:
    """A table of an external database, read in batches and, with a partition column, in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", FETCH_ROWS)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def defaults(df: DataFrame) -> DataFrame:
    """Null numbers become 0 and null texts empty."""
    return df.select(*(null_to_default(F.col(f.name), f.dataType.simpleString()).alias(f.name) if isinstance(f.dataType, (T.StringType, T.NumericType)) else F.col(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str) -> None:
    """Header, quotes doubled; empty texts are written as ``""`` so that they differ from null.  Fails if the path exists."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = MAPPING) -> DataFrame:
    """Rows that fit the schema; others (wrong number of fields, bad or too large numbers) are dropped.  Line ends inside quotes are kept."""
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return spark.read.schema(loose).option("header", True).option("mode", "DROPMALFORMED").option("escape", '"').option("multiLine", True).csv(path)


def write_new(df: DataFrame, path: str, *, sort: list[str] | None = None, also: list[str] | None = None) -> None:
    """A new Parquet table; refuses to replace one.

    Sorted files let row-group statistics serve point lookups; columns in ``also`` get Bloom filters (or
    dictionaries), by which lookups in another order than the files' skip row groups too.
    """
    writer = (df.sortWithinPartitions(*sort) if sort else df).write.mode("errorifexists")
    for name in also or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{name}", "true")
    writer.parquet(path)


def write_mapping(mapping: DataFrame, path: str, buckets: int = 0) -> None:
    """The fact table, clustered by creator for block builds; Bloom filters serve lookups by the other ids."""
    rows = mapping.repartitionByRange(buckets, "artist_credit_id") if buckets else mapping.repartitionByRange("artist_credit_id")
    write_new(rows, path, sort=["artist_credit_id", "release_id", "recording_id"], also=["release_artist_credit_id", "release_id", "recording_id"])


def save_index(index: Index, path: str, *, mode: str = "errorifexists") -> None:
    """``overwrite`` rebuilds; ``append`` adds blocks that are not there yet."""
    for name, df in (("docs", index.docs), ("vocabulary", index.vocabulary), ("weights", index.weights)):
        df.write.mode(mode).parquet(f"{path}/{name}")


def store_index(docs: DataFrame, path: str, how: Vectorizer = Vectorizer()) -> Index:
    """Builds a new index at ``path`` from its stored parts, so that each is computed once and its shuffle files go before the next."""
    spark = docs.sparkSession

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        release(spark)
        return spark.read.parquet(f"{path}/{name}")

    docs = put(docs, "docs")
    counts = class_counts(put(classes(docs), "classes"))
    vocabulary = put(fit(docs, how, counts), "vocabulary")
    put(weigh(counts, vocabulary, [KEY, "pos"], how), "weights")
    return load_index(spark, path, how)


def load_index(spark: SparkSession, path: str, how: Vectorizer = Vectorizer()) -> Index:
    """``how``: as it was built."""
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "vocabulary", "weights")), how.norm != "none")


def has_index(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(f"{path}/docs")
    except AnalysisException:
        return False
    return True


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace all old rows of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def point(df: DataFrame, key: str, value: int) -> DataFrame:
    return df.filter(F.col(key) == value)


def of_pair(mapping: DataFrame, release_id: int, recording_id: int) -> DataFrame:
    """Rows of one collection and item; both equalities reach the scan."""
    return mapping.filter((F.col("release_id") == release_id) & (F.col("recording_id") == recording_id))


def to_response(matches: DataFrame) -> DataFrame:
    """(req_id, status, body): 400 without required arguments, 404 without a match, else 200 and the match as JSON."""
    fields = ["artist_credit_name", "artist_mbids", "release_name", "release_mbid", "recording_name", "recording_mbid", "confidence", "artist_credit_id", "release_id", "recording_id"]
    missing = F.col("asked_artist").isNull() | F.col("asked_recording").isNull()
    status = F.when(missing, 400).when(F.col("recording_id").isNull(), 404).otherwise(200)
    body = F.when(status == 200, F.to_json(F.struct(*(F.col(c) for c in fields)))).otherwise(F.lit("{}"))
    return matches.select("req_id", status.alias("status"), body.alias("body"))
