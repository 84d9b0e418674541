"""A training-corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, further ones included.

Every stage works on whole texts of any length and gives an empty table for an
empty one.  Rows with a null id are rows like all others; rows that share an id
are judged each by its own text.  Columns of any name may be there besides
``doc_id``, ``text`` and ``n_chars``; names that begin with two underscores are
the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from kindred.llm.store import keep

#: No SQL form: language filters, alignment and tokenisation; tests compare with brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """``__key`` stands for (id, text): null ids count, and texts that share an id are judged each for itself."""
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def _only(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Keyed documents whose key is (``left_semi``) or is not (``left_anti``) among ``keys``; broadcast only after counting."""
    few = keys.count() <= ngram_join.BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys, "__key", how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty, no letters, or almost no known n-gram) go; repeated rows alike."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go (a null id comes first, rows that repeat id and text are one place); so do documents of which nothing is left.  A null text stays null."""
    out = line_dedup.line_dedup(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", "\\s+", " ")) == "")
    out = out.filter(~emptied)
    return out.select(*(F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays (null is last; texts that share an id: the smallest hash of id and text), and one of repeated rows.  Documents without words stay."""
    rows = _keyed(docs)
    groups = ngram_join.ngram_jaccard_join(rows, id_col="__key").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    found = keep(rows.groupBy("__key", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(groups, "__key"), "pipeline-groups")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("best"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    near = keep(found.join(best, "component_id").filter("__key != best.__key").select("__key"), "pipeline-near")
    repeated = keep(found.filter("n > 1").select("__key").distinct(), "pipeline-repeated")
    rows = _only(rows, near, "left_anti")
    if repeated.head(1):
        rows = _only(rows, repeated, "left_anti").unionByName(_only(rows, repeated, "left_semi").dropDuplicates(["__key"]))
    return rows.select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, or an edited copy of one, go; null and empty texts, of either table, match nothing."""
    rows = _keyed(docs)
    hits = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key")
    return _only(rows, keep(hits.select(F.col("doc_id").alias("__key")).distinct(), "pipeline-leaks"), "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens; a null or empty text is its end token alone, repeated rows are packed each."""
    return packing.pack_documents(docs, packing.public_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_near),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
