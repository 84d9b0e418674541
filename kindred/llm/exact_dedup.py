"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters and sorted externally, so that
equal texts are neighbours; each text is compared in full with the one before
it.  The range key is (first bytes, 64-bit hash, id): a splitter has a fixed
size whatever the texts are, and because the id is part of it a group of
copies that holds a third of all rows is cut over many partitions.  Runs that
touch a partition's first or last key are stitched by their text afterwards
(at most a few rows for each partition).

Null text counts as empty; very long texts are compared whole.  Null ids lose against all others.  Rows that
repeat id and text: one of them stays.  An empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import keep as keep_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEMA = "doc_id long, text_sha256 string, local_keep long, local_size long, leads boolean, run long, edge_text string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("local_keep", pa.int64()), ("local_size", pa.int64()), ("leads", pa.bool_()), ("run", pa.int64()), ("edge_text", pa.string())])
_EMIT = 20_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, text, preferred id; a row out for each, with its run's figures."""
    base = TaskContext.get().partitionId() << 32
    out: list[list] = [[] for _ in _ARROW]
    number = 0
    first_key: tuple | None = None
    # runs of the latest key wait until it is known whether that key is the partition's last one
    waiting: list[tuple[str, array, list[bool]]] = []
    key: tuple | None = None

    def put(text: str, ids: array, nulls: list[bool], edge: bool) -> None:
        nonlocal number
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        best = None if nulls[0] else ids[0]
        n = len(ids)
        for i in range(n):
            row = (None if nulls[i] else ids[i], sha, best, n, i == 0, base + number if edge else None, text if edge and i == 0 else None)
            for c, v in zip(out, row, strict=True):
                c.append(v)
        number += 1

    def full() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(out[0]), _EMIT):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + _EMIT], t) for c, t in zip(out, _ARROW.types, strict=True)], schema=_ARROW)
        for c in out:
            c.clear()

    for batch in batches:
        cols = [batch.column(k) for k in ("head", "hash", "text", "doc_id")]
        for head, h, text, doc in zip(*(c.to_pylist() for c in cols), strict=True):
            if (head, h) != key:
                if first_key is None:
                    first_key = (head, h)
                for run in waiting:
                    put(*run, key == first_key)
                waiting, key = [], (head, h)
                if len(out[0]) >= _EMIT:
                    yield from full()
            if not waiting or waiting[-1][0] != text:
                waiting.append((text, array("q"), []))
            waiting[-1][1].append(doc or 0)
            waiting[-1][2].append(doc is None)
    for run in waiting:
        put(*run, True)
    yield from full()


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  ``keep`` says which
    id of a group stays: ``smallest`` or ``largest``.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    doc = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.substring("text", 1, 16).alias("head"), F.xxhash64("text").alias("hash")
    )
    placed = rows.repartitionByRange(F.col("head"), F.col("hash"), doc).sortWithinPartitions("head", "hash", "text", doc)
    runs = keep_table(placed.mapInArrow(_runs, _SCHEMA), "exact-runs")
    best = F.max if keep == "largest" else F.min
    whole = runs.filter("run is null").select("doc_id", F.col("local_keep").alias("keep_id"), F.col("local_size").alias("group_size"), F.col("leads").alias("kept"), "text_sha256")
    heads = runs.filter("edge_text is not null")
    groups = heads.groupBy("edge_text").agg(best("local_keep").alias("keep_id"), F.sum("local_size").alias("group_size"))
    # of the runs whose best id is the group's, the first one leads
    by_run = (
        heads.select("edge_text", "run", "local_keep")
        .join(groups, "edge_text")
        .select("edge_text", "run", "keep_id", "group_size", F.when(F.col("local_keep").eqNullSafe(F.col("keep_id")), F.col("run")).alias("can_lead"))
    )
    leader = by_run.groupBy("edge_text").agg(F.min("can_lead").alias("leader"))
    by_run = by_run.join(leader, "edge_text").select("run", "keep_id", "group_size", (F.col("run") == F.col("leader")).alias("run_leads"))
    cut = runs.filter("run is not null").join(by_run, "run").select("doc_id", "keep_id", "group_size", (F.col("leads") & F.col("run_leads")).alias("kept"), "text_sha256")
    return whole.unionByName(cut)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP3_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
