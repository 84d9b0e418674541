"""Requests as a stream: each micro-batch is resolved against the stored indexes; new facts extend them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.fuzzy import build_index
from kindred.plans.indexes import block_docs
from kindred.plans.lookup import Engine, lookup
from kindred.plans.mapping import pending
from kindred.sources import scratch
from kindred.sources.tables import has_index, load_index, save_index, to_response


def serve(requests: DataFrame, engine: Engine, out: str, checkpoint: str) -> StreamingQuery:
    """Answers a stream of requests with JSON rows; a batch that is run again replaces its own folder."""

    def answer(batch: DataFrame, number: int) -> None:
        with scratch.scope(batch.sparkSession):
            to_response(lookup(batch, engine)).write.mode("overwrite").json(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extend_blocks(mapping: DataFrame, path: str, aliases: DataFrame | None = None, *, min_credit: int = 2, rebuild: bool = False) -> int:
    """Builds the blocks that are not stored yet (all, if ``rebuild``) and returns their number.

    ``aliases`` (recording_id, name) of items; stored blocks take up later ones with ``rebuild``.
    """
    spark = mapping.sparkSession
    there = has_index(spark, path) and not rebuild
    built = load_index(spark, path).docs.selectExpr("floor(index_id / 2) AS index_id").distinct() if there else spark.createDataFrame([], "index_id long")
    ids = pending(mapping, built, min_credit=min_credit).select(F.col("artist_credit_id").alias("block"))
    n = ids.count()
    if not n:
        return 0
    docs, links = block_docs(mapping, aliases)
    fresh = docs.selectExpr("*", "floor(index_id / 2) AS block").join(ids, "block", "left_semi").drop("block")
    save_index(build_index(fresh), path, mode="append" if there else "overwrite")
    links.join(ids, "block", "left_semi").write.mode("append" if there else "overwrite").parquet(f"{path}/links")
    return n
