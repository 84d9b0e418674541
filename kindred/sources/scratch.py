"""Paths for tables that one session writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Paths made inside are removed at its end, not when Python ends; for work that repeats, such as micro-batches."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        for where in made:
            _delete(spark, where)


def path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; removed when Python ends.

    Only a local session that has not set it gets a folder of its own: on a cluster every executor would write to its own disk.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="kindred-"))
        top = _own[0]
    out = f"{top.rstrip('/')}/kindred/{name}-{uuid.uuid4().hex}"
    made = _scope.get()
    if made is None:
        atexit.register(_delete, spark, out)
    else:
        made.append(out)
    return out


def _delete(spark: SparkSession, where: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(where)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone
        pass


def release(spark: SparkSession) -> None:
    """Removes the shuffle files of finished jobs.

    Spark does so when the driver's JVM collects what refers to them, which with a large heap it may not do for
    half an hour; a chain of stored tables would hold the files of all its jobs on disk until then.
    """
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str, *, tidy: bool = False) -> DataFrame:
    """Written once and read again: short plans, no recomputation.  ``tidy``: and shuffle files released, those of earlier jobs and its own."""
    where = path(df.sparkSession, name)
    if tidy:  # the job before may still have been referred to at its end
        release(df.sparkSession)
    df.write.parquet(where)
    if tidy:
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(where)
