"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is hashed to 128 bits; of windows that
occur more than once in the corpus all but the first occurrence (by doc_id,
then line number) are removed: each line that such a window covers goes, and
overlapping windows merge.  Windows are judged on the input.

Counting is a partial aggregation, so a window that a third of all documents
hold is reduced before it is shuffled.  The join that marks later occurrences
is an ordinary equi-join whose hot keys adaptive execution may split; it moves
ids, positions and hashes, never text.

A text's work grows in proportion to its lines, however many of them go.
Lines are what ``\\n`` separates, compared exactly.  Null text is empty: one
empty line, kept as null.  Texts under three lines have no window and stay
whole.  A null doc_id sorts before all others; rows that repeat both id and
text are the same place in the corpus and get the same result.  Empty tables
give empty results; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(__id, __hash, __lines): for each text with later occurrences the numbers of the lines that they cover."""
    lines = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), _lines(F.col(text_col)).alias("l")).filter(F.size("l") >= window)
    hashed = F.transform(F.array("l"), lambda l: F.transform(F.sequence(F.lit(1), F.size(l) - (window - 1)), lambda i: F.unhex(F.md5(F.array_join(F.slice(l, i, window), "\n").cast("binary")))))
    windows = lines.select("__id", "__hash", F.posexplode(F.get(hashed, F.lit(0))).alias("pos", "w"))
    place = F.struct("__id", "pos", "__hash")
    seen = windows.groupBy("w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w", "first")
    later = windows.join(seen, "w").filter(~place.eqNullSafe(F.col("first")))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_list("pos"), lambda p: F.sequence(p, p + (window - 1)))))
    return later.groupBy("__id", "__hash").agg(covered.alias("__lines"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The input's rows and columns with repeated lines taken out of the text, and ``n_lines`` and ``n_removed`` (these two replace columns of that name)."""
    gone = repeated_windows(docs, id_col=id_col, text_col=text_col, window=window)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*names).alias("d")
    joined = rows.join(gone, F.col(f"d.`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(f"d.`{text_col}`") == F.col("__hash")), "left")
    lines = _lines(F.col(text_col))
    # the one-element array makes the lines a variable: split once, not for each line that stays
    kept = F.transform(F.array(lines), lambda l: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("__lines")), lambda i: F.get(l, i)), "\n"))
    text = F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(F.get(kept, F.lit(0)))
    return joined.select(
        *(text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in names),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_removed"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS pos, l FROM t WHERE len(l) >= 3),
h AS (SELECT doc_id, pos, l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2] AS win FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM h),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE k > 1),
g AS (SELECT doc_id, list(pos) AS p FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(l) AS n_lines, coalesce(len(p), 0) AS n_removed,
       sha256(array_to_string([x for x, i in l if NOT list_contains(coalesce(p, []), i)], chr(10))) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""
