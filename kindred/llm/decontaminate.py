"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Two-word seeds of the test items meet the corpus: documents give only those
seeds that a bit table of fixed size, filled from the items, may hold, and an
equi-join on the 64-bit hash finds the items.  Places with enough seeds are
aligned locally, word by word, with the whole item: match 1, mismatch and gap
-1.  The score is the best alignment's share of the item's words, so edited
copies are found.

No copy at ``min_score`` is lost.  Its m matched words are cut into at most
e + 1 runs by its e mismatches and gaps, so it keeps at least m - e - 1 of the
item's seeds, which is K = ceil(min_score * n) - 1 or more for n words (three
or more words give no such bound: a word inserted after every two leaves none
of them).  So any K - ``min_seeds`` seeds may be left out if ``min_seeds`` of
the others are asked for; those with most occurrences in the corpus are.

Words are runs of letters and digits of the lower-cased text.  Null and empty
texts give nothing; very long texts are read whole, and only their candidate
places are aligned.  Of alignments with equal scores the first is reported.  Items under three words match nothing; those for which K
is 1 need one seed.  Rows that repeat an id are judged each by their own text; a null id stays null.  Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import spans
from .store import keep
from .superkmers import doc_id, keyed

U = np.uint64
SEED = 2
MIN_WORDS = 3
TABLE_BITS = 22
MIN_SCORE = 0.5
MIN_SEEDS = 2
#: Cells of alignment tables that are filled at once.
CELLS = 1 << 16
#: Candidates, measured with their items' words, up to which they are broadcast; beyond, the texts are shuffled.
BROADCAST_BYTES = 32 << 20


def word_runs(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, each text's first word) of runs of rows."""
    at = 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (size < 1 << 20 or not parts):
            parts.append(texts[at].lower().encode("utf-8", "replace"))
            size += len(parts[-1])
            at += 1
        data = np.frombuffer(b"".join(parts), np.uint8)
        data = np.where((data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)), data, np.uint8(32))
        starts, ends, begin = spans.words(data, np.append(0, np.cumsum([len(p) for p in parts])))
        yield first, spans.word_hashes(data, starts, ends), begin


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, word, first in word_runs([t or "" for t in b.column(1).to_pylist()]):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(first) - 1), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(word.view(np.int64)))], names=["item_id", "words"])


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first = b.column(1).offsets.to_numpy().astype(np.int64)
        hashes, item, at = spans.shingles(b.column(1).values.to_numpy().view(U)[first[0] : first[-1]], first - first[0], SEED)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(b.column(0).take(pa.array(item))), pa.array(at - (first - first[0])[item]), pa.array(np.diff(first)[item])], names=["h", "item", "at", "size"])


def _hits(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slim(batches, 2):
            for row, word, first in word_runs([t or "" for t in b.column(2).to_pylist()]):
                hashes, text, at = spans.shingles(word, first, SEED)
                bit = hashes >> U(64 - TABLE_BITS)
                hit = np.flatnonzero((table[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1))
                hashes, text, at = hashes[hit], text[hit], at[hit]
                rows, cut = np.unique(text, return_index=True)
                cut = pa.array(np.append(cut, len(text)).astype(np.int32))
                col = lambda c: b.column(c).take(pa.array(row + rows))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([col(0), col(1), pa.ListArray.from_arrays(cut, pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(at - first[text]))], names=["__id", "__hash", "h", "pos"])

    return run


def align(items: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local alignments of many (item, place) pairs at once: best score, and the place's words [start, end) in it."""
    rows, cols = max(map(len, items)), max(map(len, places))
    a, b = np.zeros((len(items), rows), U), np.full((len(items), cols), U(1))
    size = np.array([len(x) for x in items])
    width = np.array([len(x) for x in places])
    for k, (x, y) in enumerate(zip(items, places, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    j = np.arange(cols + 1)
    score, start = np.zeros((len(items), cols + 1), np.int64), np.tile(j, (len(items), 1))
    best, first, last = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    inside = j[None, :] <= width[:, None]
    for i in range(rows):
        diagonal = score[:, :-1] + np.where(b == a[:, i : i + 1], 1, -1)
        new, new_start = np.zeros_like(score), np.tile(j, (len(items), 1))
        for value, origin, to in ((diagonal, np.where(score[:, :-1] > 0, start[:, :-1], j[:-1]), slice(1, None)), (score - 1, start, slice(None))):
            better = value > new[:, to]
            new[:, to] = np.where(better, value, new[:, to])
            new_start[:, to] = np.where(better, origin, new_start[:, to])
        # gaps along the place: each step costs one
        run = np.maximum.accumulate((new + j) << 32 | (0xFFFFFFFF - new_start), axis=1)
        value = (run >> 32) - j
        better = value > new
        score, start = np.where(better, value, new), np.where(better, 0xFFFFFFFF - (run & 0xFFFFFFFF), new_start)
        shown = np.where(inside & (i < size)[:, None], score, 0)
        at = shown.argmax(axis=1)
        top = shown[np.arange(len(items)), at]
        better = top > best
        best, first, last = np.where(better, top, best), np.where(better, start[np.arange(len(items)), at], first), np.where(better, at, last)
    return best, first, last


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: id, text, candidates (item_id, words, place); one row out per document and item."""
    for b in spans.slim(batches, 1):
        out: dict[tuple[int, object], tuple] = {}
        waiting: list[tuple] = []
        widest = 0

        def flush() -> None:
            nonlocal waiting, widest
            if waiting:
                best, first, last = align([w[2] for w in waiting], [w[3] for w in waiting])
                for w, s, x, y in zip(waiting, best.tolist(), first.tolist(), last.tolist(), strict=True):
                    found = (s / len(w[2]), -(w[4] + x), w[4] + y)
                    if (key := w[:2]) not in out or out[key] < found:
                        out[key] = found
            waiting, widest = [], 0

        candidates = b.column(2).to_pylist()
        for row, word, first in word_runs([t or "" for t in b.column(1).to_pylist()]):
            for k in range(len(first) - 1):
                mine = word[first[k] : first[k + 1]]
                for c in candidates[row + k]:
                    item = np.array(c["words"], np.int64).view(U)
                    n = len(item)
                    for p in sorted(set(c["places"])):
                        lo = max(0, (p - 1) * n)
                        place = mine[lo : max(lo, (p + 3) * n)]
                        if len(place):
                            waiting.append((row + k, c["item_id"], item, place, lo))
                            widest = max(widest, len(place))
                            if len(waiting) * widest > CELLS:
                                flush()
        flush()
        rows = sorted(out, key=lambda x: (x[0], str(x[1])))
        cols = [out[r] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([c[0] for c in cols], pa.float64()), pa.array([-c[1] for c in cols], pa.int64()), pa.array([c[2] for c in cols], pa.int64())],
            names=["doc_id", "item_id", "score", "start_word", "end_word"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, and the passage's words [start_word, end_word)."""
    rows = keyed(docs, id_col, text_col)
    items = keep(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).mapInArrow(_items, "item_id long, words array<long>").filter(F.size("words") >= MIN_WORDS).distinct().withColumn("item", F.xxhash64("item_id", "words")), "items")
    seeds = keep(items.select("item", "words").mapInArrow(_seeds, "h long, item long, at long, size long"), "seeds")
    bit = F.shiftrightunsigned("h", 64 - TABLE_BITS)
    table = np.zeros(1 << (TABLE_BITS - 6), U)
    for word, bits in seeds.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - TABLE_BITS}) & 63 as int))"))).collect():  # the table's size at most
        table[word] = bits & 0xFFFFFFFFFFFFFFFF
    given = keep(rows.mapInArrow(_hits(table), "__id long, __hash long, h array<long>, pos array<long>"), "seed-hits")
    frequency = given.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    sure = F.greatest(F.ceil(min_score * F.col("size") - 1e-9) - 1, F.lit(1))
    enough = F.least(F.lit(min_seeds), sure)
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "h", "at"))
    rare = seeds.join(frequency, "h", "left").withColumn("order", order).filter(F.col("order") <= F.col("size") - SEED + 1 - (sure - enough)).select("h", "item", "at", "size")
    hits = given.select("__id", "__hash", F.explode(F.arrays_zip("h", "pos")).alias("x")).select("__id", "__hash", "x.h", "x.pos").join(rare, "h")
    # a place: the item's length of words, numbered from the document's start, where the item would begin
    place = F.floor((F.col("pos") - F.col("at")) / F.col("size"))
    near = hits.select("__id", "__hash", "item", "size", "pos", F.explode(F.array(place, place + 1)).alias("place"))
    places = near.groupBy("__id", "__hash", "item", "size", "place").agg(F.count_distinct("pos").alias("k")).filter(F.col("k") >= enough)
    found = places.groupBy("__id", "__hash", "item").agg(F.collect_set("place").alias("places")).join(items, "item")
    wanted = keep(found.groupBy("__id", "__hash").agg(F.collect_list(F.struct("item_id", "words", "places")).alias("items")), "candidates")
    size = F.aggregate("items", F.lit(0).cast("long"), lambda total, x: total + 8 * F.size(x["words"]) + 8 * F.size(x["places"]) + 64)
    if (wanted.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    aligned = rows.join(wanted, ["__id", "__hash"]).select(doc_id(), "text", "items").mapInArrow(_align, "doc_id long, item_id long, score double, start_word long, end_word long")
    return aligned.filter(F.col("score") >= min_score).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"))).alias("x")).select("doc_id", "item_id", F.round("x.score", 6).alias("score"), "x.start_word", "x.end_word")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
