"""Substring dedup over 50-word windows, partitioned as super-k-mers.

A window is ``width`` consecutive words of one document; each word covered by a
window whose word sequence also starts in a document with a smaller id is
removed.  Windows are judged on the input.  Consecutive windows that share a
minimiser travel as one packed string (see ``superkmers``); in a bucket all
windows are sorted by a 128-bit hash, and neighbours are then compared word for
word, so the counts are exact.

Very long texts are cut into pieces of a megabyte only between texts, so no
window is lost.  Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Null text has no words.  Rows
that repeat an id never remove each other's words.  A null id counts as the
smallest.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .superkmers import BLOCK_BYTES, BUCKET_BYTES, Block, Unit, doc_id, keyed, repeated_ranges

WIDTH, K = 50, 16


def _find(width: int):
    def find(block: Block) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = spans.words(block.data, block.offsets)
        hashes = [spans.RangeHash(spans.word_hashes(block.data, starts, ends, w), w).every(width) for w in (0, 1)]
        n = block.n
        string = np.repeat(np.arange(len(n)), n)
        window = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
        at = first[string] + window
        h, g, ids = hashes[0][at], hashes[1][at], block.ids[string]
        order = np.lexsort((ids, g, h))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
        # neighbours with equal hashes, in full
        raw = block.data.tobytes()
        lo, hi = starts[at[order]], ends[at[order] + width - 1]
        where = np.flatnonzero(same)
        if not all(raw[a:b] == raw[c:d] for a, b, c, d in zip(lo[where].tolist(), hi[where].tolist(), lo[where - 1].tolist(), hi[where - 1].tolist(), strict=True)):
            texts = np.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], dtype=object)
            key = np.unique(texts, return_inverse=True)[1]
            redo = np.lexsort((ids[order], key))
            order, key = order[redo], key[redo]
            same = np.append(False, key[1:] == key[:-1])
        group = np.cumsum(~same) - 1
        later = ids[order] > ids[order][np.flatnonzero(~same)][group]
        hit = order[later]
        return string[hit], window[hit]

    return find


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in spans.slim(batches, 1):
        out: list[list] = [[], [], []]
        for r in range(b.num_rows):
            words = (b.column(1)[r].as_py() or "").encode("utf-8", "surrogatepass").split()
            kept, at = [], 0
            ranges = b.column(2)[r].as_py() or ()
            for first, last in sorted((x["first"], x["last"]) for x in ranges):
                kept += words[at:first]
                at = max(at, last)
            kept = kept + words[at:] if ranges else words
            for c, v in zip(out, (len(words), len(words) - len(kept), b" ".join(kept)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _rest(batches):
        sha = [hashlib.sha256(x.as_py()).hexdigest() for x in b.column(3)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, k: int, bucket: int, block: int) -> DataFrame:
    rows = keyed(docs, id_col, text_col)
    gone = repeated_ranges(rows, Unit(words=True, width=width, k=k, smaller_id=True, bucket=bucket, block=block), _find(width), "words")
    return rows.join(gone, ["__id", "__hash"], "left").select(doc_id(), "text", "ranges")


def window_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K, bucket: int = BUCKET_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the kept words, joined by one space."""
    out = _joined(docs, id_col, text_col, width, k, bucket, block).mapInArrow(_rest, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.decode("kept", "UTF-8"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _joined(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", WIDTH, K, BUCKET_BYTES, BLOCK_BYTES)
    return rows.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
