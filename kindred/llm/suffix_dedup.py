"""Suffix-array dedup: bytes covered by a 200-byte string that starts anywhere else.

The suffix array is built blockwise over those suffixes only whose first
``width`` bytes can repeat: super-k-mer buckets (see ``superkmers``) bring all
occurrences of such a string into one block, one occurrence of each distinct
packed string at a time.  In a block

* all strings are laid out with their minimiser at a multiple of ``PERIOD``, so
  that equal strings stand at equal residues;
* the suffixes at the positions of a difference cover modulo ``PERIOD`` are
  sorted first, by their first ``PERIOD`` bytes and then by doubling, which
  gives each a rank to a depth of over ``width`` bytes;
* the block's suffixes are then sorted one bucket (a range of first bytes) at a
  time: by residue, the bytes up to the next cover position and then, however
  long the tie, by the cover sample's rank there.  A block's memory is bounded.
* neighbours in that order that agree in ``width`` bytes, compared by rank or
  else byte by byte, are repeats.

Texts are compared as UTF-8 bytes and matches never cross texts.  Null text is
empty; very long texts are read whole; texts shorter than ``width`` stay whole.  Rows that repeat an id are
texts like all others, so they remove each other's bytes.  Empty tables give
empty results; other columns are ignored.
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

WIDTH, K = 200, 32
PERIOD = 64
#: Suffixes that are sorted at once, more only if they begin with the same eight bytes.
BUCKET = 1 << 18


def difference_cover(period: int) -> np.ndarray:
    """Residues such that every difference modulo ``period`` is one between two of them: 0..s-1 and each multiple of s less 1."""
    s = int(np.ceil(np.sqrt(period)))
    return np.unique(np.concatenate([np.arange(s), np.arange(s - 1, period + s, s) % period, [period - 1]]))


def _dense(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 1; equal keys share one."""
    new = np.zeros(len(order), dtype=np.int32)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), dtype=np.int32)
    ranks[order] = np.cumsum(new) + 1
    return ranks


class BlockArray:
    """The suffix order of one block, to a depth of at least ``width`` bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, width: int, period: int = PERIOD) -> None:
        self.width, self.period = width, period
        size = np.diff(offsets)
        slot = period * (-(-size // period) + 1)
        self.base = np.cumsum(slot) - slot + (-anchor) % period
        total = int(slot.sum())
        depth = period
        while depth < width + period:
            depth *= 2
        self.text = np.zeros(total + 2 * depth, dtype=np.uint8)
        self.text[np.arange(len(data)) + np.repeat(self.base - offsets[:-1], size)] = data
        # eight bytes from any position, as one number in byte order
        self.word = np.ndarray(len(self.text) - 8, dtype=">u8", buffer=self.text, strides=(1,))
        cover = difference_cover(period)
        self.gap = (cover[np.searchsorted(cover, np.arange(period) % period).clip(max=len(cover) - 1)] - np.arange(period)) % period
        self.number = np.full(period, -1)
        self.number[cover] = np.arange(len(cover))
        self.cover = cover
        self._rank(total)

    def _rank(self, total: int) -> None:
        at = (np.arange(0, total, self.period)[:, None] + self.cover).ravel()
        words = [self.word[at + k].astype(np.uint64) for k in range(0, self.period, 8)]
        order = np.lexsort(words[::-1])
        ranks = _dense(order, words)
        del words
        depth, step = self.period, len(self.cover)
        while depth < self.width + self.period:
            # the suffix ``depth`` bytes on is a sample too, ``step`` places on for each period
            later = np.zeros(len(ranks), dtype=np.int32)
            move = step * (depth // self.period)
            later[: max(0, len(ranks) - move)] = ranks[move:]
            both = ranks.astype(np.int64) << 32 | later
            order = np.argsort(both, kind="stable")
            ranks = _dense(order, [both])
            depth *= 2
        self.ranks = ranks

    def rank_at(self, position: np.ndarray) -> np.ndarray:
        """Of cover positions."""
        return self.ranks.take(position // self.period * len(self.cover) + self.number[position % self.period], mode="clip")

    def repeats(self, start: np.ndarray) -> np.ndarray:
        """Which of these suffixes agree with another one in ``width`` bytes."""
        residue = start % self.period
        gap = self.gap[residue]
        shift = (8 * (8 - gap)).astype(np.uint64)
        ahead = np.where(gap > 0, self.word[start].astype(np.uint64) >> np.minimum(shift, np.uint64(63)), np.uint64(0))
        rank = self.rank_at(start + gap)
        order = np.lexsort((rank, ahead, residue))
        s, r = start[order], rank[order]
        close = (residue[order][1:] == residue[order][:-1]) & (ahead[order][1:] == ahead[order][:-1])
        equal = close & (r[1:] == r[:-1])
        # else they differ somewhere after the next cover position: within the width?
        rest = np.flatnonzero(close & ~equal)
        for k in [*range(0, self.width - 8, 8), self.width - 8]:
            rest = rest[self.word[s[rest] + k] == self.word[s[rest + 1] + k]]
        equal[rest] = True
        hit = np.zeros(len(start), dtype=bool)
        hit[order[1:][equal]] = True
        hit[order[:-1][equal]] = True
        return hit


def _find(width: int):
    def find(block: Block) -> tuple[np.ndarray, np.ndarray]:
        raw = block.data.tobytes()
        seen: dict[tuple[bytes, int], int] = {}
        cut = block.offsets.tolist()
        # equal strings (with their minimiser at the same place) once
        of = np.fromiter((seen.setdefault((raw[a:b], c), len(seen)) for a, b, c in zip(cut[:-1], cut[1:], block.anchor.tolist(), strict=True)), np.int64, len(cut) - 1)
        whole = np.bincount(of, minlength=len(seen)) > 1
        whole[of[block.sure]] = True
        one = np.unique(of, return_index=True)[1]
        size = np.diff(block.offsets)[one]
        offsets = np.append(0, np.cumsum(size))
        data = block.data[np.arange(offsets[-1]) + np.repeat(block.offsets[one] - offsets[:-1], size)]
        string = np.repeat(np.arange(len(one)), block.n[one])
        window = np.arange(len(string)) - np.repeat(np.cumsum(block.n[one]) - block.n[one], block.n[one])
        hit = whole[string]
        if len(one) > 1:
            array = BlockArray(data, offsets, block.anchor[one], width)
            start = array.base[string] + window
            # one bucket of suffixes, a range of their first bytes, at a time
            lead = array.word[start].astype(np.uint64)
            bucket = np.searchsorted(np.sort(lead)[BUCKET::BUCKET], lead, side="right")
            for k in range(int(bucket.max(initial=0)) + 1):
                mine = np.flatnonzero(bucket == k)
                hit[mine] |= array.repeats(start[mine])
        # back to all strings
        per = np.split(window[hit], np.searchsorted(string[hit], np.arange(1, len(one))))
        sizes = np.array([len(x) for x in per])[of]
        strings = np.repeat(np.arange(len(of)), sizes)
        return strings, np.concatenate([per[k] for k in of.tolist()]) if len(of) else np.zeros(0, np.int64)

    return find


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in spans.slim(batches, 1):
        out: list[list] = [[], [], [], []]
        for r in range(b.num_rows):
            raw = (b.column(1)[r].as_py() or "").encode("utf-8", "surrogatepass")
            ranges = b.column(2)[r].as_py() or ()
            first, last = spans.merge(np.array([x["first"] for x in ranges], np.int64), np.array([x["last"] for x in ranges], np.int64))
            kept = b"".join(raw[i:j] for i, j in zip([0, *last.tolist()], [*first.tolist(), len(raw)], strict=True))
            for c, v in zip(out, (len(raw), len(raw) - len(kept), len(first), kept), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _rest(batches):
        sha = [hashlib.sha256(x.as_py()).hexdigest() for x in b.column(4)]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, k: int, bucket: int, block: int) -> DataFrame:
    rows = keyed(docs, id_col, text_col)
    gone = repeated_ranges(rows, Unit(words=False, width=width, k=k, smaller_id=False, bucket=bucket, block=block), _find(width), "bytes")
    return rows.join(gone, ["__id", "__hash"], "left").select(doc_id(), "text", "ranges")


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K, bucket: int = BUCKET_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the kept bytes."""
    return _joined(docs, id_col, text_col, width, k, bucket, block).mapInArrow(_rest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _joined(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", WIDTH, K, BUCKET_BYTES, BLOCK_BYTES)
    return rows.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
