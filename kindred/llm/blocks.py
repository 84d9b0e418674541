"""Counting over the whole corpus how many of each text's hashes other texts have, with little traffic.

A task gathers ``BUFFER`` hashes of its texts (a chunk), settles those that
several of them hold, and deals the others by their leading bits: for each
value that occurs one packed block of 32 more bits and the text's number in the
chunk.  A settled hash sends one mark without owners, so that even a hash that
every text holds costs its key one entry for each chunk.  A key's blocks are
sorted at once and the counts go back by chunk.

The keys follow from the number of hashes (``KEY`` each) and not from the
number of partitions, and a block is only made where it holds something: there
are never more blocks than hashes.  A block holds about ``BUFFER * KEY`` hashes
through their number: thousands for a gigabyte of text, some ten for a hundred,
and towards one, as much as rows would cost, for terabytes.  Hashes count as equal if all bits that travel are,
so a count may be too large by chance, never too small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import spans

U = np.uint64
BUFFER, KEY = 1 << 20, 1 << 18
#: A text's number in a mark; texts of a chunk are numbered below it.
MARK = 0xFFFF
SCHEMA = "key long, chunk long, owner binary, low binary, ids binary, counts binary"
_ARROW = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("owner", "low", "ids", "counts"))])


def bits_for(hashes: int, key: int = KEY) -> int:
    """Leading bits by which so many hashes are dealt."""
    return max(0, int(np.ceil(np.log2(max(1, hashes / key)))))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class Dealer:
    """Gathers a task's texts and gives blocks."""

    def __init__(self, bits: int, buffer: int = BUFFER) -> None:
        self.bits, self.buffer, self.chunk = bits, buffer, TaskContext.get().partitionId() << 32
        self.ids: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.texts = self.size = 0

    def add(self, ids: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Distinct (owner, hash) pairs; owner: position in ids, rising."""
        for at in range(0, len(ids), MARK):  # far more texts than one chunk may number
            if self.texts + min(MARK, len(ids) - at) > MARK:
                yield from self.flush()
            i, j = np.searchsorted(owner, [at, at + MARK])
            self.ids.append(ids[at : at + MARK])
            self.owners.append(owner[i:j] - at + self.texts)
            self.hashes.append(hashes[i:j])
            self.texts += len(self.ids[-1])
            self.size += j - i
            if self.size >= self.buffer:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.texts:
            return
        ids, owner, hashes = np.concatenate(self.ids), np.concatenate(self.owners), np.concatenate(self.hashes)
        whole = hashes >> U(32 - self.bits) if self.bits < 32 else hashes
        order = np.argsort(whole, kind="stable")
        whole, owner = whole[order], owner[order].astype(np.uint16)
        same = whole[1:] == whole[:-1]
        shared = np.zeros(len(whole), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        head = shared & np.append(True, ~same)[: len(whole)]
        yield _record([(self.chunk, self.chunk, None, None, ids.astype(np.int64).tobytes(), np.bincount(owner[shared], minlength=len(ids)).astype(np.uint32).tobytes())])
        key = (whole >> U(32)).astype(np.int64) if self.bits else np.zeros(len(whole), np.int64)
        low = (whole & U(0xFFFFFFFF)).astype(np.uint32)
        owner[head] = MARK
        some = np.flatnonzero(~shared | head)
        some = some[np.lexsort((owner[some], key[some]))]
        key, low, owner = key[some], low[some], owner[some]
        cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)]), len(key)).tolist()
        rows = [(int(key[i]), self.chunk, owner[i:j].tobytes(), low[i:j].tobytes(), None, None) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        if rows:
            yield _record(rows)
        self.ids, self.owners, self.hashes = [], [], []
        self.texts = self.size = 0
        self.chunk += 1


COUNTS = "chunk long, owner binary, ids binary, counts binary"


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "owner", "ids", "counts"])


def _found(blocks: list[tuple[int, bytes, bytes]]) -> Iterator[tuple]:
    """One key's blocks: for each, how many of its texts' hashes here others have too."""
    owner = [np.frombuffer(o, np.uint16) for _, o, _ in blocks]
    low = np.concatenate([np.frombuffer(x, np.uint32) for _, _, x in blocks])
    order = np.argsort(low, kind="stable")
    s = low[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(s), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = 0
    for (chunk, _, _), who in zip(blocks, owner, strict=True):
        mine = who[hit[at : at + len(who)]]
        at += len(who)
        which, many = np.unique(mine[mine != MARK], return_counts=True)
        if len(which):
            yield chunk, which.tobytes(), None, many.astype(np.uint32).tobytes()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by key; a chunk's ids pass through."""
    now, waiting = None, []
    for b in spans.slim(batches, 3):
        rows: list[tuple] = []
        for key, chunk, owner, low, ids, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if ids is not None:
                rows.append((chunk, None, ids, counts))
                continue
            if key != now and waiting:
                rows += _found(waiting)
                waiting = []
            now = key
            waiting.append((chunk, owner, low))
        if rows:
            yield _counts(rows)
    if waiting and (rows := list(_found(waiting))):
        yield _counts(rows)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) of whole chunks, sorted by chunk."""
    now, ids, total = None, None, np.zeros(MARK, dtype=np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[: len(ids)])], names=["id", "n"])

    for b in batches:
        for chunk, owner, mine, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if chunk != now:
                if now is not None:
                    yield out()
                now, ids, total = chunk, None, np.zeros(MARK, dtype=np.int64)
            n = np.frombuffer(counts, np.uint32)
            if mine is not None:
                ids = np.frombuffer(mine, np.int64)
                total[: len(ids)] += n
            else:
                total[np.frombuffer(owner, np.uint16)] += n
    if now is not None:
        yield out()


def shared_counts(dealt: DataFrame) -> DataFrame:
    """(id, n): of each text how many hashes another text has too; dealt: the blocks of all tasks."""
    counted = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, COUNTS)
    return counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_added, "id long, n long")
