"""Windows that repeat anywhere in a corpus, found in buckets by minimiser.

A window is a run of ``width`` units (bytes or words) of one text, and its
minimiser the smallest hash of the ``k``-grams in it.  Equal windows have equal
minimisers, so consecutive windows that share one travel as one packed string
to its bucket.  Before anything travels:

* strings that one piece of about a megabyte holds several times (found by
  hash, then compared in full) are settled there, and one of them goes on;
* minimisers that occur once in the whole corpus (in one document, where only
  other documents count) drop out by a partial aggregation and a join of
  (minimiser, id, position) rows, which hold no text.

What is left, the repeated part of the corpus, is cut out of the texts and
dealt by minimiser.  ``find`` (the operator's own) looks for equal windows in
blocks of whole buckets.  A bucket larger than a block is divided by its
windows' further content: in its task, or by Spark where it is too large for
one task.  All windows of a bucket
share a core (at first the minimiser's k-gram) with ``slack`` units beside it,
so each window extends that core by half the slack to its left or else to its
right, and equal windows do so alike; the extended core is the key of a smaller
bucket with half the slack.  After a few divisions no slack is left, and a
bucket that is still large holds one window many times: those are grouped by
their text, with partial aggregation.  So no task ever holds an unbounded
group, and windows are compared in full whatever a bucket's size.

Texts are told apart by id and hash, so that rows that repeat an id are judged
each by their own text; a null id counts as smaller than all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .store import keep

U = np.uint64
NULL_ID = -(1 << 63)
#: Bytes of packed strings that are looked through together.
BLOCK_BYTES = 1 << 20
#: Bytes of one bucket that a task may hold; larger buckets are divided before they are dealt.
BUCKET_BYTES = 32 << 20


@dataclass(frozen=True)
class Unit:
    """What windows are made of."""

    words: bool
    width: int
    k: int
    #: Only windows that a smaller id has too count as repeated; else any second occurrence counts.
    smaller_id: bool
    bucket: int = BUCKET_BYTES
    block: int = BLOCK_BYTES


_CUT = "__id long, __hash long, m long, start long, n long, anchor int, bytes long, sure boolean, goes boolean"
_CUT_NAMES = [x.split()[0] for x in _CUT.split(", ")]


def _units(unit: Unit, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """The values that windows run over, each text's first one, and for words their bytes [start, end)."""
    if not unit.words:
        return data, offsets, None, None
    starts, ends, first = spans.words(data, offsets)
    return spans.word_hashes(data, starts, ends), first, starts, ends


def _alike(unit: Unit, raw: bytes, lo: np.ndarray, hi: np.ndarray, with_lo: np.ndarray, with_hi: np.ndarray) -> np.ndarray:
    """Which byte ranges hold the same units."""
    out = [raw[a:b] == raw[c:d] for a, b, c, d in zip(lo.tolist(), hi.tolist(), with_lo.tolist(), with_hi.tolist(), strict=True)]
    if unit.words:  # perhaps with other white space
        out = [same or raw[a:b].split() == raw[c:d].split() for same, a, b, c, d in zip(out, lo.tolist(), hi.tolist(), with_lo.tolist(), with_hi.tolist(), strict=True)]
    return np.array(out, dtype=bool)


def _cut(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slim(batches, 2):
            ids, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
            for row, data, offsets in spans.pieces(b.column(2), 1 << 20):
                values, first, lo, hi = _units(unit, data, offsets)
                if len(values) < unit.width:
                    continue
                ranges = spans.RangeHash(values)
                grams = ranges.every(unit.k)
                least = spans.minimisers(grams, unit.width - unit.k + 1)
                valid = np.zeros(len(least), dtype=np.int8)  # windows that lie in one text
                size = np.diff(first)
                some = size >= unit.width
                np.add.at(valid, first[:-1][some], 1)
                ends = first[:-1][some] + size[some] - unit.width + 1
                np.add.at(valid, ends[ends < len(valid)], -1)
                at = np.flatnonzero(np.cumsum(valid, dtype=np.int8))
                if not len(at):
                    continue
                fresh = np.ones(len(at), dtype=bool)
                fresh[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
                fresh |= np.isin(at, first[:-1][some])
                head = np.flatnonzero(fresh)
                start, n = at[head], np.diff(np.append(head, len(at)))
                text = np.searchsorted(first, start, side="right") - 1
                m, whole = grams[least[start]], ranges.of(start, start + n + unit.width - 1)
                doc = ids[row + text]
                # equal strings of this piece, smallest id first
                order = np.lexsort((doc, n, whole, m))
                same = np.zeros(len(order), dtype=bool)
                same[1:] = (m[order][1:] == m[order][:-1]) & (whole[order][1:] == whole[order][:-1]) & (n[order][1:] == n[order][:-1])
                begin, end = (start, start + n + unit.width - 1) if lo is None else (lo[start], hi[start + n + unit.width - 2])
                head = order[np.flatnonzero(~same)][np.cumsum(~same) - 1]  # of each string's group, in this order
                again = np.flatnonzero(same)
                x, y = order[again], head[again]
                equal = _alike(unit, data.tobytes(), begin[x], end[x], begin[y], end[y])
                x, y = x[equal], y[equal]
                sure, goes = np.zeros(len(order), dtype=bool), np.ones(len(order), dtype=bool)
                if unit.smaller_id:
                    sure[x] = doc[x] > doc[y]
                    goes = ~sure
                else:
                    sure[x] = sure[y] = True
                    goes[x] = False
                cols = (doc, marks[row + text], m.view(np.int64), start - first[text], n, (least[start] - start).astype(np.int32), end - begin, sure, goes)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_CUT_NAMES)

    return run


_PACKED = "m long, large boolean, __id long, __hash long, start long, n long, anchor int, sure boolean, packed binary"
_PACKED_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def _pack(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slim(batches, 2):
            out: list[list] = [[] for _ in _PACKED_NAMES]
            size = 0
            for r in range(b.num_rows):
                i, mark = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                raw = (b.column(2)[r].as_py() or "").encode("utf-8", "surrogatepass")
                words = raw.split() if unit.words else None
                for s in b.column(3)[r].as_py():
                    end = s["start"] + s["n"] + unit.width - 1
                    packed = b" ".join(words[s["start"] : end]) if unit.words else raw[s["start"] : end]
                    size += len(packed)
                    for c, v in zip(out, (s["m"], s["large"], i, mark, s["start"], s["n"], s["anchor"], s["sure"], packed), strict=True):
                        c.append(v)
                if size > 4 << 20:
                    yield _record(out)
                    out, size = [[] for _ in _PACKED_NAMES], 0
            yield _record(out)

    return run


_PACKED_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]


def _record(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PACKED_TYPES, strict=True)], names=_PACKED_NAMES)


@dataclass
class Block:
    """Packed strings of whole buckets, by minimiser and id."""

    data: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    sure: np.ndarray


#: For each string of the block, the numbers of its windows that are repeated: (string, window) arrays.
Find = Callable[[Block], tuple[np.ndarray, np.ndarray]]
_RANGES = "__id long, __hash long, first long, last long"


def _ranges(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, string: np.ndarray, window: np.ndarray, width: int) -> pa.RecordBatch:
    """Repeated windows as covered ranges [first, last), merged within a string."""
    order = np.lexsort((window, string))
    string, window = string[order], window[order]
    new = np.ones(len(string), dtype=bool)
    new[1:] = (string[1:] != string[:-1]) | (window[1:] > window[:-1] + width)
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(string) - 1) if len(at) else at
    s = string[at]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[s], marks[s], start[s] + window[at], start[s] + window[last] + width)], names=["__id", "__hash", "first", "last"])


def _halved(unit: Unit, core: int, data: np.ndarray, offsets: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts of strings whose windows share ``core`` units: (string, first window, windows, anchor, key, bytes [begin, end)).

    A window whose core has half the slack or more on its left goes to the left
    part, whose key is the core with that half; all others to the right part.
    """
    half = (unit.width - core + 1) // 2
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1)
        values, first, lo, hi = _units(unit, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        ranges = spans.RangeHash(values)
        many, place = n[at:to], anchor[at:to].astype(np.int64)
        cut = np.clip(place - half + 1, 0, many)
        for skip, count, where in ((np.zeros_like(cut), cut, place - half), (cut, many - cut, place - cut)):
            some = np.flatnonzero(count)
            begin = first[some] + skip[some]
            stop = begin + count[some] + unit.width - 1
            key = ranges.of(begin + where[some], begin + where[some] + core + half)
            x, y = (begin, stop) if lo is None else (lo[begin], hi[stop - 1])
            yield at + some, skip[some], count[some], where[some], key, offsets[at] + x, offsets[at] + y
        at = to


def _equal(unit: Unit, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Of strings of one window each those that are repeated, by their text."""
    raw, cut = block.data.tobytes(), block.offsets.tolist()
    seen: dict[bytes, int] = {}
    of = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(cut[:-1], cut[1:], strict=True)), np.int64, len(cut) - 1)
    if unit.smaller_id:
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, of, block.ids)
        hit = np.flatnonzero(block.ids > least[of])
    else:
        hit = np.flatnonzero((np.bincount(of, minlength=len(seen)) + np.bincount(of, weights=block.sure, minlength=len(seen)) > 1)[of])
    return hit, np.zeros(len(hit), np.int64)


def search(unit: Unit, block: Block, find: Find, core: int) -> tuple[np.ndarray, np.ndarray]:
    """``find`` on blocks of bounded size."""
    if len(block.data) <= 2 * unit.block:
        return find(block)
    if core >= unit.width:
        return _equal(unit, block)
    string, skip, n, anchor, key, begin, end = (np.concatenate(x) for x in zip(*_halved(unit, core, block.data, block.offsets, block.n, block.anchor), strict=True))
    ids = block.ids[string]
    order = np.lexsort((ids, key))
    cut = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    last = np.append(cut[1:], len(order)) - 1
    shared = ids[order[cut]] < ids[order[last]] if unit.smaller_id else last > cut
    raw = block.data.tobytes()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[np.ndarray] = []
    size = 0

    def look() -> None:
        nonlocal size
        if waiting:
            mine = np.concatenate(waiting)
            data = b"".join([raw[i:j] for i, j in zip(begin[mine].tolist(), end[mine].tolist(), strict=True)])
            part = Block(np.frombuffer(data, np.uint8), np.append(0, np.cumsum(end[mine] - begin[mine])), ids[mine], n[mine], anchor[mine], block.sure[string[mine]])
            which, window = search(unit, part, find, core + (unit.width - core + 1) // 2)
            found.append((string[mine[which]], skip[mine[which]] + window))
        waiting.clear()
        size = 0

    for i, j in zip(cut[shared].tolist(), (last[shared] + 1).tolist(), strict=True):
        mine = order[i:j]
        here = int((end[mine] - begin[mine]).sum())
        if size + here > unit.block:
            look()
        waiting.append(mine)
        size += here
    look()
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _buckets(unit: Unit, find: Find) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        size = 0

        def look(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            col = rows["packed"].combine_chunks().cast(pa.large_binary())
            col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
            offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            get = lambda c: rows[c].to_numpy()
            block = Block(data, offsets - offsets[0], get("__id"), get("n"), get("anchor"), get("sure"))
            return _ranges(block.ids, get("__hash"), get("start"), *search(unit, block, find, unit.k), unit.width)

        for b in batches:
            at = 0
            m = b.column(0).to_numpy()
            bytes_to = np.cumsum(pc.binary_length(b.column(8)).to_numpy(), dtype=np.int64)
            cuts = np.flatnonzero(m[1:] != m[:-1]) + 1
            if parts and len(m) and parts[-1].column(0)[-1].as_py() != m[0]:
                cuts = np.concatenate([[0], cuts])
            done = 0
            for c in cuts:
                here = int(bytes_to[c - 1]) - done if c else 0
                if size + here >= unit.block:
                    if c > at:
                        parts.append(b.slice(at, c - at))
                    yield look(pa.Table.from_batches(parts))
                    parts, size, at = [], 0, c
                    done = int(bytes_to[c - 1]) if c else 0
            if at < len(m):
                parts.append(b.slice(at))
                size += int(bytes_to[-1]) - done
        if parts:
            yield look(pa.Table.from_batches(parts))

    return run


def _divide(unit: Unit, core: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, offsets in spans.pieces(b.column(8).cast(pa.large_binary()).view(pa.large_string()), 1 << 20):
                raw, mine = data.tobytes(), b.slice(row, len(offsets) - 1)
                start, n, anchor = (mine.column(c).to_numpy() for c in (4, 5, 6))
                for some, skip, many, at, key, x, y in _halved(unit, core, data, offsets, n, anchor):
                    take = lambda c: mine.column(c).take(pa.array(some))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), take(1), take(2), take(3), pa.array(start[some] + skip), pa.array(many), pa.array(at.astype(np.int32)), take(7), pa.array([raw[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)], pa.binary())],
                        names=_PACKED_NAMES,
                    )

    return run


def _shared(unit: Unit, strings: DataFrame, size: Column) -> DataFrame:
    """(m, large): keys that can have repeated windows."""
    by = strings.groupBy("m")
    if unit.smaller_id:
        keys = by.agg(F.sum(size).alias("size"), F.min("__id").alias("lo"), F.max("__id").alias("hi")).filter("lo < hi")
    else:
        keys = by.agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return keys.select("m", (F.col("size") > unit.bucket).alias("large"))


def _divided(unit: Unit, large: DataFrame, name: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Strings of large buckets dealt to small ones, and single windows that are too many for a bucket."""
    small, core = None, unit.k
    while core < unit.width:
        parts = keep(large.mapInArrow(_divide(unit, core), _PACKED).drop("large"), f"{name}-divided")
        core += (unit.width - core + 1) // 2
        keys = keep(_shared(unit, parts, F.octet_length("packed")), f"{name}-divided-keys")
        parts = parts.join(keys, "m").select(*_PACKED_NAMES)
        few = parts.filter("not large")
        small = few if small is None else small.unionByName(few)
        if not keys.filter("large").head(1):
            return small, None
        large = parts.filter("large")
    return small, large


def repeated_ranges(rows: DataFrame, unit: Unit, find: Find, name: str) -> DataFrame:
    """(__id, __hash, ranges): for each text with repeated windows the unit ranges that they cover; rows has __id, __hash, text."""
    cut = keep(rows.mapInArrow(_cut(unit), _CUT), f"{name}-minimisers")
    going = cut.filter("goes")
    often = keep(_shared(unit, going, F.col("bytes")), f"{name}-shared")
    # sets, so that repeated rows don't multiply
    wanted = going.join(often, "m").groupBy("__id", "__hash").agg(F.collect_set(F.struct("start", "n", "m", "anchor", "large", "sure")).alias("spans"))
    # a text's whole strings that its own task has settled, and what the buckets find
    end = lambda n: F.col("start") + n + (unit.width - 1)
    found = cut.filter("sure").select("__id", "__hash", F.col("start").alias("first"), end(F.col("n")).alias("last"))
    packed = rows.join(wanted, ["__id", "__hash"]).select("__id", "__hash", "text", "spans").mapInArrow(_pack(unit), _PACKED)
    if often.filter("large").head(1):
        packed = keep(packed, f"{name}-strings")
        divided, single = _divided(unit, packed.filter("large"), name)
        packed = packed.filter("not large")
        packed = packed if divided is None else packed.unionByName(divided)
        if single is not None:
            by = single.groupBy("packed")
            if unit.smaller_id:
                later = single.join(by.agg(F.min("__id").alias("lo")), "packed").filter("__id > lo")
            else:
                later = single.join(by.agg(F.count(F.lit(1)).alias("k"), F.max("sure").alias("again")).filter("k > 1 or again"), "packed", "left_semi")
            found = found.unionByName(later.select("__id", "__hash", F.col("start").alias("first"), end(F.lit(1)).alias("last")))
    found = found.unionByName(packed.repartition("m").sortWithinPartitions("m", "__id").mapInArrow(_buckets(unit, find), _RANGES))
    return found.groupBy("__id", "__hash").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __hash, text).  Both uses of the texts read these columns only, so that they share one shuffle."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("text"))


def doc_id() -> Column:
    """The id again (the smallest long stands for null)."""
    return F.when(F.col("__id") != NULL_ID, F.col("__id")).alias("doc_id")
