"""Cosine of query texts and documents, one part of an index at a time, with numpy.

A part is the documents of an index at ``PART`` positions; its task gets them with the index's vocabulary and all
its queries, so neither grams nor candidates are shuffled.  Small parts are compared together.  Documents come with
their weights, or as classes (``tfidf.classes``) that are weighed here; an index of one part needs no vocabulary then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import GRAM, PREFIX

#: Positions of one part of an index.
PART = 1 << 14
#: Grams that are compared together (or one part, if it has more), cells of a table, pairs multiplied at once.
GRAMS, CELLS, PAIRS = 1 << 20, 1 << 22, 1 << 16

_BY = ["index_id", "part"]
_VOCABULARY, _WEIGHTS, _CLASSES, _QUERIES = range(4)


def part_of(pos: Column) -> Column:
    return F.floor(pos / PART).cast("long")


def products(texts: DataFrame, others: DataFrame, vocabulary: DataFrame | None, reach: float, least: float | None, *, weights: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(index_id, query, pos, confidence) of the texts (index_id, query) and all documents that have one of a text's sought grams.

    Sought are the rare grams without which the others' norm is under ``reach``.  ``least``: smaller products are
    left out.  ``others``: (index_id, part) of all parts but the first ones.
    """

    def rows(df: DataFrame, kind: int, text: str, w: Column, pos: Column | None = None) -> DataFrame:
        part = F.lit(0).cast("long") if pos is None else part_of(pos)
        return df.select("index_id", part.alias("part"), F.lit(kind).alias("kind"), (F.lit(None) if pos is None else pos).cast("long").alias("pos"), F.col(text).alias("text"), w.cast("double").alias("w"))

    def everywhere(df: DataFrame) -> DataFrame:
        return df.unionByName(df.drop("part").join(others, "index_id"))

    asked = everywhere(rows(texts.filter("query IS NOT NULL"), _QUERIES, "query", F.lit(None)))
    kinds = [asked]
    if vocabulary is not None:
        kinds.append(everywhere(rows(vocabulary.filter("gram IS NOT NULL"), _VOCABULARY, "gram", F.col("idf"))))
    if weights is not None:
        kinds.append(rows(weights, _WEIGHTS, "gram", F.col("w"), F.col("pos")))
    if classes is not None:
        kinds.append(rows(classes, _CLASSES, "text", F.col("copies"), F.col("pos")))
    every = kinds[0]
    for df in kinds[1:]:
        every = every.unionByName(df)
    dealt = every.repartition(*_BY).sortWithinPartitions(*_BY, "kind", "pos")
    return dealt.mapInArrow(_run(reach, least), "index_id bigint, query string, pos bigint, confidence double")


def _run(reach: float, least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _parts(batches):
            yield from _compare(table, reach, least)

    return run


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first one does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole parts, as many as have ``GRAMS`` grams."""
    held: list[pa.RecordBatch] = []
    size, wanted = 0, GRAMS
    count = lambda kind: len(kind) + (PREFIX - GRAM) * int((kind == _CLASSES).sum())
    for batch in batches:
        held.append(batch)
        size += count(batch.column("kind").to_numpy())
        if size >= wanted:
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes(*(table[c].to_numpy() for c in _BY)))[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).to_batches()
            size = count(table["kind"].to_numpy()[last:])
            wanted = max(GRAMS, 2 * size)
    if size:
        yield pa.Table.from_batches(held)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _plain(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def _grams(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(text's number, gram) of all grams of the texts' indexed prefixes."""
    texts = pc.utf8_rpad(pc.utf8_slice_codeunits(texts, 0, PREFIX), GRAM)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False) - GRAM + 1
    numbers, grams = [np.zeros(0, np.int64)], [pa.array([], texts.type)]
    for k in range(int(sizes.max(initial=0))):
        numbers.append(np.flatnonzero(sizes > k))
        grams.append(pc.utf8_slice_codeunits(texts.take(pa.array(numbers[-1])), k, k + GRAM))
    return np.concatenate(numbers), pa.concat_arrays(grams)


def _counted(rows: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times), in order."""
    both, times = np.unique(rows * n + terms, return_counts=True)
    return both // n, both % n, times


def _unit(rows: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    size = np.sqrt(np.bincount(rows, raw * raw, n))[rows]
    return np.divide(raw, size, out=np.zeros_like(raw), where=size != 0)


def _compare(table: pa.Table, reach: float, least: float | None) -> Iterator[pa.RecordBatch]:
    kind, every = table["kind"].to_numpy(), _plain(table["text"])
    known, heavy, whole, asking = (np.flatnonzero(kind == k) for k in (_VOCABULARY, _WEIGHTS, _CLASSES, _QUERIES))
    if not (len(asking) and len(heavy) + len(whole) - every.take(pa.array(whole)).null_count):
        return
    changed = _changes(*(table[c].to_numpy() for c in _BY))
    group = np.cumsum(changed) - 1
    ids, w = table["index_id"].to_numpy()[changed], table["w"].to_numpy()
    at = table["pos"].fill_null(-1).to_numpy()
    counted = whole  # a null text has no grams, but counts
    whole = whole[every.is_valid().to_numpy(zero_copy_only=False)[whole]]
    made, grams = _grams(every.take(pa.array(whole)))
    grams = pa.concat_arrays([every.take(pa.array(np.concatenate([known, heavy]))), grams]).dictionary_encode()
    n = len(grams.dictionary)
    code = grams.indices.to_numpy().astype(np.int64)
    key = np.concatenate([group[known], group[heavy], group[whole][made]]) * n + code
    terms, idf = key[: len(known)], w[known]  # grams of each part

    if len(whole):
        held, own = np.unique(key[len(known) :], return_inverse=True)
        doc, term, times = _counted(made, own, len(held))
        copies, of, pos = w[whole], group[whole], at[whole]
        df = np.bincount(term, copies[doc], len(held))
        sizes = np.bincount(group[counted], w[counted], len(ids))
        given = np.zeros(len(ids), bool)
        given[group[known]] = True
        fresh = ~given[held // n]
        terms = np.concatenate([terms, held[fresh]])
        idf = np.concatenate([idf, (np.log((sizes[held // n] + 1) / (df + 1)) + 1)[fresh]])
    order = np.argsort(terms)
    terms, idf = terms[order], idf[order]
    slot = np.arange(len(terms)) - np.searchsorted(terms, terms // n * n)  # a number within the part
    width = int(slot.max(initial=0)) + 1

    # documents as rows of their terms, and for each term its documents
    if len(whole):
        term = np.searchsorted(terms, held)[term]
        weight = _unit(doc, times * idf[term], len(whole))
        first = np.flatnonzero(_changes(doc))
    else:
        term = np.searchsorted(terms, key[len(known) :])
        weight = w[heavy]
        new = _changes(group[heavy], at[heavy])
        doc, first = np.cumsum(new) - 1, np.flatnonzero(new)
        of, pos = group[heavy[first]], at[heavy[first]]
    place = np.arange(len(doc)) - first[doc]
    theirs, slots = np.zeros((len(first), int(place.max()) + 1)), np.zeros((len(first), int(place.max()) + 1), np.int64)
    theirs[doc, place], slots[doc, place] = weight, slot[term]
    begins = np.searchsorted(of, np.arange(len(ids)))  # each part's first document
    depth = int(np.bincount(of).max())
    order = np.argsort(term, kind="stable")
    holders, sizes = doc[order], np.bincount(term, minlength=len(terms))
    starts = np.cumsum(sizes) - sizes

    texts, parts = every.take(pa.array(asking)), group[asking]
    step = max(1, min(4096, CELLS // max(width, depth)))
    for begin in range(0, len(asking), step):
        some, here = texts.slice(begin, step), parts[begin : begin + step]
        q, mine = _grams(some)
        code = pc.index_in(mine, grams.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        key = here[q] * n + code
        term = np.minimum(np.searchsorted(terms, key), len(terms) - 1)
        there = (code >= 0) & (terms[term] == key)
        q, term, times = _counted(q[there], term[there], len(terms))
        mine = _unit(q, times * idf[term], len(here))
        full = np.zeros((len(here), width))
        full[q, slot[term]] = mine
        # common terms first, so the sum at a term is that of all up to it
        order = np.lexsort((term, idf[term], q))
        q, term, mine = q[order], term[order], mine[order]
        total = np.cumsum(mine * mine)
        upto = total - np.concatenate([[0.0], total])[np.searchsorted(q, q)]
        sought = upto >= reach * reach if reach > 0 else np.ones(len(q), bool)
        q, term = q[sought], term[sought]
        marks = np.zeros((len(here), depth), bool)
        ends = np.cumsum(sizes[term])
        low = 0
        while low < len(q):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS)))
            found = holders[_ranges(starts[term[low:high]], sizes[term[low:high]])]
            marks[np.repeat(q[low:high], sizes[term[low:high]]), found - begins[of[found]]] = True
            low = high
        a, b = np.nonzero(marks)
        b += begins[here[a]]
        for low in range(0, len(a), PAIRS):
            x, y = a[low : low + PAIRS], b[low : low + PAIRS]
            dot = np.einsum("ij,ij->i", full[x[:, None], slots[y]], theirs[y])
            if least is not None:
                kept = dot >= least
                x, y, dot = x[kept], y[kept], dot[kept]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(ids[here[x]]), some.take(pa.array(x)), pa.array(pos[y]), pa.array(dot)], ["index_id", "query", "pos", "confidence"])

