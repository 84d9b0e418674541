"""N-gram Jaccard self-join: documents whose shingle sets are similar, and their groups.

Two documents link when ``100 * |A & B| >= threshold * |A | B|`` over their
sets of distinct five-word shingles (64-bit hashes).  No link is lost:

1. A document can only link if that share of its shingles occurs elsewhere.
   Packed blocks of hashes count, exactly and over the whole corpus, how many
   of each document's shingles others have; those below go no further.
   Documents with equal sets are one class, of which the smallest id goes on.
2. Rare-first prefix filtering: shingles are ordered by corpus frequency (a
   count sketch of fixed size), and similar sets share one of their first
   ``n - ceil(threshold * n) + 1``.  Prefix rows meet by hash; length,
   positional and suffix filters (a lower bound of the sets' difference: the
   hash space is cut into 512 parts, and a part whose counts differ in parity
   holds a difference) drop pairs, and each that is left is verified once.
3. Groups of thousands of near copies would give all their pairs, so pairs are
   made in steps: first each prefix hash's rows with one hub row of that hash,
   twice with other hubs; then, exhaustively, all rows that share a prefix
   hash but are not yet connected.  Pairs inside a connected group can't change
   its component and are never made.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Fewer than five words
are one shingle; texts without words (null, empty, blank) have an empty set,
link with nothing and are their own component.  Rows with the same id count as
linked, also where their texts differ; ties between equally rare shingles go by
hash; very long texts count whole; a null id links with nothing and has a null component.  Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, spans
from .graph import components
from .store import keep

WORDS, THRESHOLD = 5, 80
#: Ids (8 bytes each) up to which a filter by id is broadcast; beyond, it is a shuffled join.
BROADCAST_IDS = 2_000_000
SKETCH_BITS, SLICE_BITS = 18, 14
PARITY_WORDS = 8
U = np.uint64


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, owner, hash) for runs of rows: the distinct shingles, by owner and hash."""
    for at, data, offsets in spans.pieces(texts):
        data = spans.lower_ascii(data)
        starts, ends, first = spans.words(data, offsets)
        word = spans.word_hashes(data, starts, ends)
        hashes, owner, _ = spans.shingles(word, first, n)
        count = np.diff(first)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            whole = spans.RangeHash(word).of(first[short], first[short + 1])
            hashes = np.concatenate([hashes, spans.mix(whole ^ count[short].astype(U))])
            owner = np.concatenate([owner, short])
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield at, len(offsets) - 1, owner[new], hashes[new]


def _info(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, rows, owner, hashes in shingle_sets(b.column(1), n):
                cut = np.searchsorted(owner, np.arange(rows + 1))
                digests = [hashlib.blake2b(hashes[i:j].tobytes(), digest_size=16).digest() if i < j else None for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, rows), pa.array(np.diff(cut)), pa.array(digests, pa.binary())], names=["doc_id", "n", "digest"])

    return run


def _deal(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = blocks.Dealer(bits)
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, rows, owner, hashes in shingle_sets(b.column(1), n):
                yield from dealer.add(ids[at : at + rows], owner, hashes)
        yield from dealer.flush()

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, rows, owner, hashes in shingle_sets(b.column(1), n):
                cut = np.searchsorted(owner, np.arange(rows + 1))
                parity = np.zeros((rows, PARITY_WORDS * 64), dtype=np.uint8)
                odd, times = np.unique(owner * (PARITY_WORDS * 64) + (hashes >> U(33)).astype(np.int64) % (PARITY_WORDS * 64), return_counts=True)
                parity.ravel()[odd] = times & 1
                bits = np.packbits(parity, axis=1).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, rows), pa.array(np.diff(cut)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * PARITY_WORDS), pa.array(bits))],
                    names=["rep", "n", "hashes", "parity"],
                )

    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's shingle counts by the hashes' high bits, in slices."""
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for b in batches:
        total += np.bincount((b.column(0).flatten().to_numpy().view(U) >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
    parts = total.astype(np.uint32).reshape(-1, 1 << SLICE_BITS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts])], names=["slice", "counts"])


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLICE_BITS, dtype=np.int64)
    for b in batches:
        for c in b.column("counts").to_pylist():
            total += np.frombuffer(c, np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()])], names=["slice", "counts"])


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """Counts of all shingles by 2**SKETCH_BITS hash buckets: a fixed 1 MB, whatever the corpus."""
    parts = sets.select("hashes").mapInArrow(_sketch, "slice long, counts binary").groupBy("slice").applyInArrow(_add, "slice long, counts binary").collect()
    return np.concatenate([np.frombuffer(bytes(r["counts"]), np.uint32) for r in sorted(parts, key=lambda r: r["slice"])] or [np.zeros(1 << SKETCH_BITS, np.uint32)])


def _prefixes(sketch: np.ndarray, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            cut = col.offsets.to_numpy().astype(np.int64)
            hashes = col.values.to_numpy().view(U)[cut[0] : cut[-1]]
            cut = cut - cut[0]
            n = np.diff(cut)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((hashes, sketch[(hashes >> U(64 - SKETCH_BITS)).astype(np.int64)], owner))
            pos = np.arange(len(hashes)) - cut[owner]
            first = pos < (n - -(-threshold * n // 100) + 1)[owner]
            at = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(b.column(0).to_numpy()[owner[first]]), pa.array(n[owner[first]]), pa.array(pos[first])], names=["h", "rep", "n", "pos"])

    return run


def filter_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among the ids (one column ``id``); broadcast only after counting them."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, rows[key] == ids["id"], "left_semi")


def _needed(na: Column, nb: Column, threshold: int) -> Column:
    """The smallest intersection that links."""
    return F.ceil(threshold * (na + nb) / (100 + threshold))


class _Join:
    def __init__(self, sets: DataFrame, prefixes: DataFrame, threshold: int) -> None:
        self.sets, self.prefixes, self.t = sets, prefixes, threshold
        self.checked: DataFrame | None = None

    def pairs(self, left: DataFrame, right: DataFrame, also: Column) -> DataFrame:
        """Distinct pairs (a < b) that share a prefix hash and pass the length, positional and suffix filters."""
        l, r = left.alias("l"), right.alias("r")
        na, nb = F.col("l.n"), F.col("r.n")
        rest = F.least(na - F.col("l.pos"), nb - F.col("r.pos"))
        need = _needed(na, nb, self.t)
        differ = sum((F.bit_count(F.get("l.parity", F.lit(k)).bitwiseXOR(F.get("r.parity", F.lit(k)))) for k in range(PARITY_WORDS)), F.lit(0))
        passes = (F.least(na, nb) * 100 >= self.t * F.greatest(na, nb)) & (rest >= need) & (F.col("l.rep") != F.col("r.rep")) & (differ <= na + nb - 2 * need)
        a_first = F.col("l.rep") < F.col("r.rep")
        out = l.join(r, F.col("l.h") == F.col("r.h")).filter(passes & also)
        return out.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"), F.when(a_first, na).otherwise(nb).alias("na"), F.when(a_first, nb).otherwise(na).alias("nb")).distinct()

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs that were not looked at before."""
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        pairs = keep(pairs, "ngram-pairs")
        seen = pairs.select("a", "b")
        self.checked = seen if self.checked is None else self.checked.unionByName(seen)
        near = pairs.select("a", "b", _needed(F.col("na"), F.col("nb"), self.t).alias("need"))
        whole = self.sets.select("rep", "hashes")
        both = near.join(whole.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a").join(whole.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b")
        return keep(both.filter(F.size(F.array_intersect("ha", "hb")) >= F.col("need")).select("a", "b").distinct(), "ngram-links")

    def labelled(self, roots: DataFrame | None) -> DataFrame:
        """Prefix rows with their component, of hashes that more than one component has."""
        rows = self.prefixes
        if roots is None:
            rows = rows.withColumn("c", F.col("rep"))
        else:
            rows = rows.join(roots, rows["rep"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "rep").alias("c"))
        mixed = rows.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("h")
        bits = self.sets.select("rep", "parity")
        return keep(rows.join(mixed, "h", "left_semi").join(bits, "rep"), "ngram-prefixes")

    def run(self, hubs: int = 2) -> DataFrame:
        """(node, root) of all that link with anything."""
        roots = edges = None
        for k in range(hubs + 1):
            rows = self.labelled(roots)
            apart = F.col("l.c") != F.col("r.c")
            if k < hubs:
                hub = rows.groupBy("h").agg(F.min_by(F.struct("rep", "n", "pos", "c", "parity"), F.xxhash64("rep", "h", F.lit(k))).alias("x")).select("h", "x.*")
                pairs = self.pairs(rows, hub, apart)
            else:
                most = rows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("most"))
                few = rows.join(most, "h").filter("c != most")
                pairs = self.pairs(few, rows, apart & ((F.col("r.c") == F.col("l.most")) | (F.col("l.rep") < F.col("r.rep"))))
            links = self.verify(pairs)
            edges = links if roots is None else links.unionByName(roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = components(edges, name="ngram-components")
        return roots


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    info = keep(rows.mapInArrow(_info(words), "doc_id long, n long, digest binary"), "ngram-info")
    known = rows.filter("doc_id is not null")
    bits = blocks.bits_for(info.agg(F.sum("n")).first()[0] or 0)
    shared = blocks.shared_counts(known.mapInArrow(_deal(words, bits), blocks.SCHEMA)).groupBy("id").agg(F.sum("n").alias("shared"))
    could = info.filter("n > 0").join(shared, F.col("doc_id") == F.col("id")).filter(F.col("shared") * 100 >= threshold * F.col("n")).select("doc_id", "digest")
    classes = could.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = keep(could.join(classes, "digest").select("doc_id", "rep").distinct(), "ngram-members")
    reps = member.select(F.col("rep").alias("id")).distinct()
    sets = keep(filter_ids(known, "doc_id", reps).mapInArrow(_sets(words), "rep long, n long, hashes array<long>, parity array<long>").filter("n > 0"), "ngram-sets")
    prefixes = sets.select("rep", "n", "hashes").mapInArrow(_prefixes(frequency_sketch(sets), threshold), "h long, rep long, n long, pos long")
    roots = _Join(sets, keep(prefixes, "ngram-rare"), threshold).run()
    # an id with several classes joins them
    split = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    if split.head(1):
        pairs = member.join(split, "doc_id").select(F.col("rep").alias("a"), F.col("lo").alias("b")).filter("a != b")
        roots = components(pairs.unionByName(roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))), name="ngram-components")
    of = member.join(roots, F.col("rep") == F.col("node"), "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component"))
    return info.join(of.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
