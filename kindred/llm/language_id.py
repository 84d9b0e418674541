"""Language identification with bit-sliced Bloom filters of n-grams.

One Bloom filter for each language, stored as slices: a table entry holds one
bit per language, so that the AND of an n-gram's entries gives all languages
that may contain it at once.  A text is judged by the share of its n-grams that
each language contains, corrected for that filter's false positives.

N-grams are four bytes of the lower-cased text, anything but letters being a
space.  A language's filter holds those that occur in at least ``min_share`` of
its sampled documents (a bounded sample: about ``sample_docs`` of each
language, chosen by a hash of the id); all documents are judged.  The filters
are built by one aggregation to table entries, so what reaches the driver has
the table's size, whatever the corpus is.

Null text, and text without any letter, is ``und`` with score 0.  With no
labelled documents all texts are ``und``.  Of languages with equal shares the
first in alphabetical order is taken.  Very long texts are judged whole.  More
than ``MAX_LANGUAGES`` distinct labels are an error (a filter of 64 languages
takes 2 MB, and each is counted in turn), not cut off.  A null id is neither learned from
nor held out.  Repeated rows are judged alike.  Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans

U = np.uint64
GRAM = 4
FOLDS = 5
MAX_LANGUAGES = 1024
UNKNOWN = "und"
#: Bytes of text that are looked through at once (one text at least); arrays take some forty times as much.
RUN_BYTES = 1 << 18


@dataclass(frozen=True)
class Training:
    sample_docs: int = 4000
    min_share: float = 0.01
    min_docs: int = 2
    table_bits: int = 18
    hashes: int = 3


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    usual: int
    tables: np.ndarray  # (64 languages each, entry)
    false_positives: np.ndarray
    hashes: int


def _grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, gram, row) of runs of rows; gram: four bytes as one number."""
    at = 0
    while at < len(texts):
        parts, size = [], 0
        first = at
        while at < len(texts) and (size < RUN_BYTES or not parts):
            raw = f" {texts[at].lower()}  ".encode("utf-8", "replace")
            parts.append(raw)
            size += len(raw)
            at += 1
        data = np.frombuffer(b"".join(parts), np.uint8)
        data = np.where((data >= 128) | ((data >= 97) & (data <= 122)), data, np.uint8(32))
        offsets = np.append(0, np.cumsum([len(p) for p in parts]))
        row = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff(offsets))
        wide = data.astype(np.uint32)
        gram = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        inside = (row[:-3] == row[3:]) & (gram != 0x20202020)
        yield first, gram[inside], row[:-3][inside]


def _entries(gram: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    h = spans.mix(gram.astype(U) + U(0x9E3779B97F4A7C15))
    return [((h >> U(k * bits)) & U((1 << bits) - 1)).astype(np.int64) for k in range(hashes)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, gram, documents that have it), summed for a run of rows."""
    for b in spans.slim(batches, 1):
        langs = b.column(0).to_numpy()
        for first, gram, row in _grams([t or "" for t in b.column(1).to_pylist()]):
            pairs = np.unique(row.astype(U) << U(32) | gram.astype(U))
            keys, counts = np.unique(langs[first + (pairs >> U(32)).astype(np.int64)].astype(U) << U(32) | (pairs & U(0xFFFFFFFF)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> U(32)).astype(np.int64)), pa.array((keys & U(0xFFFFFFFF)).astype(np.int64)), pa.array(counts)], names=["l", "gram", "docs"])


def _positions(how: Training):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l = b.column(0).to_numpy()
            for at in _entries(b.column(1).to_numpy(), how.table_bits, how.hashes):
                yield pa.RecordBatch.from_arrays([pa.array(l // 64), pa.array(at), pa.array((U(1) << (l % 64).astype(U)).view(np.int64))], names=["word", "entry", "mask"])

    return run


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, how: Training = Training(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.filter(F.col(lang_col).isNotNull() & (fold(F.col(id_col)) != 0))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted(sizes))
    words = -(-max(1, len(languages)) // 64)
    tables = np.zeros((words, 1 << how.table_bits), dtype=U)
    if languages:
        number = F.create_map(*(F.lit(x) for i, name in enumerate(languages) for x in (name, i)))
        share = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, how.sample_docs / sizes[name]))))
        pick = F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(1 << 20)) < share[F.col(lang_col)] * (1 << 20)
        sample = rows.filter(pick).select(number[F.col(lang_col)].cast("long").alias("l"), F.col(text_col).alias("text"))
        counts = sample.mapInArrow(_count, "l long, gram long, docs long").groupBy("l", "gram").agg(F.sum("docs").alias("docs"))
        least = F.create_map(*(F.lit(x) for i, name in enumerate(languages) for x in (i, float(max(how.min_docs if sizes[name] > 1 else 1, how.min_share * min(how.sample_docs, sizes[name]))))))
        often = counts.filter(F.col("docs") >= least[F.col("l").cast("int")]).select("l", "gram")
        for word, entry, mask in often.mapInArrow(_positions(how), "word long, entry long, mask long").groupBy("word", "entry").agg(F.bit_or("mask")).collect():  # the table's size at most
            tables[word, entry] = mask & 0xFFFFFFFFFFFFFFFF
    fill = np.array([((tables[i // 64] >> U(i % 64)) & U(1)).mean() for i in range(len(languages))])
    usual = max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i), default=0)
    return Model(languages, usual, tables, fill**how.hashes, how.hashes)


_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")


def _lettered(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _predict(model: Model):
    bits = int(model.tables.shape[1]).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slim(batches, 1):
            texts = b.column(1).to_pylist()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for first, gram, row in _grams([t or "" for t in texts]) if model.languages else ():
                rows = int(row[-1]) + 1 if len(row) else 0
                n = np.bincount(row, minlength=rows)
                share = np.zeros((len(model.languages), rows))
                at = _entries(gram, bits, model.hashes)
                for word, table in enumerate(model.tables):
                    hit = table[at[0]]
                    for x in at[1:]:
                        hit = hit & table[x]
                    for i in range(64 * word, min(64 * word + 64, len(model.languages))):
                        share[i] = np.bincount(row, weights=((hit >> U(i % 64)) & U(1)).astype(np.float64), minlength=rows) / np.maximum(n, 1)
                fp = model.false_positives[:, None]
                share = np.clip((share - fp) / np.maximum(1e-9, 1 - fp), 0, 1)
                best = np.where(share.max(axis=0) > 0, share.argmax(axis=0), model.usual)
                for r in range(rows):
                    if _lettered(texts[first + r]):
                        pred[first + r], score[first + r] = model.languages[best[r]], share[best[r], r]
            # letters, but no n-gram that counts: the usual language, score 0
            for r, t in enumerate(texts):
                if model.languages and pred[r] == UNKNOWN and _lettered(t):
                    pred[r] = model.languages[model.usual]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the share of its n-grams that the language contains)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def _judge(model: Model, names: list[str], text: str, min_score: float):
    inner = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slim(batches, names.index(text)):
            said = next(inner(iter([pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(names.index(text))], names=["doc_id", "text"])])))
            good = np.array([x != UNKNOWN for x in said.column(1).to_pylist()], dtype=bool) & (said.column(2).to_numpy() >= min_score)
            yield b.filter(pa.array(good))

    return run


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """The rows whose language is known with at least this score; all columns."""
    return docs.mapInArrow(_judge(model, docs.columns, text_col, min_score), docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    said = identify(docs, learn(docs))
    return said.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
