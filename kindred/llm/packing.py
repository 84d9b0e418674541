"""Hierarchical multi-length packing of tokenised documents.

Each task packs the documents it has read; no row leaves its task, so there is
no shuffle and no group that can grow hot.  A document's ids are first cut into
whole windows of the longest tier; what is left is routed to the smallest tier
that holds it.  Tiers are packed from long to short: each remainder opens a
window of its tier and the gap is filled with the longest waiting pieces of the
shorter tiers that fit, the last of them being cut so that the window is full.
At the end of a task the ids that fill no window are laid out in windows of
powers of two, so nothing is ever padded.  Windows are numbered, and ``step``
groups them so that all steps of a tier hold the same number of tokens.

Null text is empty: such a document has only the end token.  Rows with the same
id are packed each on its own, equal texts included.  A very long text is
encoded whole, in pieces.  Empty tables give empty results; other columns are
ignored.  Memory holds at most ``POOL_TOKENS`` waiting ids, the remembered
pieces and about a megabyte of texts, one text at least.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 32 * 2048
POOL_TOKENS = 1 << 20
#: Texts may be cut before a space or line end that follows one of these: no token spans that place, and no token choice looks across it.
_SPLIT = re.compile("(?<=[!-~À-ɏ])(?=[ \n])")
#: Also after a letter before punctuation, in texts without special tokens (they are looked for first, across such places).
_FINE = re.compile("(?<=[!-~À-ɏ])(?=[ \n])|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[!-/:-@\\[-`{-~])")
#: Without these, all places before a space or line end are such places.
_ODD = re.compile("[ \n][ \n]|[^!-~À-ɏ \n]")
#: The same for texts of one byte a character, by deleting what is not odd.
_EVEN = bytes(c for c in range(256) if not _ODD.search(chr(c)))
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_LONGEST_KEPT, _MOST_KEPT = 48, 500_000
#: Characters whose pieces are looked up together.
_RUN = 1 << 20

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step long"
_TYPES = [pa.int64()] * 8 + [pa.int32(), pa.int64()]
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself, or the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


def _odd(text: str) -> bool:
    """Whether ``_ODD`` is found."""
    try:
        return bool(text.encode("latin-1").translate(None, _EVEN)) or any(p in text for p in _PAIRS)
    except UnicodeEncodeError:
        return _ODD.search(text) is not None


class _Words(dict):
    """Words' ids, made when first looked up; ``long``: words that are not to be kept."""

    def __init__(self, make) -> None:
        self.make, self.long = make, []

    def __missing__(self, word: str) -> bytes:
        if len(word) > _LONGEST_KEPT:
            self.long.append(word)
        return self.make(word)


class Encoder:
    """Texts to their ids as little-endian 32-bit bytes.

    All ids come from the tokenizer.  A text is cut into words and these into
    pieces where that can't change a token, and each distinct one is encoded
    once as long as it is remembered.  Plain words are one pre-token each, so
    they go to the tokenizer's model itself.
    """

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        level = made["pre_tokenizer"] or {}
        #: Whether words may go to the model.
        self.plain = level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space") and made["normalizer"] is None
        #: By a word, for it with the space before it (or its own line end), and by a piece.
        self.words = _Words(self.word)
        self.pieces: dict[str, bytes] = {}

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        """Pieces, and the words after them."""
        if any(s in text for s in self.special):
            return _SPLIT.split(text), []
        if _odd(text):
            return _FINE.split(text), []
        first, *words = text.replace("\n", " \n").split(" ")
        return _FINE.split(first), words

    def token(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        if piece.isascii():  # its bytes show as themselves, but for the space
            shown = piece.replace(" ", self.alphabet[32])
        else:
            shown = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
            if len(piece) <= _LONGEST_KEPT:
                self.pieces[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a word and the space before it; a line end instead belongs to the word."""
        ids = self.words.get(word)
        if ids is None:
            if self.plain and word.isalpha():
                ids = self.token(" " + word)
            elif self.plain and word[:1] == "\n" and word[1:].isalpha():
                ids = self.piece("\n") + self.token(word[1:])
            else:
                parts = _FINE.split(word if word[:1] == "\n" else " " + word)
                ids = b"".join([self.word(p[1:]) if len(parts) > 1 and p[:1] == " " else self.word(p) if len(parts) > 1 and p[:1] == "\n" else self.piece(p) for p in parts])
            self.words[word] = ids
        return ids

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            runs, size = [], 0
            while at < len(texts) and size < _RUN:
                size += len(texts[at])
                runs.append(self.cut(texts[at]))
                at += 1
            for pieces, words in runs:
                yield b"".join([*map(self.piece, pieces), *map(self.words.__getitem__, words)])
            for known in (self.words, self.pieces):
                if len(known) > _MOST_KEPT:
                    known.clear()
            for x in self.words.long:
                self.words.pop(x, None)
            self.words.long.clear()


@functools.cache
def encoder(tokenizer_path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(tokenizer_path)


class Packer:
    """Packs one task's documents; ``rows`` gets the pieces of finished windows."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> None:
        self.tiers, self.step_tokens = sorted(tiers, reverse=True), step_tokens
        self.base, self.windows, self.counts = base, 0, {}
        self.rows: list[tuple] = []
        self.pool: list[tuple[int, int, int, bytes, int]] = []  # (length, order, doc, ids, start), by length
        self.totals: dict[int, int] = {}
        self.order = self.tokens = 0

    def window(self, pieces: list[tuple], size: int) -> None:
        total = sum(p[0] for p in pieces)
        step = self.counts[size] = self.counts.get(size, -1) + 1
        at, seq = 0, self.base + self.windows
        self.windows += 1
        for n, _, (doc, whole), ids, start in pieces:
            self.rows.append((doc, start, n, zlib.crc32(ids), whole, seq, at, total, size, self.base + (step * size // self.step_tokens << 12 | size.bit_length())))
            at += n

    def wait(self, n: int, doc: tuple, ids: bytes, start: int) -> None:
        insort(self.pool, (n, self.order, doc, ids, start), key=lambda p: p[:2])
        self.order += 1
        self.tokens += n

    def add(self, doc_id: int | None, ids: bytes) -> None:
        whole, top = len(ids) // 4, self.tiers[0]
        doc = (doc_id, whole)
        for at in range(0, whole - whole % top, top):
            self.window([(top, 0, doc, ids[4 * at : 4 * (at + top)], at)], top)
        if rest := whole % top:
            self.wait(rest, doc, ids[4 * (whole - rest) :], whole - rest)
        if self.tokens >= POOL_TOKENS:
            self.pack()

    def take(self, i: int) -> tuple:
        p = self.pool.pop(i)
        self.tokens -= p[0]
        return p

    def fill(self, size: int) -> list[tuple]:
        """The longest piece that fits, again and again; then a part of the next one."""
        got, gap = [], size
        while gap and self.pool:
            i = bisect_right(self.pool, gap, key=lambda p: p[0]) - 1
            if i >= 0:
                got.append(self.take(i))
            else:
                n, _, doc, ids, start = self.take(0)
                got.append((gap, 0, doc, ids[: 4 * gap], start))
                self.wait(n - gap, doc, ids[4 * gap :], start + gap)
            gap -= got[-1][0]
        return got

    def pack(self) -> None:
        """All windows that waiting ids fill; for each tier as long as a piece is routed to it."""
        for size, below in zip(self.tiers, [*self.tiers[1:], 0], strict=True):
            while self.tokens >= size and self.pool[-1][0] > below:
                self.window(self.fill(size), size)

    def finish(self) -> None:
        self.pack()
        size = self.tiers[0]
        while self.pool:
            while size > self.tokens:
                size //= 2
            self.window(self.fill(size), size)


def _pack(tokenizer_path: str, end_id: int, tiers: tuple[int, ...], step_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).ids
        packer = Packer(TaskContext.get().partitionId() << 34, tiers, step_tokens)
        end = np.array([end_id], dtype="<u4").tobytes()

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [()] * len(_NAMES)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)

        for batch in spans.slim(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                packer.add(doc, ids + end)
                if len(packer.rows) >= 20_000:
                    yield out()
        packer.finish()
        yield out()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, tier, step."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pack(tokenizer_path, end_id, tuple(tiers), step_tokens), _SCHEMA)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
