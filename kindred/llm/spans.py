"""Vectorised hashing of Arrow text batches: no per-word Python.

All texts of a batch lie in one byte buffer.  Word bounds come from array
comparisons, and the hash of any byte range from one prefix sum of
``table[byte] * BASE**position`` (mod 2**64); two bases give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are hashed in pieces of about so many bytes, to bound memory.
CHUNK_BYTES = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that all bits of a sum matter."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_TABLES = tuple(mix((np.arange(256, dtype=U) + U(1)) * U(base)) | U(1) for base in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k for k <= n."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES)
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, U(b))
            steps[0] = U(1)
            out.append(np.multiply.accumulate(steps))
        have = _powers[which] = (out[0], out[1])
    return have


class RangeHash:
    """Hashes of ranges of a sequence: of bytes, or of 64-bit values."""

    def __init__(self, values: np.ndarray, which: int = 0) -> None:
        terms = _TABLES[which][values] if values.dtype == np.uint8 else (values if which == 0 else mix(values ^ U(0x5851F42D4C957F2D)))
        up, self.down = powers(which, len(values))
        self.sums = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(terms * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        """For each start, the hash of ``width`` consecutive values."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def pieces(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``size`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def slim(batches: Iterator[pa.RecordBatch], column: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of this column, one row at least: what is made of a batch stays small."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield b.slice(at, end - at)
            at = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each text its first word's number (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    fresh = np.ones(len(data) + 1, dtype=bool)  # nothing of the same text stands before
    fresh[1:-1] = ~solid[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(solid & fresh[:-1])
    last = np.ones(len(data), dtype=bool)
    last[:-1] = ~solid[1:]
    inner = offsets[(offsets > 0)] - 1
    last[inner] = True
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return RangeHash(data, which).of(starts, ends)


def shingles(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, text number and first word's number of all n-word shingles that lie in one text."""
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(word) < n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(len(word) - n + 1, dtype=U)
    for k in range(n):
        total += word[k : len(word) - n + 1 + k] * (mix(np.array([k + 1], dtype=U)) | U(1))
    at = np.flatnonzero(text_of[: len(total)] == text_of[n - 1 :])
    return mix(total[at]), text_of[at], at


_PLACE = 30  # low bits that hold a position while minima are taken


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the position of the smallest by its high bits, the first of equals."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U((1 << _PLACE) - 1)
    # block-wise prefix and suffix minima: two passes whatever the width
    both = np.full(len(hashes) + -len(hashes) % width, ~U(0))
    both[: len(hashes)] = (hashes & ~low) | np.arange(len(hashes), dtype=U)
    both = both.reshape(-1, width)
    ahead = np.minimum.accumulate(both, axis=1).ravel()
    behind = np.minimum.accumulate(both[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the ranges (touching ranges join)."""
    if not len(starts):
        return starts, ends
    key = np.argsort(starts, kind="stable")
    s, reach = starts[key], np.maximum.accumulate(ends[key])
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return s[at], reach[np.append(at[1:] - 1, len(s) - 1)]
