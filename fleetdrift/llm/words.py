"""Words and shingles of whole Arrow batches, as numpy arrays over the texts' bytes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Nothing here loops over words in Python: a batch is
one byte array, its words are offsets, and a word's hash is a sum of per-byte random values times powers of an odd
base, mixed at the end. Work is done on slices of a MB, so that memory does not follow the batch size; a text
longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_seeded = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _seeded.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUE_LOWER = _BYTE_VALUE.copy()
_BYTE_VALUE_LOWER[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]
_STEP = _seeded.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes: each input bit changes each output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, _BASE, np.uint64))])
    return _powers


def byte_values() -> np.ndarray:
    """The random value of each byte that hashes are made of."""
    return _BYTE_VALUE


@dataclass
class Words:
    """Words of a slice: word ``i`` is ``data[start[i]:end[i]]``; text ``d`` has words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, np.uint64)
        after = np.cumsum(length)
        value = (_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[self.data[~WHITE[self.data]]]
        place = np.arange(after[-1], dtype=np.int32) - np.repeat((after - length).astype(np.int32), length)
        value *= powers(int(length.max()))[place]
        return mix(np.add.reduceat(value, after - length) + length.astype(np.uint64) * _BASE)

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.per_text())


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one longer row. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, index, body = texts.buffers()
    offsets = np.frombuffer(index, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, also_before: np.ndarray | None = None) -> Words:
    """Find the words; ``also_before`` marks further bytes that start a word of their own."""
    n = len(data)
    if not n:
        nothing = np.zeros(0, np.int64)
        return Words(data, offsets, nothing, nothing, np.zeros(len(offsets), np.int64))
    white = WHITE[data]
    begin = ~white
    begin[1:] &= white[:-1]
    text_starts = offsets[:-1][offsets[:-1] < n]
    begin[text_starts] |= ~white[text_starts]
    if also_before is not None:
        begin |= also_before & ~white
    finish = ~white
    finish[:-1] &= white[1:] | begin[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def combine(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` words from each word on, whatever text they belong to: ``len(hashes) - size + 1`` values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64) * _BASE
    for j in range(size):
        out += hashes[j : j + n] * _STEP[j]
    return mix(out)


def shingles(found: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``size`` words; a text of fewer words has all of them as its one shingle."""
    per_text = found.per_text()
    text_of = found.text_of()
    runs = combine(hashes, size)
    whole = text_of[: len(runs)] == text_of[size - 1 :] if len(runs) else np.zeros(0, bool)
    owner, value = text_of[: len(runs)][whole], runs[whole]
    short_owner, short_value = [], []
    for length in range(1, size):
        texts = np.flatnonzero(per_text == length)
        if len(texts):
            at = found.first[texts][:, None] + np.arange(length)
            short_owner.append(texts)
            short_value.append(mix((hashes[at] * _STEP[:length]).sum(axis=1, dtype=np.uint64) + np.full(1, length, np.uint64) * _BASE))
    if short_owner:
        owner = np.concatenate([owner, *short_owner])
        value = np.concatenate([value, *short_value])
    return owner, value
