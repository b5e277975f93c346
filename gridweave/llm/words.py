"""Whole texts as byte, word and shingle arrays: the NumPy helper of the operators that run Python in tasks.

An Arrow column of texts is taken in blocks of about ``BLOCK_BYTES`` bytes (one longer text is a block of
its own), so memory follows the block or the longest text, never the partition. Words are the runs between
separator bytes; their fingerprints are 64-bit and equal for words that are equal after lower-casing A-Z.
Two different words share a fingerprint with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: The separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything but ASCII letters, digits and bytes of longer code points.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
#: A random odd number for each byte; A-Z share those of a-z.
_BYTE = (_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[LOWER]
_BASE = 0x9E3779B97F4A7C15
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


class Block(NamedTuple):
    """Some texts: ``data[offsets[i]:offsets[i + 1]]`` are the bytes of text i, the ``first``-th of the column on."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words in order: text number, start and end byte in the block, fingerprint; and words before each text."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in blocks; null texts are empty."""
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive bounds."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def words(block: Block, separator: np.ndarray = SPACE) -> Words:
    """The words of each text."""
    data, offsets = block.data, block.offsets
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    word = ~separator[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    size = max(n, BLOCK_BYTES)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(_BASE, size)[:n], dtype=np.uint64)])
    back = _power(pow(_BASE, -1, 1 << 64), size)[:n]
    length = (end - start).astype(np.uint64)
    hashed = mixed((total[end] - total[start]) * back[start] + length * np.uint64(0xD6E8FEB86659FD93))
    bounds = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(text, start, end, hashed, bounds)


def sequence_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each text that are equal for equal word sequences; 0, 0 without words."""
    place = (np.arange(len(w.text)) - w.bounds[w.text]).astype(np.uint64)
    one = per_text(mixed(w.hash + place * np.uint64(_BASE)), w.bounds)
    two = per_text(mixed((w.hash ^ np.uint64(_BASE)) * np.uint64(3) + mixed(place + np.uint64(1))), w.bounds)
    return one.view(np.int64), two.view(np.int64)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bounds): all shingles of each text in order; a shorter text's words are one shingle."""
    counts = np.diff(w.bounds)
    n = len(w.hash)
    summed = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        summed[: n - k] += w.hash[k:] * _STEP[k]
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(w.bounds[:-1], made) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], made)
    out = summed[at]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = w.hash[w.bounds[i] : w.bounds[i + 1]]
        out[bounds[i]] = (own * _STEP[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mixed(out), bounds
