"""Words, word hashes and shingles of Arrow text columns, one numpy pass over a block of texts.

The functions run inside Spark tasks on the batches of ``mapInArrow``. A block
holds a few MB of whole texts, so memory follows the block and the longest text
and not the partition. Hashes depend on the bytes alone: every task, retry and
run computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ODD = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)

#: Byte classes: what separates words, A-Z to a-z, and what belongs to a run of letters.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h = h ^ (h >> np.uint64(29))
    h = h * _STEP
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(2 * n, _STEP | np.uint64(1), np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes; a longer text is a range of its own."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0))
    start = total = 0
    for row, size in enumerate(sizes.tolist()):
        if total + size > limit and row > start:
            yield start, row
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, null as empty, and the offsets of its rows."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of a block of texts in order: row, byte range, hash; ``first[r]`` to ``first[r + 1]``
    are the words of row r."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: pa.Array, separator: np.ndarray = IS_SPACE, fold: bool = False) -> Words:
    """Maximal runs of bytes that are no separator, within each row."""
    data, offsets = text_bytes(texts)
    rows = len(offsets) - 1
    if fold:
        data = FOLD[data]
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # A row starts a new word even where the row before ends inside one.
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = inside[cuts]
    start = np.flatnonzero(begins)
    at = np.flatnonzero(inside)
    first_byte = np.searchsorted(at, start)
    length = np.diff(np.append(first_byte, len(at)))
    row = np.searchsorted(offsets, start, side="right") - 1
    if len(start):
        place = np.arange(len(at)) - np.repeat(first_byte, length)
        value = _BYTE[data[at]] * _power(int(length.max()))[place]
        hashed = mix(np.add.reduceat(value, first_byte) + length.astype(np.uint64) * _ODD[7])
    else:
        hashed = np.zeros(0, np.uint64)
    first = np.searchsorted(row, np.arange(rows + 1))
    return Words(data, row, start, start + length, hashed, first)


def prefix_hash(found: Words, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of each word (the whole word where it is shorter)."""
    length = np.minimum(found.end - found.start, size)
    total = np.zeros(len(length), np.uint64)
    power = _power(size)
    for i in range(size):
        has = length > i
        total[has] += _BYTE[found.data[found.start[has] + i]] * power[i]
    return mix(total + np.uint64(size) * _ODD[6] + length.astype(np.uint64))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words inside a row, in order."""
    n = len(found.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = (total ^ found.hash[i : i + n]) * _ODD[i % 6] + np.uint64(i + 1)
    inside = found.row[:n] == found.row[size - 1 :]
    return mix(total[inside]), found.row[:n][inside]


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` word hashes, by a polynomial over all of them at once.

    Runs may cross rows: the caller drops those."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _ODD[seed]
    ones = np.full(len(hashes) + 1, base, np.uint64)
    ones[0] = 1
    power = np.cumprod(ones, dtype=np.uint64)
    ones[1:] = np.uint64(pow(int(base), -1, 2**64))
    inverse = np.cumprod(ones[: n + 1], dtype=np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(seed)) * power[:-1], out=total[1:])
    return mix((total[size:] - total[:n]) * inverse[:n])
