"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes; A-Z are
folded to a-z. Hashes are 64 bit and the same on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return mix(np.arange(n, dtype=_U) + _U(seed * 1_000_003)) | _U(1)


_CODES = np.arange(256)
_UPPER = (_CODES >= 0x41) & (_CODES <= 0x5A)
_IS_WORD = _UPPER | ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)
_BYTE_HASH = mix((_CODES + 32 * _UPPER).astype(_U) + _U(7))
_PLACE = constants(256, 11)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, each of one row at least."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, min(high, rows)
        low = high


def hash_words(data: np.ndarray, offsets: np.ndarray, beginning: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the rows between ``offsets``, in order, and the number of words per row.

    With ``beginning``, only so many first bytes of each word count; shorter words hash as ever.
    """
    rows = len(offsets) - 1
    data, starts = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = _IS_WORD[data]
    if not inside.any():
        return np.zeros(0, _U), np.zeros(rows, np.int64)
    follows = np.zeros(len(data), bool)
    follows[1:] = inside[:-1]
    follows[starts[:-1][starts[:-1] < len(data)]] = False
    place = np.flatnonzero(inside)
    first = np.flatnonzero(~follows[place])
    lengths = np.diff(np.append(first, len(place)))
    within = np.arange(len(place)) - np.repeat(first, lengths)
    top = int(within.max()) + 1
    factors = _PLACE if top <= len(_PLACE) else constants(top, 11)
    values = _BYTE_HASH[data[place]] * factors[within]
    if beginning is not None:
        values[within >= beginning] = 0
    hashes = mix(np.add.reduceat(values, first))
    owner = np.searchsorted(starts, place[first], side="right") - 1
    return hashes, np.bincount(owner, minlength=rows).astype(np.int64)


def positions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner row and place within the row of each of ``counts`` items."""
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - starts[owner]


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words, and how many each row has.

    A row of fewer words, but not none, has one shingle of all its words.
    """
    if not len(words):
        return words, counts
    factors = constants(width, 23)
    padded = np.append(words, np.zeros(width - 1, _U))
    owner, within = positions(counts)
    total = counts[owner]
    value = np.zeros(len(words), _U)
    for j in range(width):
        value += np.where(within + j < total, padded[j : j + len(words)], _U(0)) * factors[j]
    keep = (within + width <= total) | ((within == 0) & (total < width))
    return mix(value[keep]), np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
