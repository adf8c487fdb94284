"""Word shingles of whole texts as 64-bit hashes, computed on the bytes of a whole Arrow batch at once.

Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z in lower case. A word's hash is a
polynomial over random byte values, taken from running sums of the whole buffer; a shingle's hash mixes
those of its words. Two different shingles meet with a chance of about 2 to the -60.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_ODD = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over all (a 64-bit finaliser)."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """Random value of each byte (upper case as lower), and whether it separates words."""
    values = np.random.Generator(np.random.PCG64(20240607)).integers(
        0, 2**64 - 1, 256, dtype=np.uint64, endpoint=True
    )
    values[65:91] = values[97:123]
    separates = np.zeros(256, bool)
    separates[[0x20, *range(0x09, 0x0E)]] = True
    return values, separates


@lru_cache(maxsize=1)
def _punctuation() -> np.ndarray:
    """Which bytes are ASCII punctuation."""
    marks = np.zeros(256, bool)
    marks[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
    return marks


def _trimmed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without punctuation at the ends; a word of nothing else stays as it is.

    Punctuation is that of ASCII, U+2000 to U+203F (quotes, dashes, dots) and the double angle quotes.
    """
    marks = _punctuation()[data]
    at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
    marks[at] = marks[at + 1] = marks[at + 2] = True
    at = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB)))
    marks[at] = marks[at + 1] = True
    solid = np.flatnonzero(~marks)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~marks, out=before[1:])
    low, high = before[begin], before[end]
    some = high > low
    begin, end = begin.copy(), end.copy()
    begin[some] = solid[low[some]]
    end[some] = solid[high[some] - 1] + 1
    return begin, end


_held: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64; ``size`` of them or more."""
    if len(_held.get("power", ())) < size:
        size = 1 << (size - 1).bit_length()
        base, inverse = np.full(size, _ODD, np.uint64), np.full(size, pow(_ODD, -1, 2**64), np.uint64)
        base[0] = inverse[0] = 1
        _held["power"], _held["inverse"] = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _held["power"], _held["inverse"]


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``most`` bytes together, or one longer text."""
    sizes = np.nan_to_num(
        pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    ).astype(np.int64)
    cut = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(cut[1:] != cut[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_hashes(texts: pa.Array, trim: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words start (one more at the end).

    With ``trim`` punctuation at the ends of words does not count.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, last - first, first)
    edges = offsets - first
    values, separates = _byte_values()
    power, inverse = _powers(len(data))
    inside = ~separates[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts_text = edges[:-1][edges[:-1] < edges[1:]]
    begins[starts_text] = inside[starts_text]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[starts_text[1:] - 1] = inside[starts_text[1:] - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(begin, edges)
    if trim:
        begin, end = _trimmed(data, begin, end)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=sums[1:])
    hashed = (sums[end] - sums[begin]) * inverse[begin]
    hashed = _mix(hashed + (end - begin).astype(np.uint64))
    return hashed, bounds


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``words`` make one shingle."""
    hashed, bounds = word_hashes(texts)
    if len(hashed) >= words:
        rolled = hashed[: len(hashed) - words + 1].copy()
        for k in range(1, words):
            rolled = _mix(rolled * np.uint64(_ODD) + hashed[k : len(hashed) - words + 1 + k])
    else:
        rolled = np.empty(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = b - a
        if n >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif n == 0:
            out.append(rolled[:0])
        else:
            whole = hashed[a : a + 1]
            for k in range(a + 1, b):
                whole = _mix(whole * np.uint64(_ODD) + hashed[k : k + 1])
            out.append(_mix(whole + np.uint64(n)))
    return out
