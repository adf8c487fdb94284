"""Simple-8b: word-aligned packing of non-negative ids into 64-bit words.

The top four bits of a word select how many ids it holds and how wide they are; 60 bits remain. Greedy
packing takes at each place the selector with most ids. Ids are packed in blocks; each block starts a word
of its own, so that blocks can be decoded apart. Ids too wide for the widest selector are escapes: a 0
stands in the word, and the block lists their places and values.

Packing and unpacking are array operations; blocks are walked side by side.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# Ids per word and their width in bits, by selector.
SELECTORS = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
    (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
WIDEST = 30
BLOCK = 4096


@dataclass(frozen=True)
class Block:
    """Packed words of ``count`` ids, and the places and values of escapes."""

    count: int
    words: np.ndarray
    places: np.ndarray
    values: np.ndarray


def _classes(ids: np.ndarray) -> np.ndarray:
    """The narrowest selector that is wide enough for each id."""
    limits = np.array([1 << bits for _, bits in SELECTORS[:-1]], np.uint64)
    if int(ids.max()) < 1 << 16:  # a table does it
        table = np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
        return table[ids.astype(np.uint16)]
    return np.searchsorted(limits, ids, side="right").astype(np.uint8)


def _runs(good: np.ndarray, count: int) -> np.ndarray:
    """Where ``count`` true values follow each other, as a mask of their first places."""
    n = len(good)
    if n < count:
        return np.zeros(n, bool)
    places = np.flatnonzero(good) if np.count_nonzero(good) < n // 8 else None
    if places is not None:
        out = np.zeros(n, bool)
        first = places[: max(len(places) - count + 1, 0)]
        out[first[places[count - 1 :] - first == count - 1]] = True
        return out
    out, span = good, 1
    while span < count:
        step = min(span, count - span)
        shifted = np.zeros(n, bool)
        np.logical_and(out[: n - step], out[step:], out=shifted[: n - step])
        out = shifted
        span += step
    return out


def _starts(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and their selectors. A word never runs over the end of a block."""
    n = len(ids)
    needed = _classes(ids)
    # Ids of the block that are left at each place, no more than a word can hold.
    most = SELECTORS[0][0]
    pattern = np.minimum(np.arange(block, 0, -1), most).astype(np.uint8)
    left = np.tile(pattern, -(-n // block))[:n]
    left[max(0, n - most) :] = np.minimum(left[max(0, n - most) :], np.arange(min(n, most), 0, -1))
    last = len(SELECTORS) - 1
    chosen = np.full(n, last, np.uint8)
    for s, (count, _) in enumerate(SELECTORS[:-1]):
        fits = _runs(needed <= s, count) & (left >= count)
        # The first selector that fits holds most ids.
        np.minimum(chosen, np.uint8(s) + np.uint8(last) * (~fits).view(np.uint8), out=chosen)
    # From word to word in all blocks side by side.
    jump = np.array([c for c, _ in SELECTORS], np.int64)
    is_start = np.zeros(n, bool)
    at = np.arange(0, n, block)
    ends = np.minimum(at + block, n)
    while len(at):
        is_start[at] = True
        at = at + jump[chosen[at]]
        inside = at < ends
        if not inside.all():
            at, ends = at[inside], ends[inside]
    starts = np.flatnonzero(is_start)
    return starts, chosen[starts]


def pack_blocks(ids: np.ndarray, block: int = BLOCK) -> list[Block]:
    """Blocks of ``block`` ids (the last may be shorter). Ids are unsigned 64-bit."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if n == 0:
        return []
    escaped = np.flatnonzero(ids >> np.uint64(WIDEST))
    packed = ids
    if len(escaped):
        packed = ids.copy()
        packed[escaped] = 0
    starts, chosen = _starts(packed, block)
    words = np.zeros(len(starts), np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(chosen == s)
        if not len(rows):
            continue
        word = np.full(len(rows), np.uint64(s) << np.uint64(60), np.uint64)
        for k in range(count):
            word |= packed[starts[rows] + k] << np.uint64(k * bits)
        words[rows] = word
    edges = np.searchsorted(starts, np.arange(0, n + block, block))
    out = []
    for b, first in enumerate(range(0, n, block)):
        mine = escaped[(escaped >= first) & (escaped < first + block)]
        out.append(
            Block(
                min(block, n - first),
                words[edges[b] : edges[b + 1]],
                (mine - first).astype(np.uint32),
                ids[mine],
            )
        )
    return out


def unpack_words(words: np.ndarray) -> np.ndarray:
    """Ids of whole words; words of any number of blocks may be put together."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[selector]
    ends = np.cumsum(counts)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(selector == s)
        if not len(rows):
            continue
        first = ends[rows] - count
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[first + k] = (words[rows] >> np.uint64(k * bits)) & mask
    return out


# A file: magic, numbers of documents, blocks and ids; document ids and presence, their lengths; then
# for each block its offset in words, number of ids and of escapes; then words, places and values.
MAGIC = b"OLS8"
HEAD = struct.Struct("<4sIQQQ")


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = pack_blocks(ids)
    offsets = np.cumsum([0] + [len(b.words) for b in blocks])
    index = np.array(
        [(o, b.count, len(b.places)) for o, b in zip(offsets, blocks)], dtype=np.uint64
    ).reshape(-1, 3)
    parts = [
        HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(blocks), len(ids)),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.asarray(lengths, "<u8").tobytes(),
        index.astype("<u8").tobytes(),
        *(b.words.astype("<u8").tobytes() for b in blocks),
        *(b.places.astype("<u4").tobytes() for b in blocks),
        *(b.values.astype("<u8").tobytes() for b in blocks),
    ]
    return b"".join(parts)


class Reader:
    """Documents and ids of a file; any run of blocks can be decoded alone."""

    def __init__(self, data: bytes):
        magic, self.block, n_docs, n_blocks, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        present = take("u1", n_docs)
        self.doc_ids = [d if p else None for d, p in zip(take("<i8", n_docs).tolist(), present)]
        self.lengths = take("<u8", n_docs).astype(np.int64)
        self.index = take("<u8", 3 * n_blocks).reshape(-1, 3).astype(np.int64)
        n_escapes = int(self.index[:, 2].sum())
        n_words = (len(data) - at - 12 * n_escapes) // 8
        self.words = take("<u8", n_words)
        self.places = take("<u4", n_escapes)
        self.values = take("<u8", n_escapes)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of blocks ``first`` up to, not including, ``last``."""
        last = len(self.index) if last is None else last
        if first >= last:
            return np.empty(0, np.uint64)
        start = self.index[first, 0]
        stop = self.index[last, 0] if last < len(self.index) else len(self.words)
        out = unpack_words(self.words[start:stop])
        skipped = int(self.index[:first, 2].sum())
        mine = slice(skipped, skipped + int(self.index[first:last, 2].sum()))
        block = np.repeat(np.arange(last - first), self.index[first:last, 2])
        out[block * self.block + self.places[mine]] = self.values[mine]
        return out
