"""Token counts at every prefix of a text, by prefix dynamic programming over a byte-fallback BPE model.

A sequence of pieces is what merging gives exactly when each two neighbours are, for merges inside one piece do
not see the others (ties go to the left, on both sides of this statement). So the last piece of a prefix is the
one that ends there, starts where another prefix ends, and goes with that prefix's last piece; the prefix has
one token more than the other. One pass over the text gives the count of every prefix, without encoding any of
them. Whether two pieces go together is read from their histories: the priorities of the merges that make each
and the symbols at the touching ends meanwhile. It is asked once for each pair.

No piece spans two units (a run of Latin letters, or of other characters, with the spaces before it; checked
when the model is read), so counts of units are put end to end, and those of units that recur are looked up.

What is stored: for each code point by how much it changes the count (one signed byte; a further character can also
join pieces and lower it), and the count before each block of ``BLOCK`` code points. The count of any prefix, the
longest prefix within a budget and the cuts of a text into windows are read from these.

Defined cases: null and empty texts have no tokens, so has the empty prefix of any text; a longest prefix may end
inside a word, and is the longest of all, though a shorter one may have more tokens; prefix lengths are cut to 0 and
the text's length, and a null length or budget gives null; repeated rows get equal answers; rows with a null id
stay; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsloom.llm.nbest import MARK, UNIT
from oddsloom.llm.shingles import slices

BLOCK = 1024
CACHED_UNITS = 800_000
CACHED_PAIRS = 2_000_000
LONGEST_CACHED = 48
NEVER = float("-inf")


class PrefixCounter:
    """Pieces of a BPE model with their histories; counts of units."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                self.score[piece] = model.get_score(i)
                if len(UNIT.findall(piece.replace(MARK, " "))) != 1:
                    raise ValueError(f"piece {piece!r} spans units")
        if model.encode("a a", out_type=str) != ["▁a", "▁a"]:
            raise ValueError("the model must put a mark before the text and keep spaces")
        #: Characters of pieces; "" holds the piece that ends there.
        self.trie: dict = {}
        self.history: dict[str, tuple] = {}
        for piece in self.score:
            if not all(c in self.score for c in piece):
                raise ValueError(f"piece {piece!r} has a character that is no piece")
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, tuple[bytes, int]] = {}

    def merges(self, piece: str) -> tuple:
        """(priorities, left ends, right ends) of the merges that make a piece; () if it is never made."""
        known = self.history.get(piece)
        if known is not None:
            return known
        score, parts = self.score, list(piece)
        ranks, lefts, rights = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1], NEVER)
                if found > best:
                    best, at = found, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ranks.append(best)
            lefts.append(parts[0])
            rights.append(parts[-1])
        made = (*ranks, NEVER), tuple(lefts), tuple(rights)
        self.history[piece] = made = made if len(parts) == 1 else ()
        return made

    def together(self, a: str, b: str) -> bool:
        """True if the merges of both pieces leave the border between them alone."""
        first, _, rights = self.merges(a)
        second, lefts, _ = self.merges(b)
        score, i, j = self.score, 0, 0
        across = score.get(rights[0] + lefts[0], NEVER)
        while True:
            p, q = first[i], second[j]
            if p >= q:
                if p == NEVER:
                    return across == NEVER
                if across > p:
                    return False
                i += 1
                if rights[i] != rights[i - 1]:
                    across = score.get(rights[i] + lefts[j], NEVER)
            else:
                if across >= q:
                    return False
                j += 1
                if lefts[j] != lefts[j - 1]:
                    across = score.get(rights[i] + lefts[j], NEVER)

    def unit(self, unit: str) -> tuple[bytes, int]:
        """By how much each character of a unit changes the count (signed bytes), and the count of the whole."""
        text = unit.replace(" ", MARK)
        n = len(text)
        count = [0] * (n + 1)
        last: list[str] = [""] * (n + 1)
        pairs, merges, root = self.pairs, self.history, self.trie
        for i in range(n):
            before, more = last[i], count[i] + 1
            node = root.get(text[i])
            if node is None:
                # Spelt in bytes; nothing merges with it.
                count[i + 1] = count[i] + len(text[i].encode())
                continue
            j = i + 1
            while node is not None:
                piece = node.get("")
                if piece is not None:
                    if piece not in merges:
                        self.merges(piece)
                    if merges[piece]:
                        if not before:
                            good = True
                        else:
                            good = pairs.get((before, piece))
                            if good is None:
                                if len(pairs) > CACHED_PAIRS:
                                    pairs.clear()
                                pairs[before, piece] = good = self.together(before, piece)
                        if good:
                            count[j] = more
                            last[j] = piece
                if j == n:
                    break
                node = node.get(text[j])
                j += 1
        return array("b", [b - a for a, b in zip(count, count[1:])]).tobytes(), count[n]

    def steps(self, text: str | None) -> tuple[list[bytes], int]:
        """Changes at each code point, unit by unit, the first one at the mark before the text; the whole count."""
        if not text:
            return [], 0
        units = UNIT.findall(" " + text)
        cache = self.units
        found = list(map(cache.get, units))
        if None in found:
            for at, known in enumerate(found):
                if known is None:
                    unit = units[at]
                    found[at] = known = cache.get(unit) or self.unit(unit)
                    if len(unit) <= LONGEST_CACHED:
                        cache[unit] = known
            if len(cache) > CACHED_UNITS:
                cache.clear()
        parts, totals = zip(*found)
        return parts, sum(totals)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter for each Python worker."""
    return PrefixCounter(path)


def changes(parts: list[bytes]) -> np.ndarray:
    """One change for each code point of the text; the mark before it counts with the first."""
    if not parts:
        return np.empty(0, np.int8)
    steps = np.frombuffer(b"".join(parts), np.int8)
    head = steps[1:2] + steps[:1]
    return np.concatenate([head, steps[2:]])


def longest(steps: np.ndarray, blocks: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    if budget < 0:
        return 0
    for at in range(len(blocks) - 1, -1, -1):
        counts = blocks[at] + np.cumsum(steps[at * BLOCK : (at + 1) * BLOCK], dtype=np.int64)
        fits = np.flatnonzero(counts <= budget)
        if len(fits):
            return at * BLOCK + int(fits[-1]) + 1
    return 0


def block_counts(steps: np.ndarray) -> np.ndarray:
    """Count before each block of code points."""
    edges = np.arange(0, len(steps), BLOCK)
    if not len(edges):
        return np.empty(0, np.int64)
    sums = np.add.reduceat(steps, edges, dtype=np.int64)
    return np.cumsum(sums) - sums


def prefix_counts(
    docs: DataFrame,
    model: str,
    limit: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
    stored: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, over_limit and fit_chars (code points of the longest prefix within it).

    With ``stored`` also the table that later questions are answered from: ``steps`` and ``blocks``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            for rows in slices(batch, 1):
                texts = rows.column(1)
                totals, fits, kept, blocks = [], [], [], []
                for body in texts.to_pylist():
                    parts, total = count.steps(body)
                    totals.append(total)
                    if stored or total > limit:
                        steps = changes(parts)
                        before = block_counts(steps)
                        fits.append(longest(steps, before, limit))
                        if stored:
                            kept.append(steps.tobytes())
                            blocks.append(before)
                    else:
                        fits.append(len(body or ""))
                sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0)
                chars = pa.compute.fill_null(pa.compute.utf8_length(texts), 0)
                total = pa.array(totals, pa.int64())
                columns = {
                    "doc_id": rows.column(0),
                    "n_bytes": sizes.cast(pa.int64()),
                    "n_chars": chars.cast(pa.int64()),
                    "n_tokens": total,
                    "over_limit": pa.compute.greater(total, limit),
                    "fit_chars": pa.array(fits, pa.int64()),
                }
                if stored:
                    columns["steps"] = pa.array(kept, pa.binary())
                    columns["blocks"] = pa.array(blocks, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    shape = "doc_id long, n_bytes long, n_chars long, n_tokens long, over_limit boolean, fit_chars long"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, shape + (", steps binary, blocks array<long>" if stored else ""))


def _answered(asked: DataFrame, column: str, into: str, answer) -> DataFrame:
    """Adds ``answer(steps, blocks, value of column)`` to rows that have a stored table beside the question."""
    base = asked.select(*[c for c in asked.columns if c != into])
    at = [base.columns.index(c) for c in ("steps", "blocks", column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for steps, before, value in zip(*(batch.column(i) for i in at)):
                value = value.as_py()
                if value is None or not steps.is_valid:
                    found.append(None)
                    continue
                held = np.frombuffer(steps.as_buffer(), np.int8)
                found.append(answer(held, np.array(before.values, np.int64), value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names)

    names = [*base.columns, into]
    shape = T.StructType([*base.schema.fields, T.StructField(into, T.LongType())])
    return base.mapInArrow(run, shape)


def tokens_of_prefix(asked: DataFrame, chars: str = "chars", into: str = "prefix_tokens") -> DataFrame:
    """Adds the token count of the prefix of ``chars`` code points, from stored ``steps`` and ``blocks``."""

    def answer(steps: np.ndarray, blocks: np.ndarray, value: int) -> int:
        value = min(max(value, 0), len(steps))
        if value == 0:
            return 0
        at = (value - 1) // BLOCK
        return int(blocks[at] + steps[at * BLOCK : value].sum(dtype=np.int64))

    return _answered(asked, chars, into, answer)


def prefix_within(asked: DataFrame, budget: str = "budget", into: str = "prefix_chars") -> DataFrame:
    """Adds the code points of the longest prefix of at most ``budget`` tokens, from the stored table."""
    return _answered(asked, budget, into, longest)
