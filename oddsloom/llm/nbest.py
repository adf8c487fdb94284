"""N-best segmentation over a piece lattice, and decoding.

The pieces and scores of a sentencepiece model span a lattice over the text: an edge for each piece that
matches. Forward Viterbi scores give, for each position, the best score from the start. A search from the end
backwards, ordered by its own score plus the forward score, is A* with an exact heuristic: its paths come
out best first.

No piece of such a model has a space mark after another character, and none puts Latin letters and other
characters together (both are checked when the model is read). So the lattice falls apart into units: a run of
Latin letters or of other characters, with the spaces before it. Units recur; each is solved once per worker:
its best path, and by how much its second path is worse. For the n best paths of a text only the n - 1 units with
the smallest such loss can matter, for each of them alone already gives n - 1 paths that are no worse than any
path that changes another unit. So A* runs on these units, and their lists are merged.

Scores are counted in the largest power of two of which every piece's score is a multiple (1 for a model of whole
scores), so sums are exact for log probabilities too. A character that no piece covers is spelt in byte pieces,
at the lowest score less 10.

Defined cases: null and empty texts have one segmentation, the empty one; texts with fewer segmentations
than n give those; ties go to the longer last piece, then to the earlier unit; repeated rows get equal
answers; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.byte_pair import LATIN
from oddsloom.llm.shingles import slices

CACHED_UNITS = 800_000
LONGEST_CACHED = 48
MARK = "▁"
#: A mark that stands in a text is to the lattice what a space is.
UNIT = re.compile(f"[ {MARK}]*(?:[{LATIN}]+|[^{LATIN} {MARK}]+)|[ {MARK}]+")
NO_OTHER = 1 << 62


class Lattice:
    """Pieces of a model; segments units and decodes ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Characters of pieces; "" holds the score and ids of the piece that ends there.
        self.trie: dict = {}
        lowest = 0
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        scores = [model.get_score(i) for i in range(model.vocab_size())]
        #: Scores are counted in parts of 1 / scale.
        self.scale = max(score.as_integer_ratio()[1] for score in scores)
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                score = int(scores[i] * self.scale)
                node = self.trie
                for character in piece:
                    node = node.setdefault(character, {})
                node[""] = (score, (i,))
                if scores[i] > -(10**8):
                    lowest = min(lowest, score)
                if len(UNIT.findall(piece.replace(MARK, " "))) != 1:
                    raise ValueError(f"piece {piece!r} spans units")
        self.unknown = lowest - 10 * self.scale
        self.units: dict[str, tuple[bytes, int, int]] = {}

    def edges(self, unit: str) -> list[tuple]:
        """Edges (start, end, score, ids) of the unit's lattice, by start."""
        text = unit.replace(" ", MARK)
        out: list[tuple] = []
        for i in range(len(text)):
            node, known = self.trie, False
            for j in range(i, len(text)):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    known = known or j == i
                    out.append((i, j + 1, *node[""]))
            if not known:
                spelt = tuple([self.byte_ids[b] for b in text[i].encode()])
                out.append((i, i + 1, self.unknown, spelt))
        return out

    def solve(self, unit: str) -> tuple[bytes, int, int]:
        """Ids (unsigned 32-bit) and score of the best path, and how much worse the second one is.

        The forward pass keeps the two best scores up to each position, of different paths.
        """
        text = unit.replace(" ", MARK)
        n = len(text)
        best = [0] + [-NO_OTHER] * n
        second = [-NO_OTHER] * (n + 1)
        via: list[tuple] = [()] * (n + 1)
        root = self.trie
        for i in range(n):
            top, next_ = best[i], second[i]
            node, known = root, False
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                found = node.get("")
                if found is not None:
                    score, ids = found
                    j += 1
                    if j == i + 1:
                        known = True
                    total = top + score
                    if total > best[j]:
                        other = best[j]
                        best[j] = total
                        via[j] = (i, ids)
                        if next_ + score > other:
                            other = next_ + score
                    else:
                        other = total
                    if other > second[j]:
                        second[j] = other
            if not known:
                ids = tuple([self.byte_ids[b] for b in text[i].encode()])
                total, other = top + self.unknown, next_ + self.unknown
                if total > best[i + 1]:
                    other = max(other, best[i + 1])
                    best[i + 1] = total
                    via[i + 1] = (i, ids)
                else:
                    other = total
                second[i + 1] = max(second[i + 1], other)
        parts = []
        at = n
        while at:
            at, ids = via[at]
            parts.append(ids)
        out = array("I")
        for ids in reversed(parts):
            out.extend(ids)
        loss = best[n] - second[n]
        return out.tobytes(), best[n], loss if loss < NO_OTHER // 2 else NO_OTHER

    def paths(self, unit: str, n: int) -> list[tuple[int, bytes]]:
        """Loss and ids of the n best paths of a unit, by A* from its end."""
        best = [0] + [-NO_OTHER] * len(unit)
        into: list[list[tuple]] = [[] for _ in best]
        for edge in self.edges(unit):
            into[edge[1]].append(edge)
            best[edge[1]] = max(best[edge[1]], best[edge[0]] + edge[2])
        total = best[-1]
        # Among equals the path that is nearest to its end goes first; else all equal paths would grow together.
        queue: list[tuple[int, int, int, int, tuple]] = [(0, len(best) - 1, 0, 0, ())]
        tick, out = 0, []
        while queue and len(out) < n:
            loss, at, _, score, ids = heapq.heappop(queue)
            if at == 0:
                out.append((loss, array("I", ids).tobytes()))
                continue
            for start, _, gain, own in into[at]:
                tick += 1
                heapq.heappush(
                    queue,
                    (total - best[start] - score - gain, start, tick, score + gain, own + ids),
                )
        return out

    def encode(self, text: str | None, n: int) -> list[tuple[int, bytes]]:
        """Score and ids of the n best segmentations, best first."""
        if not text:
            return [(0, b"")]
        units = UNIT.findall(" " + text)
        cache = self.units
        solved = list(map(cache.get, units))
        if None in solved:
            for at, known in enumerate(solved):
                if known is None:
                    unit = units[at]
                    # A unit new to this text may stand in it twice.
                    solved[at] = known = cache.get(unit) or self.solve(unit)
                    if len(unit) <= LONGEST_CACHED:
                        cache[unit] = known
            if len(cache) > CACHED_UNITS:
                cache.clear()
        parts, scores, losses = map(list, zip(*solved))
        total = sum(scores)
        choices: list[tuple[int, tuple]] = [(0, ())]
        if n > 1:
            narrow = heapq.nsmallest(n - 1, range(len(losses)), key=losses.__getitem__)
            for at in sorted(at for at in narrow if losses[at] < NO_OTHER):
                own = self.paths(units[at], n)
                # The first path is the cached one, whatever the order among equals.
                own = [(0, parts[at])] + [p for p in own if p[1] != parts[at]][: n - 1]
                choices = heapq.nsmallest(
                    n,
                    ((a + b, chosen + ((at, ids),)) for a, chosen in choices for b, ids in own),
                    key=lambda c: c[0],
                )
        out = []
        for loss, chosen in choices:
            changed = [(at, parts[at]) for at, _ in chosen]
            for at, ids in chosen:
                parts[at] = ids
            out.append((total - loss, b"".join(parts)))
            for at, ids in changed:
                parts[at] = ids
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids (unsigned 32-bit); the mark that stands before every text is dropped."""
        found = array("I")
        found.frombytes(ids)
        body = b"".join(map(self.raw.__getitem__, found))
        return body[body[:1] == b" " :].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """One lattice for each Python worker."""
    return Lattice(path)


def segment(
    docs: DataFrame, model: str, n: int = 3, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, rank (from 1), score, n_pieces, ids_crc32 and round_trip of the n best segmentations.

    ``score`` is in the units of ``Lattice``, whole numbers for a model of whole scores. ``round_trip`` tells whether the best one's ids decode to the text; ``with_ids`` adds the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model)
        for batch in batches:
            for rows in slices(batch, 1):
                out: list[list] = [[], [], [], [], [], [], []]
                for key, body in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    found = pieces.encode(body, n)
                    back = pieces.decode(found[0][1]) == (body or "")
                    for rank, (score, ids) in enumerate(found, 1):
                        row = (key, rank, score, len(ids) // 4, zlib.crc32(ids), back, ids)
                        for column, value in zip(out, row):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "round_trip", "ids"]
                keep = 7 if with_ids else 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out[:keep], kinds)], names[:keep]
                )

    shape = "doc_id long, rank int, score long, n_pieces long, ids_crc32 long, round_trip boolean"
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        run, shape + (", ids binary" if with_ids else "")
    )
