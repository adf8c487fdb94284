"""Token ids of whole texts by a byte-level BPE of the tokenizers library, with a cache of segments.

The pre-tokenizer of such a vocabulary cuts a text before its merges, and no merge crosses a cut. Where a cut
is certain, the ids of the whole are those of the two sides put together. Segments between certain cuts recur,
so most are looked up and only new ones go through the library.

Two rules of cutting are used. In a text of Latin letters without apostrophes (contractions) and without
unusual white space, a run of letters with the one space before it is a piece of its own. In other texts a
piece starts at each single space between two characters that are no white space. A text in which a space stands
beside other white space, or at an end, is one segment, and so is one that holds an added token.

New words with one space before them are encoded as one long text, for a piece starts at each of its spaces; the
ids that begin with a space tell where each word's ids start.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

#: Words encoded as one text.
TOGETHER = 4000
CACHED_SEGMENTS = 700_000
#: Longer segments are encoded but not kept, so the cache stays small.
LONGEST_CACHED = 64

#: The letters of the Latin blocks up to U+024F.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: Letters with a space before them; or what stands up to the next such run. The middle form is the second
#: case without inner spaces, which is the usual one, and faster.
_WORDS = re.compile(f" ?[{LATIN}]+|[^{LATIN} ]+(?= ?[{LATIN}]|\\Z)|(?:(?! ?[{LATIN}]).)+", re.S)
#: Apostrophes, number signs that are no digits, white space other than space and line feed, and all
#: characters beyond the Latin blocks: the first rule does not hold, or is not known to.
_UNSURE = re.compile("['\t\x0b\x0c\r\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


def segments(text: str) -> list[str]:
    """Pieces of a text between certain cuts."""
    if not (_UNSURE.search(text) or "\n\n" in text or " \n" in text):
        return _WORDS.findall(text)
    parts = text.split(" ")
    if "" in parts or any(p[0].isspace() or p[-1].isspace() for p in parts):
        return [text]
    return [parts[0], *[" " + p for p in parts[1:]]]


class ByteEncoder:
    """Encodes batches of texts to bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        # The fast form leaves out character offsets, which nothing reads here.
        self.encode_batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        vocabulary = tokenizer.get_vocab()
        #: Whether an id begins with a space (which the vocabulary spells as U+0120).
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def fresh(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of distinct segments."""
        out: dict[str, bytes] = {}
        words = [s for s in segments if s[0] == " " and s[1:].isalnum()]
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            ids = np.array(self.encode_batch(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            edges = (4 * np.flatnonzero(self.begins[ids])).tolist()
            if len(edges) == len(part):
                data = ids.tobytes()
                out.update(zip(part, [data[a:b] for a, b in zip(edges, [*edges[1:], len(data)])]))
        rest = [s for s in segments if s not in out]
        encoded = self.encode_batch(rest, add_special_tokens=False)
        out.update((s, array("I", e.ids).tobytes()) for s, e in zip(rest, encoded))
        return out

    def cut(self, text: str) -> list[str]:
        """Segments of a text; the whole where an added token stands in it."""
        for literal in self.added:
            if literal in text:
                return [text]
        return segments(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        cache = self.cache
        if len(cache) > CACHED_SEGMENTS:
            cache.clear()
        out: list[bytes] = []
        waiting: list[tuple[int, list[str], list, list[int]]] = []
        fresh: set[str] = set()
        for at, text in enumerate(texts):
            cut = self.cut(text) if text else []
            found = list(map(cache.get, cut))
            if None in found:
                missing = [i for i, ids in enumerate(found) if ids is None]
                fresh.update([cut[i] for i in missing])
                waiting.append((at, cut, found, missing))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if waiting:
            made = self.fresh(list(fresh))
            for at, cut, found, missing in waiting:
                for i in missing:
                    found[i] = made[cut[i]]
                out[at] = b"".join(found)
            cache.update((s, ids) for s, ids in made.items() if len(s) <= LONGEST_CACHED)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """One encoder for each Python worker."""
    return ByteEncoder(path)
