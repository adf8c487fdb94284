"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment decides.

A template of L words is a set of word shingles. Every run of L words of a document is a window (runs
overlap in all but one word). A window of Jaccard similarity s with the template meets it in some band with
chance ``1 - (1 - s^rows)^bands``. A window that holds 80 % of the template's shingles has s of 2/3 or more, which
16 bands of 2 values find with a chance of 0.9999. What meets is verified: the share of the template's
shingles that the window holds must reach ``percent``.

Punctuation at the ends of words does not count. A template of few words allows no other word (at four shingles
one miss is 75 %), and should not: the word may be the one that names the license. Such licenses have several
templates, their usual wordings; the best window of any of them is told.

The MinHash values of all windows of a batch are sliding minima over its shingle hashes, so the work grows
with the text and not with what it holds. A document shorter than a template is one window, verified as it is.

Defined cases: null and empty texts match nothing; windows that match one license and begin less than ``percent``
of a width apart count as one passage, best windows first, and the best is told; repeated rows match alike; an empty table gives an empty
table; only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.shingles import slices, word_hashes

# Notices by which licenses are named in texts.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "proprietary": "All rights reserved.",
}
# Further wordings of the short notices. All their words must stand, so a phrase holds the full name and little more.
WORDINGS = {
    "Apache-2.0": (
        "Apache License Version 2.0", "Apache License v2.0", "Apache License 2.0", "Apache Licence 2.0",
        "Apache Licence Version 2.0", "under Apache 2.0", "under Apache-2.0", "Apache 2.0 License", "Apache-2.0 License",
    ),
    "MIT": (
        "under the MIT License", "under an MIT License", "under a MIT License", "under MIT License",
        "terms of the MIT License", "conditions of the MIT License", "the MIT License MIT", "under the MIT Licence",
        "under an MIT Licence", "terms of the MIT Licence", "is MIT licensed",
    ),
    "CC-BY-NC-4.0": (
        "CC BY-NC 4.0", "CC-BY-NC 4.0", "CC BY NC 4.0", "under CC-BY-NC-4.0", "a CC-BY-NC-4.0", "the CC-BY-NC-4.0",
        "Attribution-NonCommercial 4.0 International", "Attribution-NonCommercial 4.0 License",
        "Attribution Non-Commercial 4.0 International", "Attribution NonCommercial 4.0 International",
    ),
    "proprietary": ("All rights are reserved", "All other rights reserved", "All right reserved"),
}
#: Each license with all its wordings.
ALL_NOTICES = {name: (notice, *WORDINGS.get(name, ())) for name, notice in NOTICES.items()}


@dataclass(frozen=True)
class Bands:
    bands: int = 16
    rows: int = 2
    words: int = 2
    percent: int = 80


def _shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    rolled = hashes[: max(len(hashes) - words + 1, 0)].copy()
    for k in range(1, words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(rolled)]
    return rolled ^ (rolled >> np.uint64(31))


def passages(windows: list[tuple[int, int, int]], percent: int) -> list[tuple[int, int, int]]:
    """The best windows (first, share, width) of which none begins within ``percent`` of another's width, best first.

    Best first, since windows between two notices that stand back to back may be good too, but are not better.
    """
    held: list[tuple[int, int]] = []
    out = []
    for first, share, width in sorted(windows, key=lambda w: (-w[1], -w[2], w[0])):
        end = first + max(1, -(-percent * width // 100))
        at = bisect_left(held, (first, end))
        if (at == 0 or held[at - 1][1] <= first) and (at == len(held) or end <= held[at][0]):
            held.insert(at, (first, end))
            out.append((first, share, width))
    return out


def _seeds(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def sliding_minima(values: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """Minimum of each run of values, for each width: two overlapping runs of a power of two each."""
    out = {}
    span, level = 1, values
    for width in sorted(widths):
        while 2 * span <= width and len(level) > span:
            level = np.minimum(level[:-span], level[span:])
            span *= 2
        n = len(values) - width + 1
        out[width] = np.minimum(level[:n], level[width - span : width - span + n]) if n > 0 else values[:0]
    return out


class Templates:
    """Shingles and band keys of the templates."""

    def __init__(self, notices: Mapping[str, str | tuple[str, ...]], how: Bands):
        self.how = how
        wordings = [
            (name, text)
            for name in sorted(notices)
            for text in ([notices[name]] if isinstance(notices[name], str) else notices[name])
        ]
        self.names = [name for name, _ in wordings]
        self.widths, self.sets = [], []
        self.seeds = _seeds(how.bands * how.rows)
        for _, text in wordings:
            hashes, _ = word_hashes(pa.array([text]), trim=True)
            shingles = _shingles(hashes, how.words)
            self.widths.append(len(shingles))
            self.sets.append(np.unique(shingles))
        self.own = [
            [int(key[len(s)][0]) for key in self.keys(s, [len(s)])] for s in self.sets
        ]

    def keys(self, shingles: np.ndarray, widths: list[int]) -> Iterator[dict[int, np.ndarray]]:
        """By width, the key of each window; one such table for each band."""
        spread = shingles ^ (shingles >> np.uint64(29))
        for band in range(self.how.bands):
            keys: dict[int, np.ndarray] = {}
            for row in range(self.how.rows):
                seed = self.seeds[band * self.how.rows + row]
                for width, least in sliding_minima(spread * seed, widths).items():
                    keys[width] = (
                        keys[width] * np.uint64(0xD6E8FEB86659FD93) + least if width in keys else least
                    )
            yield keys

    def hits(self, shingles: np.ndarray) -> list[np.ndarray]:
        """For each template, the windows of its width (by first shingle) that meet it in a band."""
        found: list[list[np.ndarray]] = [[] for _ in self.names]
        for band, keys in enumerate(self.keys(shingles, sorted(set(self.widths)))):
            for t, width in enumerate(self.widths):
                found[t].append(np.flatnonzero(keys[width] == np.uint64(self.own[t][band])))
        return [np.unique(np.concatenate(f)) for f in found]

    def short(self, shingles: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Template and document where the whole document is shorter and may hold the wanted share.

        ``shingles`` and ``owner`` leave out shingles over the border of two documents.
        """
        for t, (width, wanted) in enumerate(zip(self.widths, self.sets)):
            least = -(-self.how.percent * len(wanted) // 100)
            small = (counts < width) & (counts >= least)
            if small.any():
                mine = small[owner]
                held = np.isin(shingles[mine], wanted)
                enough = np.bincount(owner[mine][held], minlength=len(counts)) >= least
                yield from ((t, doc) for doc in np.flatnonzero(small & enough).tolist())


def scan(
    docs: DataFrame,
    notices: Mapping[str, str | tuple[str, ...]] = NOTICES,
    doc_id: str = "doc_id",
    text: str = "text",
    how: Bands = Bands(),
) -> DataFrame:
    """doc_id, license, passages, first_word and containment (percent) of every document and license found.

    ``notices`` gives each license one template or several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(notices, how)
        for batch in batches:
            for rows in slices(batch, 1):
                hashes, bounds = word_hashes(rows.column(1), trim=True)
                whole = _shingles(hashes, how.words)
                # The document of each shingle; windows over the border of two documents don't count.
                owner = np.searchsorted(bounds, np.arange(len(whole)), side="right") - 1
                last = bounds[owner + 1] - how.words if len(whole) else bounds[:0]
                good: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
                for t, at in enumerate(templates.hits(whole)):
                    width, wanted = templates.widths[t], templates.sets[t]
                    for first in at[at + width - 1 <= last[at]].tolist():
                        held = np.isin(wanted, whole[first : first + width]).sum()
                        share = int(100 * held // len(wanted))
                        if share >= how.percent:
                            key = (templates.names[t], int(owner[first]))
                            good.setdefault(key, []).append((first, share, width))
                inside = np.arange(len(whole)) <= last
                counts = np.maximum(np.diff(bounds) - how.words + 1, 0)
                for t, doc in templates.short(whole[inside], owner[inside], counts):
                    wanted, first = templates.sets[t], int(bounds[doc])
                    held = np.isin(wanted, whole[first : first + counts[doc]]).sum()
                    share = int(100 * held // len(wanted))
                    if share >= how.percent:
                        key = (templates.names[t], doc)
                        good.setdefault(key, []).append((first, share, templates.widths[t]))
                out: list[list] = [[], [], [], [], []]
                for (name, doc), windows in good.items():
                    apart = passages(windows, how.percent)
                    out[0].append(rows.column(0)[doc].as_py())
                    out[1].append(name)
                    out[2].append(len(apart))
                    out[3].append(int(apart[0][0] - bounds[doc]))
                    out[4].append(apart[0][1])
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, kinds)],
                    ["doc_id", "license", "passages", "first_word", "containment"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, license string, passages long, first_word long, containment long"
    )
