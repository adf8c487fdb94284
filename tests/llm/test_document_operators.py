"""Quality rules, sharding, similarity, languages, licenses: edge cases and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from oddsloom.llm import jaccard, langid, licenses, quality, sharding
from oddsloom.llm.queries import LLM_CATALOG

WORD = re.compile("[^\x20\x09-\x0d]+")
# Null and empty texts, white space, ties, repeated rows, a null id, a very long text.
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "one two three"), (6, "one two three"),
    (7, "a b c d e f g"), (8, "A B  c d e\nf g"), (9, "a b c d e f x"), (None, "a b c d e f g"),
    (10, "lone words here only once in all"), (11, "w " * 30000), (12, "no.\n\nyes.\nno."),
]


def frame(spark, rows):
    """Rows with further columns of names that operators use."""
    return spark.createDataFrame(
        [(*r, True, 7, "s", 0.5) for r in rows],
        "doc_id long, text string, kept boolean, n_words int, shard string, score double",
    )


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def repeat_words(words):
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    return len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)})


def test_quality_counts(spark):
    random.seed(3)
    rows = EDGE + [
        (100 + i, "".join(random.choice(["a ", "b ", "c\n", "#", "é. ", "|", "a"]) for _ in range(200)))
        for i in range(40)
    ]
    found = quality.quality_rules(frame(spark, rows)).collect()
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found
    )
    wanted = Counter()
    for key, text in rows:
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        repeats = repeat_words(words)
        failed = len(words) < 50 or 100 * repeats > 50 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        wanted[key, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeats, failed] += 1
    assert got == wanted
    assert not any(r.kept for r in found if r.base_failed)
    assert quality.quality_rules(frame(spark, [])).count() == 0


def test_line_rules(spark):
    good = "This line has quite a few words and ends well. "
    bad = {
        "menu": "home | about | news | sport | contact | help",
        "symbols": "buy### now*** and%%% here$$$ at&&& once###",
        "shout": "READ!! THIS!! NOW!! AND!! BUY!!",
        "cookies": "We use cookies to serve you better.",
        "no end": "words that never come to an end",
    }
    docs = [(i, "\n".join([good * 6, good * 6, line])) for i, line in enumerate(bad.values())]
    docs.append((90, "\n".join([good, *[bad["menu"]] * 9])))
    rows = {r.doc_id: r for r in quality.with_line_verdict(frame(spark, docs)).collect()}
    assert all(r.n_bad_lines == 1 and r.line_kept for k, r in rows.items() if k < 90)
    assert all(r.clean_text == "\n".join([good * 6, good * 6]) for k, r in rows.items() if k < 90)
    assert rows[90].n_bad_lines == 9 and not rows[90].line_kept


def test_shards(spark):
    rows = EDGE + [(1000 + i, "t" * (i % 7)) for i in range(2000)]
    tree = sharding.HashTree.even(4, 2, 5)
    found = sharding.assign(frame(spark, rows), tree, buckets=3).collect()
    assert len(found) == len(rows)
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert set(by_shard) == set(range(40)) and max(map(len, by_shard.values())) < 100
    sums = Counter((r.doc_id, r["size"], r.text_crc32) for r in found)
    assert sums == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    assert 20 < sum(r.grown_shard == 40 for r in found) < 90
    assert sharding.assign(frame(spark, []), tree).count() == 0


def shard_by_hand(key, regions):
    """Three weighted draws, level by level."""

    def winner(children):
        draws = []
        for name, weight, below in children:
            bits = int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16)
            draws.append((-math.log((bits + 0.5) / 2**52) / weight, name, below))
        return min(draws)[1:]

    def total(rack):
        return sum(weight for _, weight in rack)

    _, (i, racks) = winner([(f"region{i}", sum(map(total, r)), (i, r)) for i, r in enumerate(regions)])
    _, rack = winner([(f"rack{i}.{j}", total(rack), rack) for j, rack in enumerate(racks)])
    return int(winner([(f"shard{n}", weight, n) for n, weight in rack])[0].removeprefix("shard"))


def test_places_by_hand(spark):
    uneven = sharding.HashTree(((((0, 1.0), (1, 2.5)), ((2, 0.5),)), (((3, 4.0), (4, 1.0), (5, 1.0)),)))
    for tree in (uneven, sharding.HashTree.even(4, 2, 5)):
        rows = [(i, "") for i in range(300)] + [(None, "x")]
        for r in sharding.assign(frame(spark, rows), tree).collect():
            key = "null" if r.doc_id is None else str(r.doc_id)
            assert r.shard == shard_by_hand(key, tree.regions)
            assert r.grown_shard == shard_by_hand(key, tree.grow().regions)


def test_a_weight_moves_keys_of_its_subtree_only(spark):
    docs = frame(spark, [(i, "") for i in range(3000)])
    even = sharding.HashTree.even(3, 2, 2)
    heavier = sharding.HashTree((*even.regions[:2], (even.regions[2][0], ((10, 1.0), (11, 3.0)))))
    before = {r.doc_id: r.shard for r in sharding.assign(docs, even).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(docs, heavier).collect()}
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    assert moved and all(b in (8, 9, 10, 11) for _, b in moved)


def classes(rows, words, percent):
    """Smallest id reachable by links, by comparing all pairs."""
    sets = []
    for key, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append(
            frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))
            if len(w) >= words
            else frozenset([tuple(w)] if w else [])
        )
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = Counter()
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out[key, len(sets[i]), min(ids, default=None)] += 1
    return out


@pytest.mark.parametrize("words, percent, size", [(4, 85, 96), (5, 80, 3), (2, 50, 4)])
def test_similarity_classes(spark, words, percent, size):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows = list(EDGE)
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 25, 60, 120]))]
        for copy in range(rng.choice([1, 2, 5, 25])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if copy % 5 == 4:
                text += passage.split()
            rows.append((1000 * group + 100 + copy, " ".join(text)))
    rng.shuffle(rows)
    found = jaccard.similarity_classes(frame(spark, rows), words, percent, group_size=size).collect()
    assert Counter(map(tuple, found)) == classes(rows, words, percent)


def test_similarity_of_nothing(spark):
    assert jaccard.similarity_classes(frame(spark, [])).count() == 0


def test_language_edges(spark):
    samples = {"aa": "alpha lambda kappa gamma ", "bb": "zwei drei fünf über schön "}
    rng = random.Random(5)
    rows = [
        (i, " ".join(rng.choice(samples[lang].split()) for _ in range(60)), lang)
        for i in range(60)
        for lang in samples
    ]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = frame(spark, [*EDGE, (50, "LAMBDA Kappa gamma alpha kappa"), (51, "fünf über drei zwei"), (52, "12 .. 3")])
    found = langid.identify(asked, labelled).collect()
    assert len(found) == len(EDGE) + 3
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
        assert 0 <= r.score <= 1
    assert by_id[50][0].lang_pred == "aa" and by_id[51][0].lang_pred == "bb"
    assert all(by_id[k][0].lang_pred == "und" and by_id[k][0].score == 0 for k in (1, 2, 3, 52))
    nothing = langid.identify(asked, labelled.limit(0)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.identify(frame(spark, []), labelled).count() == 0


def language_by_hand(text, dictionaries, how=langid.Compression()):
    """Compressed with each dictionary in turn, chunk by chunk."""
    import zstandard

    words = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()).encode()
    names = sorted(dictionaries)
    if not words or not names:
        return "und", 0.0

    def sizes(level):
        out = []
        for name in names:
            data = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(
                level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            step = how.chunk_bytes
            out.append(sum(len(coder.compress(words[at : at + step])) for at in range(0, len(words), step)))
        return out

    for level in (how.level, how.close_level):
        found = sizes(level)
        best = found.index(min(found))
        others = [size for at, size in enumerate(found) if at != best]
        margin = 1 - found[best] / min(others) if others else 1.0
        if margin >= how.close:
            break
    return names[best], margin


def test_languages_against_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = spark.createDataFrame([(-1, "½ ² Ⅷ ①"), (-2, "½ ² Ⅷ ① und"), (-3, None), (-4, "x")], "doc_id long, text string")
    asked = docs.select("doc_id", "text").union(own)
    dictionaries = langid.fit(docs.filter(~langid.held_out(docs.doc_id)))
    found = {r.doc_id: r for r in langid.predict(asked, dictionaries).collect()}
    for row in asked.collect():
        lang, score = language_by_hand(row.text, dictionaries)
        assert found[row.doc_id].lang_pred == lang and abs(found[row.doc_id].score - score) < 1e-12
    assert found[-1].lang_pred == "und" and found[-1].score == 0 and found[-2].lang_pred != "und"


def test_language_of_long_documents_only_is_learnt(spark):
    long = [(i, "omega sigma tau upsilon phi " * 20000, "xx") for i in range(3)]
    short = [(10 + i, "alpha lambda kappa gamma " * 30, "aa") for i in range(9)] + [(30, "½ Ⅷ", "nn")]
    labelled = spark.createDataFrame(long + short, "doc_id long, text string, lang string")
    dictionaries = langid.fit(labelled)
    assert set(dictionaries) == {"aa", "xx"}
    assert {len(v) <= langid.Compression().dictionary_bytes for v in dictionaries.values()} == {True}
    asked = spark.createDataFrame([(1, "sigma tau omega phi"), (2, "kappa alpha gamma")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, dictionaries).collect()} == {1: "xx", 2: "aa"}


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = LLM_CATALOG["op8_language_id"][0](spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_licenses_against_all_windows(spark):
    rng = random.Random(8)
    vocabulary = " ".join(licenses.NOTICES.values()).split()
    rows = list(EDGE)
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for notice in rng.sample(list(licenses.NOTICES.values()), rng.randint(0, 2)):
            part = notice.upper().split() if i % 3 else notice.split()
            if i % 4 == 0:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        rows.append((100 + i, " ".join(words)))
    found = licenses.scan(frame(spark, rows)).collect()
    wanted = set()
    for key, text in rows:
        words = WORD.findall(lower(text or ""))
        pairs = list(zip(words, words[1:]))
        for name, notice in licenses.NOTICES.items():
            own = WORD.findall(lower(notice))
            held, width = set(zip(own, own[1:])), len(own) - 1
            good = [
                (i, 100 * len(held & set(pairs[i : i + width])) // len(held)) for i in range(len(pairs) - width + 1)
            ]
            good = [g for g in good if g[1] >= 80]
            if good:
                apart = 1 + sum(b[0] - a[0] >= width for a, b in zip(good, good[1:]))
                best = max(good, key=lambda g: (g[1], -g[0]))
                wanted.add((key, name, apart, best[0], best[1]))
    assert {tuple(r) for r in found} == wanted and len(wanted) > 30
    assert licenses.scan(frame(spark, [])).count() == 0


def test_licenses_in_other_wording_and_punctuation(spark):
    changed = {
        "Apache-2.0": "Distributed under the terms of the Apache License, Version 2.0",
        "MIT": "Distributed under the MIT License",
        "GPL-3.0": "This book is licensed under the GNU General Public License, version 3",
        "CC-BY-NC-4.0": "Published under CC BY-NC 4.0",
        "CC-BY-4.0": "This book is licensed under a Creative Commons Attribution 4.0 International License",
        "CC-BY-SA-4.0": "This book is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "CC0-1.0": licenses.NOTICES["CC0-1.0"].replace("author", "owner"),
        "BSD": licenses.NOTICES["BSD"].replace("provided", "granted"),
        "MPL-2.0": licenses.NOTICES["MPL-2.0"].replace("subject", "bound"),
        "MIT-text": licenses.NOTICES["MIT-text"].replace("person", "human"),
        "GPL-notice": licenses.NOTICES["GPL-notice"].replace("program", "library"),
        "proprietary": "All rights are reserved",
    }
    assert set(changed) == set(licenses.NOTICES)
    rows, wanted = [], set()
    for i, (name, notice) in enumerate(licenses.NOTICES.items()):
        for k, text in enumerate([notice.rstrip(".:"), notice.rstrip(".:") + ";", f"({notice}", f"“{notice}”", changed[name]]):
            rows.append((10 * i + k, f"Some words before. {text} and some after"))
            wanted.add((10 * i + k, name))
    rows += [
        (900, "Released under the BSD License."), (901, "Licensed under CC BY-SA 4.0."), (902, "No rights reserved."),
        (903, "All rights, and reserved seats -- -- under the MIT -- License"),
    ]
    found = licenses.scan(frame(spark, rows), licenses.ALL_NOTICES).collect()
    got = {(r.doc_id, r.license) for r in found}
    assert wanted <= got
    # Notices of like wording meet each other, short ones only themselves.
    alike = {"CC-BY-4.0", "CC-BY-SA-4.0"}
    assert all(name in alike for _, name in got - wanted)
    assert all(2 <= r.first_word <= 9 for r in found)


def test_licenses_in_documents_shorter_than_the_template(spark):
    gpl = "work is licensed under the GNU General Public License, version 3."
    mit = licenses.NOTICES["MIT-text"].split()
    rows = [
        (1, gpl), (2, None), (3, gpl.split(" ", 1)[1]), (4, " ".join(mit[3:])), (5, gpl + " Thanks."),
        (6, " ".join(mit[:-5])), (7, "MIT"), (8, gpl.replace("GNU", "other")), (9, " ".join(mit[6:])),
    ]
    found = licenses.scan(frame(spark, rows), licenses.ALL_NOTICES).collect()
    wanted = {(1, "GPL-3.0", 1, 0, 90), (3, "GPL-3.0", 1, 0, 81), (4, "MIT-text", 1, 0, 88), (6, "MIT-text", 1, 0, 80)}
    assert {tuple(r) for r in found if r.doc_id != 5} - wanted == set()
    assert wanted <= {tuple(r) for r in found} and (5, "GPL-3.0", 90) in {(r[0], r[1], r[4]) for r in found}


def test_license_passages_back_to_back(spark):
    rows, wanted = [], set()
    for i, (name, notice) in enumerate(licenses.NOTICES.items()):
        for k, (times, between) in enumerate([(1, ""), (2, ""), (2, "and then"), (3, "so"), (30, ""), (2, "far apart " * 20)]):
            rows.append((10 * i + k, f" {between} ".join([notice] * times)))
            wanted.add((10 * i + k, name, times, 0, 100))
    short = licenses.NOTICES["BSD"].rsplit(" ", 1)[0]
    rows.append((900, f"{short} {licenses.NOTICES['BSD']} {short}"))
    wanted.add((900, "BSD", 3, 20, 100))
    rows.append((901, "All rights reserved. Licensed under the MIT License. Under the terms of the MIT License."))
    wanted |= {(901, "proprietary", 1, 0, 100), (901, "MIT", 2, 11, 100)}
    found = {tuple(r) for r in licenses.scan(frame(spark, rows), licenses.ALL_NOTICES).collect()}
    assert {w[:3] for w in wanted} <= {f[:3] for f in found} and len({w for w in wanted if w[0] < 900} - found) == 0
