"""Token counts at prefixes, whitening and the divergence audit against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oddsloom.llm import divergence, token_counts, whitening
from oddsloom.llm.queries import LLM_CATALOG
from oddsloom.llm.transducer import Transducer, build

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PIECES)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t abcehinorstABé▁½'.,0日ー\x00​<s>", max_size=40))
def test_every_prefix_has_the_count_of_the_library(counter, library, text):
    parts, total = counter.steps(text)
    counts = [0, *np.cumsum(token_counts.changes(parts), dtype=int).tolist()]
    assert counts == [len(library.encode(text[:k])) for k in range(len(text) + 1)]
    assert total == counts[-1]


def test_long_runs_have_the_count_of_the_library(counter, library):
    for text in ("x" * 5000, " " * 3000, "ab" * 2500 + " the end", "日本" * 2000, "=" * 333 + "\n" * 77):
        assert counter.steps(text)[1] == len(library.encode(text))


def test_token_counts_and_questions(spark, library):
    texts = [None, "", " ", "same", "same", "word " * 3000, "ünï 日本語 <s> ▁", "y" * 2500]
    rows = [(None if i == 3 else i, t, 5, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, steps string")
    found = token_counts.prefix_counts(docs, PIECES, limit=100, stored=True)
    want = sorted(((r[0] is not None, r[0] or 0), len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in found.collect())
    assert got == want
    by_id = {r.doc_id: r for r in found.collect()}
    for key, text in enumerate(texts):
        row = by_id[None if key == 3 else key]
        text = text or ""
        assert row.over_limit == (row.n_tokens > 100)
        assert len(library.encode(text[: row.fit_chars])) <= 100
        later = range(row.fit_chars + 1, min(len(text), row.fit_chars + 40) + 1)
        assert all(len(library.encode(text[:k])) > 100 for k in later)
    asked = found.join(spark.createDataFrame([(5, 1024), (5, 1025), (5, 7001), (7, 9), (6, None), (5, -3)], "doc_id long, chars long"), "doc_id")
    for row in token_counts.tokens_of_prefix(asked).collect():
        if row.chars is None:
            assert row.prefix_tokens is None
        else:
            assert row.prefix_tokens == len(library.encode(texts[row.doc_id][: max(row.chars, 0)]))
    budgets = found.join(spark.createDataFrame([(5, 0), (5, 777), (7, 3), (1, 5), (5, 10**6), (5, -1)], "doc_id long, budget long"), "doc_id")
    for row in token_counts.prefix_within(budgets).collect():
        text = texts[row.doc_id] or ""
        counts = [0] + [len(library.encode(text[:k])) for k in range(1, len(text) + 1)] if len(text) < 2600 else None
        if counts:
            fits = [k for k, c in enumerate(counts) if c <= row.budget]
            assert row.prefix_chars == (fits[-1] if fits else 0)
        else:
            assert row.prefix_chars == len(text) or len(library.encode(text[: row.prefix_chars])) <= max(row.budget, 0)
    assert token_counts.prefix_counts(docs.limit(0), PIECES).count() == 0


def test_token_counts_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = LLM_CATALOG["op12_token_counts"][0](spark, SF).collect()
    assert len(rows) == len(docs)
    for row in rows:
        text = docs[row.doc_id] or ""
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(library.encode(text)))
        assert row.over_limit == (row.n_tokens > 4096)


def scatter(x):
    apart = x - x.mean(axis=0)
    return apart.T @ apart


@pytest.mark.parametrize("kind", ["normal", "repeated", "constant", "axes", "thin", "scales", "one"])
def test_spectrum_of_rank_one_updates(kind):
    rng = np.random.default_rng(5)
    x = {
        "normal": lambda: rng.normal(0, 8, (300, 16)),
        "repeated": lambda: np.repeat(rng.normal(0, 8, (5, 16)), 40, axis=0),
        "constant": lambda: np.ones((50, 8)),
        "axes": lambda: 7 * np.eye(12)[rng.integers(0, 12, 300)],
        "thin": lambda: rng.normal(0, 8, (200, 3)) @ rng.normal(0, 1, (3, 20)),
        "scales": lambda: rng.normal(0, 1, (300, 12)) * 10.0 ** np.arange(-6, 6),
        "one": lambda: rng.normal(0, 1, (30, 1)),
    }[kind]()
    x = np.floor(64 * x).astype(np.int64) + whitening.SHIFT
    whole, parts = whitening.Spectrum(x.shape[1]), [whitening.Spectrum(x.shape[1]) for _ in range(3)]
    for at, row in enumerate(x):
        whole.add(row)
        parts[at % 3].add(row)
    for part in parts[1:]:
        parts[0].merge(part.n, part.sums, part.d, part.u)
    want = scatter(x.astype(float))
    size = max(np.abs(want).max(), 1)
    for found in (whole, parts[0]):
        assert found.n == len(x) and (found.sums == x.sum(axis=0)).all()
        assert np.abs(found.u @ np.diag(found.d) @ found.u.T - want).max() < 1e-11 * size
        assert np.abs(found.u.T @ found.u - np.eye(len(want))).max() < 1e-11


def whitened_by_hand(vectors, most=32):
    """Exact whole-number covariance and a dense solver."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + whitening.SHIFT
    n, sums = len(x), x.sum(axis=0)
    apart = (n * x - sums) / n
    values, basis = np.linalg.eigh(apart.T @ apart / n)
    order = [i for i in np.argsort(values)[::-1] if values[i] > 1e-9 * values.sum()][:most]
    return ((n * x - sums) ** 2).sum(axis=1), apart @ basis[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check_whitening(rows, found):
    away, white, explained = whitened_by_hand([v for _, v in rows])
    got = defaultdict(dict)
    for r in found:
        got[r.vec_id][r.component] = r
    signs = None
    for (key, _), deviation, line in zip(rows, away.tolist(), white):
        own = got[key]
        assert sorted(own) == list(range(1, len(explained) + 1))
        assert all(r.n == len(rows) and r.deviation == deviation for r in own.values())
        mine = np.array([own[c].whitened for c in sorted(own)])
        if signs is None:
            signs = np.sign(mine * line)
        np.testing.assert_allclose(mine * signs, line, atol=1e-7)
        np.testing.assert_allclose([own[c].explained for c in sorted(own)], explained, rtol=1e-8)
    assert {r.identity_error for r in found} == {found[0].identity_error}
    assert found[0].identity_error < 1e-8


def test_whitening_cases(spark):
    rng = np.random.default_rng(9)
    good = [(i, rng.normal(0, 0.1, 6).tolist()) for i in range(200)] + [(500 + i, [0.5] * 6) for i in range(90)]
    bad = [(1000, None), (1001, []), (1002, [1.0, None] + [0.0] * 4), (1003, [float("nan")] * 6), (1004, [1.0, 2.0]), (1005, [float("inf")] * 6)]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in good + bad], "vec_id long, embedding array<double>, n int, whitened double")
    found = whitening.whiten(frame.repartition(5)).collect()
    check_whitening(good, found)
    none = spark.createDataFrame([(1, [0.5, 0.5], 1, 2.0)], frame.schema)
    assert whitening.whiten(none).count() == 0 and whitening.whiten(frame.limit(0)).count() == 0
    # One direction holds all the variance: it is the only component.
    line = spark.createDataFrame([(i, [float(i), 0.0], 1, 2.0) for i in range(9)], frame.schema)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_whitening_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, LLM_CATALOG["op11_whitening"][0](spark, SF).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé日", min_size=1, max_size=6), max_size=40), st.lists(st.text(alphabet="abcé日z", max_size=7), max_size=30))
def test_transducer_is_minimal_and_numbers_terms(terms, words):
    terms = sorted({t.encode() for t in terms})
    data = build(terms)
    words = [w.encode() for w in words] + terms
    joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    end = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    begin = end - np.array([len(w) for w in words], np.int64)
    number = {t: i for i, t in enumerate(terms)}
    assert Transducer(data).ordinals(joined, begin, end).tolist() == [number.get(w, -1) for w in words]
    rest = defaultdict(set)
    for term in terms:
        for i in range(len(term) + 1):
            rest[term[:i]].add(term[i:])
    assert np.frombuffer(data, "<i8", 2)[1] == max(1, len({frozenset(r) for r in rest.values()}))


def audit_by_hand(rows, least, top=50):
    fold = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

    def words(text):
        out, held = [], b""
        for b in (text or "").encode().translate(fold):
            if b >= 128 or 97 <= b <= 122:
                held += bytes([b])
            else:
                out, held = out + [held], b""
        return [w.decode() for w in out + [held] if w]

    rows = [(words(t), lang or "", source or "") for t, lang, source in rows]
    result = set()
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        docs = Counter(t for w, _, _ in own for t in set(w))
        kept = sorted((t for t, c in docs.items() if c >= least), key=str.encode)
        counts = {s: Counter() for s in {r[2] for r in own}}
        for w, _, s in own:
            counts[s].update(t for t in w if docs[t] >= least)

        def share(c):
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                for rank, (item, value) in enumerate(items, 1):
                    if part == "pair" or rank <= top:
                        result.add((lang, s, part, item, value, rank))
    return result


@pytest.mark.parametrize("shard_terms, load_bytes, block", [(1 << 18, 48 << 20, 256), (3, 1, 2)])
def test_audit_against_hand(spark, monkeypatch, shard_terms, load_bytes, block):
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", block)
    monkeypatch.setattr(divergence, "TERM_BLOCK", 4 if block == 2 else 4096)
    rng = random.Random(2)
    vocabulary = ["the", "a", "é", "日本", "Éa", "zz", "THE", "b" * 70, "x1y", "o'k", "naïve", " "]
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["en", "en", "en", None, "de"]), rng.choice(["s1", "s1", "s1", "S1", None, "é", "t"])
        rows.append((rng.choice(["", " ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 9))), lang, source))
    rows += [(None, "en", "empty"), ("", "fr", "only"), ("x " * 9, "fr", "more"), ("same words", "de", "t"), ("same words", "de", "t")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value int, part string")
    found = [tuple(r) for r in divergence.audit(docs, 12, 5, shard_terms=shard_terms, load_bytes=load_bytes).collect()]
    assert len(found) == len(set(found)) and set(found) == audit_by_hand(rows, 12, 5)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_a_pair_of_sources_is_one_row_whatever_the_order_of_a_block(spark, monkeypatch):
    names, terms = [f"s{i:02d}" for i in range(12)], 3 * divergence.TERM_BLOCK
    rng = random.Random(5)
    rows = [("en", s, rng.randrange(terms), 1 + i) for i, s in enumerate(names) for _ in range(60)]
    held = {(s, t): c for _, s, t, c in rows}
    counts = spark.createDataFrame(
        [("en", s, t, c) for (s, t), c in held.items()], "lang string, source string, ordinal long, occurrences long"
    )
    total = {n: sum(c for (s, _), c in held.items() if s == n) for n in names}
    groups = spark.createDataFrame(
        [("en", n, total[n], sum(total.values()), terms, len(names)) for n in names],
        "lang string, source string, total long, lang_total long, terms long, n_sources long",
    )
    # On a cluster rows of a block arrive in any order: here each block has its sources in another one.
    frame, union = type(counts), type(counts).unionByName
    monkeypatch.setattr(frame, "unionByName", lambda *frames: union(*frames).repartition(16, "source", "part"))
    found = [tuple(r) for r in divergence.distances(counts, groups).collect()]

    def share(s, t):
        return 1 + 10**9 * (held.get((s, t), 0) + 5) // (total[s] + 5 * terms)

    shares = {n: np.array([share(n, t) for t in range(terms)]) for n in names}
    assert sorted(found) == sorted(
        ("en", a, b, int(np.abs(shares[a] - shares[b]).sum())) for a in names for b in names if a != b
    )
