"""Registered queries against SQL or brute force; chat pairs, exact search and the pipeline."""

import random
from collections import defaultdict

import check_oracles
import corpus_pipeline
import duckdb
import pytest
from test_token_operators import check_packing

from oddsloom.llm import chat, mtree, packing, quality
from oddsloom.llm.queries import LLM_CATALOG

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in LLM_CATALOG.items() if sql])
def test_query_against_sql(spark, name):
    build, sql = LLM_CATALOG[name]
    frame = build(spark, SF)
    result = check_oracles.connect(SF).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    rows = [tuple(r) for r in frame.collect()]
    assert check_oracles.table(rows, frame.columns) == check_oracles.table(result.fetchall(), names)


@pytest.mark.parametrize("number", range(1, 14))
def test_one_query_for_each_operator(number):
    assert len([n for n in LLM_CATALOG if n.startswith(f"op{number}_")]) == 1


def turns(spark, rows):
    return spark.createDataFrame(
        [(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, prompt string"
    )


def test_preference_prefix(spark):
    shape = "k int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    rows = [
        (0, [u, a, u, a], [u, a, u, b]), (1, [u, a], [u, a]), (2, [u, a], [u]), (3, [a], [b]),
        (4, [], [u, b]), (5, None, [u, b]), (6, [u, (None, None)], [u, (None, None), b]),
    ]
    found = {r.k: r for r in chat.preference_pairs(spark.createDataFrame(rows, shape)).collect()}
    assert [found[i].n_common for i in range(7)] == [3, 2, 1, 0, 0, 0, 2]
    assert [found[i].usable for i in range(7)] == [True, False, False, True, False, False, False]
    assert found[0].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nhi<|end|>\n"
    assert [(s.text, s.train) for s in found[0].rejected_segments] == [
        ("<|assistant|>\n", False),
        ("no<|end|>\n", True),
    ]


def test_conversation_edges(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None),
        (None, 0, "user", "lost"), (3, None, "user", ""), (3, 5, "assistant", "long " * 20000),
    ]
    pairs = chat.preference_pairs(chat.with_borrowed_replies(chat.conversations(turns(spark, rows))))
    found = {r.conv_id: r for r in pairs.collect()}
    assert set(found) == {1, 2, 3}
    assert [t.text for t in found[1].chosen] == ["a", "b", "b"]
    assert found[1].usable and found[1].n_common == 2 and found[1].rejected_segments[1].text.startswith("long")
    assert found[3].rejected_segments[1].text == "b<|end|>\n" and not found[2].usable
    assert chat.conversations(turns(spark, [])).count() == 0


def test_ids_far_apart_and_text_ids_get_pairs(spark):
    for ids in ([10_000 * i for i in range(40)], [f"conv-{i}" for i in range(40)]):
        kind = "long" if isinstance(ids[0], int) else "string"
        rows = [(k, n, role, f"{role} {k}") for k in ids for n, role in enumerate(("user", "assistant"))]
        frame = spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string")
        for block, usable in ((256, 40), (8, 36)):
            pairs = chat.with_borrowed_replies(chat.conversations(frame), block)
            found = chat.preference_pairs(pairs).collect()
            assert {r.conv_id for r in found} == set(ids) and sum(r.usable for r in found) >= usable
            assert all(r.chosen_segments[1].text != r.rejected_segments[1].text for r in found if r.n_common == 1)


def test_exact_search(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randint(-20, 20) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + i, [3, 3, 3, 3, 3, 3]) for i in range(300)]  # equal vectors
    rows += [(2000, None), (2001, [1, 2]), (2002, [4, 5]), (None, [1, 1, 1, 1, 1, 1]), (7, [1, 0, 0, 0, 0, 0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, vector array<long>, score string")
    queries = vectors.filter("vec_id % 50 = 0 or vec_id in (2001, 7)")
    found = mtree.top_k(vectors, queries, 5, tree_rows=150, block_rows=7).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.score, r.vec_id))
    good = [(i, v) for i, v in rows if i is not None and v]
    for key in {i for i, _ in good if i % 50 == 0} | {2001}:
        for query in [v for i, v in good if i == key]:
            scores = sorted(
                (-sum(x * y for x, y in zip(query, v)), i) for i, v in good if i != key and len(v) == len(query)
            )
            assert got[key] == [(-s, i) for s, i in scores[:5]]
    assert mtree.top_k(vectors.limit(0), queries).count() == 0


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001]), (1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {r[0]: r[1] for r in frame.select("vec_id", mtree.quantized(frame.embedding)).collect()}
    assert found[0] == [128, -1] and all(found[i] is None for i in range(1, 6))


def test_large_components_take_part(spark):
    frame = spark.createDataFrame([(0, [2.0**41, 1.0]), (1, [3.0e38, 1.0])], "vec_id long, embedding array<float>")
    found = frame.filter("vec_id = 0").select(mtree.quantized(frame.embedding)).first()
    assert found[0] == [2**49, 256]
    with pytest.raises(Exception, match="does not fit"):
        frame.select(mtree.quantized(frame.embedding)).collect()


def test_exact_search_beyond_doubles(spark):
    rng = random.Random(6)
    rows = [(i, [rng.randint(-(2**30), 2**30) if i % 3 else rng.randint(-9, 9) for _ in range(4)]) for i in range(200)]
    rows += [(1000, [2**30, 1, 0, 0]), (1001, [2**30, 2, 0, 0]), (1002, [2**30, 3, 0, 0])]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = defaultdict(list)
    for r in sorted(mtree.top_k(vectors, vectors, 5, tree_rows=60).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.score, r.vec_id))
    for key, query in rows:
        scores = sorted((-sum(x * y for x, y in zip(query, v)), i) for i, v in rows if i != key)
        assert got[key] == [(-s, i) for s, i in scores[:5]]


def brute_pipeline(spark, docs):
    """The stages' decisions, from the operators' tested parts and plain Python."""
    kept = [r for r in quality.quality_rules(docs).collect() if r.kept]
    return {r.doc_id: r.clean_text for r in kept}


def test_pipeline(spark):
    from tokenizers import Tokenizer

    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        stages.append((name, docs, out))
        docs = out
    cleaned = brute_pipeline(spark, stages[0][1])
    assert {r.doc_id: r.text for r in stages[0][2].collect()} == cleaned
    assert all(s[2].columns == columns for s in stages[:-1])
    # Languages: everything that goes lacks letters or a clear language.
    before, after = ({r.doc_id for r in f.collect()} for f in stages[1][1:])
    assert after <= before and len(after) >= 0.98 * len(before)
    # One document of each class of texts stays, its smallest id.
    from test_document_operators import classes

    rows = [(r.doc_id, r.text) for r in stages[2][1].collect()]
    roots = {component for _, _, component in classes(rows, 5, 80)}
    assert {r.doc_id for r in stages[2][2].collect()} == roots
    texts = [(r.doc_id, r.text) for r in stages[3][1].collect()]
    check_packing(stages[3][2].collect(), texts, Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")))
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, stages[3][2].collect()))


def test_pipeline_edges(spark):
    """Nulls in every column, repeated rows and an empty table pass through."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    text = " ".join(f"word{i} und{i % 7} so{i}." for i in range(60))
    rows = [
        (1, text, "de", None, None, 1), (1, text, "de", None, None, 1), (2, text, None, "s", 5, None),
        (None, text, "de", "s", 5, 1), (3, None, None, None, None, None), (4, "", "de", "s", 0, 1),
        (5, " ".join(f"other{i} and{i % 5} then{i}." for i in range(60)), "en", "s", 9, 2),
    ]
    for given, ids in ((rows, [None, 1, 5]), ([], [])):
        docs = spark.createDataFrame(given, shape)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
        assert sorted((r.doc_id for r in docs.collect()), key=lambda x: x or 0) == ids
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == bool(ids)


def test_columns_of_documents_are_kept(spark):
    """Columns whose names the operators use inside come out as they went in."""
    text = " ".join(f"word{i} und{i % 7} so{i}." for i in range(60))
    rows = [(i, f"{text} {'other ' * i}.", "de" if i else None, 0.875 + i, f"p{i}", 7 * i, i, "k") for i in range(3)]
    rows.append((9, " ".join(f"wieder{i} und{i % 5} dann{i}." for i in range(60)), "de", 0.5, None, 1, 2, "r"))
    shape = "doc_id long, text string, lang string, score double, lang_pred string, row_key int, component int, kept string"
    docs = spark.createDataFrame(rows, shape)
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.language_id, corpus_pipeline.near_duplicates):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        given = {r[0]: r[3:] for r in rows}
        found = out.collect()
        assert found and all(tuple(r)[3:] == given[r.doc_id] for r in found)


def test_one_id_with_two_texts(spark):
    """No row goes but for a row of its class that stays."""
    a, b, c = (" ".join(f"{name}{i}" for i in range(40)) for name in ("first", "second", "third"))
    rows = [(3, a), (5, a), (5, b), (7, b + " end"), (8, c), (8, c), (8, a), (None, b), (9, None), (9, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row_note string")
    found = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    wanted = [(3, a), (5, b), (8, c), (None, b), (9, None), (9, "")]
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(wanted, key=str)


def test_packing_query_is_whole(spark):
    rows = LLM_CATALOG["op9_packing"][0](spark, SF).collect()
    texts = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    sequences = check_packing(rows, texts, tokenizer)
    assert sequences <= 1.1 * -(-sum(r.length for r in rows) // 1024)
    assert packing.best_fit.__doc__
