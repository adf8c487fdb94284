"""Token files, packing, Simple-8b and segmentation against whole-text brute force."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oddsloom.llm import nbest, packing, simple8b, token_files
from oddsloom.llm.byte_pair import ByteEncoder
from oddsloom.session import stage_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
CASES = [
    (0, "Plain words, and  two spaces. "),
    (1, None),
    (2, ""),
    (3, " \t\n leading and trailing \n\n"),
    (4, "same text"),
    (5, "same text"),
    (6, "x" * 9000),
    (7, "word " * 3000),
    (8, "Ün<|endoftext|>ï 日本語\r\n\r\n 'tis he's"),
    (9, "a b 　 c"),
    (None, "no id"),
    (4, "same text"),
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def encoder():
    return ByteEncoder(BPE)


def expected_ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def frame(spark, rows):
    # A column of a name that an operator uses, to show that it does not clash.
    return spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "doc_id long, text string, start long, item string"
    )


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t abs'Zéß1.²日,_ʰ\xa0", max_size=24), max_size=4))
def test_segments_give_the_ids_of_the_whole(encoder, tokenizer, texts):
    found = encoder.encode(texts)
    whole = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert found == whole


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "endoftext", "|>", " ", "\n", "word", "'s", "é", "日"]), max_size=9))
def test_added_tokens_are_taken_whole(encoder, tokenizer, parts):
    text = "".join(parts)
    whole = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole


def test_added_token_between_latin_words(encoder):
    found = encoder.encode(["hello <|endoftext|> world"])
    assert np.frombuffer(found[0], "<u4").tolist() == [31373, 220, 50256, 995]


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.integers(0, 3), max_size=400),
    st.integers(1, 90),
)
def test_simple8b_round_trip(ids, block):
    ids = np.array(ids, np.uint64)
    blocks = simple8b.pack_blocks(ids, block)
    back = []
    for b in blocks:
        got = simple8b.unpack_words(b.words)
        got[b.places] = b.values
        assert len(got) == b.count
        back.append(got)
    assert np.array_equal(np.concatenate(back) if back else np.empty(0, np.uint64), ids)


def test_simple8b_file_reads_any_run_of_blocks():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 3 * simple8b.BLOCK + 17).astype(np.uint64)
    ids[[5, simple8b.BLOCK + 3]] = 2**63
    data = simple8b.write_file([3, None], np.array([len(ids) - 4, 4]), ids)
    reader = simple8b.Reader(data)
    assert reader.doc_ids == [3, None] and reader.lengths.tolist() == [len(ids) - 4, 4]
    assert np.array_equal(reader.ids(), ids)
    assert np.array_equal(reader.ids(1, 3), ids[simple8b.BLOCK : 3 * simple8b.BLOCK])


def test_token_files(spark, tokenizer):
    folder = stage_path(spark, "test-files")
    table = token_files.write(frame(spark, CASES), folder, BPE, file_ids=2000)
    rows = token_files.read(spark, folder, table).collect()
    start, expected = 0, []
    for key, text in sorted(CASES, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = expected_ids(tokenizer, text)
        expected.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected
    assert table.count() > 1


def test_token_files_of_nothing(spark):
    folder = stage_path(spark, "test-files")
    empty = frame(spark, [])
    table = token_files.write(empty, folder, BPE)
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(folder)
    )
    assert token_files.read(spark, folder, table).count() == 0


def check_packing(rows, texts, tokenizer, capacity=1024):
    by_sequence = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for key, text in texts:
        ids = expected_ids(tokenizer, text)
        own = sorted(pieces[key], key=lambda r: r.piece)
        copies = len([1 for k, _ in texts if k == key])
        assert len(own) == copies * -(-len(ids) // capacity)
        at = 0
        for r in own[::copies]:
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == capacity or r.piece == 0
            at += r.length
        assert at == len(ids)
    return len(by_sequence)


def test_packing(spark, tokenizer):
    check_packing(packing.pack_documents(frame(spark, CASES), BPE).collect(), CASES, tokenizer)
    assert packing.pack_documents(frame(spark, []), BPE).count() == 0


@pytest.mark.parametrize("tasks", [1, 9, 70])
def test_packing_wastes_little(spark, tasks):
    rng = random.Random(tasks)
    lengths = [rng.choice([1, 3, 600, 600, rng.randint(1, 1024)]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length int")
    rows = packing.pack(items, tasks=tasks, carried=15).collect()
    assert sorted(r.item for r in rows) == list(range(3000))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, lengths[r.item]))
    for members in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(members)))
        assert [o for o, _ in sorted(members)] == [0, *ends[:-1]] and ends[-1] <= 1024
    large = sum(n > 512 for n in lengths)
    assert len(sequences) <= 1.02 * max(large, sum(lengths) / 1024) + tasks / 8 + 2


@pytest.fixture(scope="module")
def lattice():
    return nbest.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab  teh\né日in▁", max_size=9), st.integers(1, 5))
def test_nbest_against_all_paths(lattice, text, n):
    into = defaultdict(list)
    if text:
        for start, stop, score, ids in lattice.edges(" " + text):
            into[stop].append((start, score, ids))

    def scores(at):
        if at == 0:
            return [0]
        return [s + score for start, score, _ in into[at] for s in scores(start)]

    found = lattice.encode(text, n)
    everything = sorted(scores(len(text) + 1 if text else 0), reverse=True)
    assert [s for s, _ in found] == everything[:n]
    assert len({ids for _, ids in found}) == len(found)
    for _, ids in found:
        assert lattice.decode(ids) == text.replace("▁", " ")


def test_segmentation_query_shape(spark):
    rows = nbest.segment(frame(spark, CASES), public_tokenizers.path("piece_bpe_32k.model"), n=2).collect()
    best = [r for r in rows if r["rank"] == 1]
    assert len(best) == len(CASES) and all(r.round_trip for r in best)
    assert all(r.n_pieces == 0 for r in best if r.doc_id in (1, 2))
    assert nbest.segment(frame(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_scores_that_are_not_whole(monkeypatch):
    import sentencepiece

    pieces = {"▁": -0.5, "a": -3.4, "b": -2.6, "ab": -6.25, "▁a": -3.7}

    class Model:
        def __init__(self, model_file):
            pass

        vocab_size = staticmethod(lambda: len(pieces))
        id_to_piece = staticmethod(lambda i: list(pieces)[i])
        get_score = staticmethod(lambda i: float(np.float32(list(pieces.values())[i])))
        is_byte = is_control = is_unknown = is_unused = staticmethod(lambda i: False)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    made = nbest.Lattice("unigram")
    found = [(score / made.scale, np.frombuffer(ids, "<u4").tolist()) for score, ids in made.encode("ab", 3)]
    assert [ids for _, ids in found] == [[4, 2], [0, 1, 2], [0, 3]]
    assert [score for score, _ in found] == pytest.approx([-6.3, -6.5, -6.75], abs=1e-6)


def test_whole_scores_keep_their_units(lattice):
    assert lattice.scale == 1
