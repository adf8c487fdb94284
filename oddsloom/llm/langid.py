"""Language identification by compression.

For each language a zstandard dictionary is made of raw text of that language (no training of entropy
tables). Texts are reduced to lower-case words of letters and compressed with each dictionary, in chunks,
so that the dictionary and not the text's own past does the work; the language whose total is smallest
wins. Where sizes are close, the text is compressed again at a level that also finds short matches. The
margin is the gap between the smallest and the next size, relative to the next; a text with a narrow margin,
or without any letter, is rejected.

Fitting reads a bounded sample: for each language the ``sample_docs`` rows with the smallest hash, of which
texts are taken until ``dictionary_bytes`` are full; of the text that fills them the beginning. Bounds are
parameters and hold for learning alone; languages are labels, and their number does not grow with the corpus.

Defined cases: a null text or one without letters is ``und`` with score 0; equal sizes go to the language that
sorts first, with score 0; with no labelled row every text is ``und``; with one language it wins with
score 1; repeated rows get equal answers; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"


_BETWEEN = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=1)
def _numbers() -> frozenset[str]:
    """Numbers such as one half or Roman ones: word characters to regular expressions, but neither letters nor digits."""
    signs = (chr(c) for c in range(0x80, 0x110000))
    return frozenset(c for c in signs if c.isalnum() and not c.isalpha() and not c.isdecimal())


def letters_only(text: str) -> str:
    """Lower-case words of letters, one space between them."""
    body = _BETWEEN.sub(" ", text.lower()).strip()
    if body.isascii() or _numbers().isdisjoint(body):
        return body
    return " ".join("".join(" " if c in _numbers() else c for c in body).split())


@dataclass(frozen=True)
class Compression:
    sample_docs: int = 192
    dictionary_bytes: int = 192 * 1024
    chunk_bytes: int = 2048
    level: int = 3
    close: float = 0.02
    close_level: int = 19


def fit(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    how: Compression = Compression(),
) -> dict[str, bytes]:
    """Raw dictionary by language, from the rows given."""
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    # No more of a text than a dictionary holds comes to the driver.
    start = F.substring(F.col(text), 1, how.dictionary_bytes)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "key"))
    # Ids first: texts of the whole corpus are not sorted to choose a few.
    chosen = (
        usable.select(
            F.col(lang).alias("lang"), F.col(doc_id).alias("key"), F.xxhash64(doc_id).alias("h")
        )
        .withColumns({"rank": rank})
        .filter(F.col("rank") <= how.sample_docs)
    )
    # At most languages x sample_docs rows.
    picked = usable.select(
        F.col(lang).alias("lang"), F.col(doc_id).alias("key"), start.alias("text")
    ).join(F.broadcast(chosen), ["lang", "key"])
    found: dict[str, bytes] = {}
    for row in picked.orderBy("lang", "rank", "text").toLocalIterator():
        held = found.get(row["lang"], b"")
        body = letters_only(row["text"]).encode()
        if body and len(held) < how.dictionary_bytes:
            found[row["lang"]] = (held + body + b"\n")[: how.dictionary_bytes]
    return found


def predict(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    text: str = "text",
    how: Compression = Compression(),
) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the relative margin, 0 to 1), replacing columns so named."""
    names = sorted(dictionaries)
    raw = [dictionaries[n] for n in names]
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    base = docs.select(*(F.col(f"`{c}`") for c in kept))
    shape = T.StructType(
        [
            *base.schema.fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard


        def coders(level: int) -> list:
            options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            out = []
            for data in raw:
                made = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.precompute_compress(level=level)
                out.append(zstandard.ZstdCompressor(level=level, dict_data=made, **options).compress)
            return out

        quick, careful = coders(how.level), coders(how.close_level)

        def measured(chunks: list, with_: list) -> tuple[int, float]:
            sizes = [sum(len(code(c)) for c in chunks) for code in with_]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            others = sizes[:best] + sizes[best + 1 :]
            return best, (1 - sizes[best] / min(others)) if others else 1.0

        def judge(body: str | None) -> tuple[str, float]:
            body = letters_only(body or "")
            if not body or not names:
                return UNKNOWN, 0.0
            data = memoryview(body.encode())
            chunks = [data[at : at + how.chunk_bytes] for at in range(0, len(data), how.chunk_bytes)]
            best, margin = measured(chunks, quick)
            if margin < how.close:
                best, margin = measured(chunks, careful)
            return names[best], margin

        at = kept.index(text)
        for batch in batches:
            judged = [judge(value.as_py()) for value in batch[at]]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([j[0] for j in judged], pa.string()),
                    pa.array([j[1] for j in judged], pa.float64()),
                ],
                [*kept, "lang_pred", "score"],
            )

    return base.mapInArrow(run, shape)


def held_out(doc_id: Column) -> Column:
    """True for the rows that nothing is learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    how: Compression = Compression(),
) -> DataFrame:
    """``docs`` with lang_pred and score, learnt from the rows of ``labelled`` not held out."""
    return predict(docs, fit(labelled.filter(~held_out(F.col(doc_id))), doc_id, text, lang, how), text, how)


def accepted(margin: float = 0.003) -> Column:
    """The rejection rule: a language was found, by more than ``margin``."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") > margin)
