"""Source divergence audit: which sources of a language use which terms otherwise, and how far apart sources are.

Terms that stand in enough documents of a language are kept. They are numbered in the order of their bytes and built
into minimal acyclic transducers (``transducer``), a bounded number of terms each. Every text is then streamed
through the transducers of its language, which recounts the kept terms by ordinal for each source. From counts come
smoothed shares in whole billionths: those of a source against each other source's (``pair``) and against the
language's (``term``). Ordinals stand for terms up to the end and decide ties.

How it scales: documents are counted per term in the tasks before anything is shuffled, and so are occurrences. The
transducers go to all tasks in loads of at most ``load_bytes``; if they are more, the texts are read once for each load.
Distances between sources are summed over blocks of terms by blocks of sources, so a language with one
hot source or many sources falls into many tasks.

Defined cases: null text, lang and source are ''; a group without kept terms still has its shares; a language that
keeps no term has pairs of value 0 and no terms; equal rows count each; term order and ties are by UTF-8 bytes; an empty
table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm.shingles import slices
from oddsloom.llm.transducer import Transducer, build
from oddsloom.session import materialize

#: Terms are runs of these bytes (ASCII letters in lower case and all that is not ASCII); others become spaces.
FOLDED = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
BATCH_ROWS = 1000
HELD_TERMS = 250_000
HELD_BYTES = 64 << 20
HELD_COUNTS = 1 << 20
SHARD_TERMS = 1 << 18
LOAD_BYTES = 48 << 20
SOURCE_BLOCK = 256
TERM_BLOCK = 4096
SCALE = 1_000_000_000


def _grouped(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def _bodies(rows: pa.RecordBatch) -> list[bytes]:
    return rows.column("text").cast(pa.binary()).to_pylist()


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, docs: in how many documents of the language the term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                terms = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(terms)), terms, pa.array(list(counts.values()), pa.int64())],
                    ["lang", "term", "docs"],
                )

        for batch in batches:
            for rows in slices(batch, 1):
                for lang, body in zip(rows.column("lang").to_pylist(), _bodies(rows)):
                    held.setdefault(lang, Counter()).update(set(body.translate(FOLDED).split()))
                    size += len(body)
                if size > HELD_BYTES or sum(map(len, held.values())) > HELD_TERMS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    partial = docs.select("lang", "text").mapInArrow(run, "lang string, term string, docs long")
    return partial.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """lang, ordinal, term: the kept terms, numbered in the order of their bytes within each language."""
    # Written first: a range partitioning reads its input twice.
    kept = materialize(document_counts(docs).filter(F.col("docs") >= least_docs), "kept-terms")
    placed = materialize(
        kept.repartitionByRange("lang", "term")
        .sortWithinPartitions("lang", "term")
        .select("lang", "term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")),
        "placed-terms",
    )
    # One row for each language and partition.
    runs = placed.groupBy("lang", "part").agg(F.count("*").alias("terms"), F.min("place").alias("first"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"base": F.coalesce(F.sum("terms").over(before), F.lit(0))})
    numbered = placed.join(runs, ["lang", "part"])
    return materialize(
        numbered.select("lang", (F.col("base") + F.col("place") - F.col("first")).alias("ordinal"), "term"),
        "vocabulary",
    )


def transducers(terms: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """lang, shard, bytes, data: transducers of ``shard_terms`` successive terms each."""

    def make(table: pa.Table) -> pa.Table:
        data = build(sorted(table.column("term").cast(pa.binary()).to_pylist()))
        lang, shard = table.column("lang")[0].as_py(), table.column("shard")[0].as_py()
        return pa.Table.from_pydict({"lang": [lang], "shard": [shard], "bytes": [len(data)], "data": [data]})

    shards = terms.withColumns({"shard": F.floor(F.col("ordinal") / shard_terms)})
    made = shards.groupBy("lang", "shard").applyInArrow(make, "lang string, shard long, bytes long, data binary")
    return materialize(made, "transducers")


def recount(
    docs: DataFrame, made: DataFrame, shard_terms: int = SHARD_TERMS, load_bytes: int = LOAD_BYTES
) -> DataFrame:
    """lang, source, ordinal, occurrences of every kept term that a source has, by streaming the texts."""
    spark = docs.sparkSession
    loads: list[list[tuple[str, int]]] = []
    size = 0
    for lang, shard, length in made.select("lang", "shard", "bytes").orderBy("lang", "shard").collect():
        if not loads or size + length > load_bytes:
            loads.append([])
            size = 0
        loads[-1].append((lang, shard))
        size += length
    shape = "lang string, source string, ordinal long, occurrences long"
    parts = [_streamed(docs, made, load, shard_terms, shape) for load in loads]
    if not parts:
        return spark.createDataFrame([], shape)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("lang", "source", "ordinal").agg(F.sum("occurrences").alias("occurrences"))


def _streamed(docs: DataFrame, made: DataFrame, load: list, shard_terms: int, shape: str) -> DataFrame:
    """Partial counts of the terms of one load of transducers."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame(load, "lang string, shard long")
    data = {(r["lang"], r["shard"]): bytes(r["data"]) for r in made.join(wanted, ["lang", "shard"]).toLocalIterator()}
    sent = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list[tuple[int, Transducer]]] = {}
        for (lang, shard), body in sent.value.items():
            by_lang.setdefault(lang, []).append((shard * shard_terms, Transducer(body)))
        groups: dict[tuple[str, str], int] = {}
        keys, counts, held = [], [], 0
        wide = 1 << 40

        def compact() -> None:
            nonlocal keys, counts, held
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, place, np.concatenate(counts))
            keys, counts, held = [key], [sums], len(key)

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(groups)
            group = keys[0] // wide
            langs, sources = (pa.array([n[i] for n in names], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(group)), sources.take(pa.array(group)), pa.array(keys[0] % wide), pa.array(counts[0])],
                ["lang", "source", "ordinal", "occurrences"],
            )

        for batch in batches:
            for rows in slices(batch, 1):
                texts: dict[str, list[tuple[int, bytes]]] = {}
                for lang, source, body in zip(
                    rows.column("lang").to_pylist(), rows.column("source").to_pylist(), _bodies(rows)
                ):
                    if lang in by_lang:
                        group = groups.setdefault((lang, source), len(groups))
                        texts.setdefault(lang, []).append((group, body))
                for lang, pairs in texts.items():
                    joined = np.frombuffer(b" ".join([b"", *[b for _, b in pairs], b""]).translate(FOLDED), np.uint8)
                    inside = (joined != 32).view(np.int8)
                    border = np.diff(inside)
                    begin, end = np.flatnonzero(border == 1) + 1, np.flatnonzero(border == -1) + 1
                    # Each text has one space before it.
                    starts = np.cumsum([0] + [len(b) + 1 for _, b in pairs[:-1]])
                    numbers = np.array([g for g, _ in pairs], np.int64)
                    owner = numbers[np.searchsorted(starts, begin, "right") - 1]
                    for base, terms in by_lang[lang]:
                        ordinal = terms.ordinals(joined, begin, end)
                        known = ordinal >= 0
                        key, count = np.unique(owner[known] * wide + ordinal[known] + base, return_counts=True)
                        keys.append(key)
                        counts.append(count.astype(np.int64))
                        held += len(key)
                if held > HELD_COUNTS:
                    compact()
                    if held > HELD_COUNTS // 2:
                        yield from flush()
                        groups, keys, counts, held = {}, [], [], 0
        if held:
            compact()
            yield from flush()

    return docs.mapInArrow(run, shape)


def _share(occurrences: str, total: str, terms: str) -> F.Column:
    """1 + floor(SCALE * (occurrences + 5) / (total + 5 * terms)), in decimals: exact at any count."""
    top = f"({SCALE}BD * (cast({occurrences} as decimal(20, 0)) + 5))"
    return F.expr(f"1 + {top} div (cast({total} as decimal(20, 0)) + 5 * {terms})")


def distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: sum over all kept terms of the gaps between two sources' shares, both ways."""
    blocks = F.ceil(F.col("n_sources") / SOURCE_BLOCK).cast("long")
    headed = groups.withColumns(
        {
            "p": F.when(F.col("terms") > 0, _share("0", "total", "terms")).otherwise(0),
            "blocks": blocks,
            "side": F.pmod(F.xxhash64("source"), blocks),
        }
    )
    heads = headed.select(
        "lang", "source", "side", "blocks", "terms", "p", F.lit(None).cast("long").alias("ordinal"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("terms") / TERM_BLOCK) - 1, F.lit(0)).cast("long"))).alias("part"),
    )
    cells = counts.join(headed.drop("p"), ["lang", "source"]).select(
        "lang", "source", "side", "blocks", "terms", _share("occurrences", "total", "terms").alias("p"),
        "ordinal", F.floor(F.col("ordinal") / TERM_BLOCK).alias("part"),
    )
    dealt = heads.unionByName(cells).withColumns(
        {"other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))}
    )
    dealt = dealt.withColumns({"a": F.least("side", "other"), "b": F.greatest("side", "other")})

    def gaps(table: pa.Table) -> pa.Table:
        lang, part, a, b, terms = (table.column(c)[0].as_py() for c in ("lang", "part", "a", "b", "terms"))
        source = table.column("source").combine_chunks().dictionary_encode()
        names, code = source.dictionary, source.indices.to_numpy()
        side = np.zeros(len(names), np.int64)
        side[code] = table.column("side").to_numpy()
        head = table.column("ordinal").is_null().to_numpy()
        p = table.column("p").to_numpy()
        least = np.zeros(len(names), np.int64)
        least[code[head]] = p[head]
        width = max(0, min(TERM_BLOCK, terms - part * TERM_BLOCK))
        shares = np.repeat(least[:, None], width, axis=1)
        at = table.column("ordinal").filter(pa.array(~head)).to_numpy() - part * TERM_BLOCK
        shares[code[~head], at] = p[~head]
        left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
        one, two, value = [], [], []
        for i in left.tolist():
            others = right[right > i] if a == b else right
            one.append(np.full(len(others), i))
            two.append(others)
            value.append(np.abs(shares[others] - shares[i]).sum(axis=1))
        if not one:
            return pa.Table.from_pydict({"lang": [], "source": [], "item": [], "value": []}, gap_schema)
        first, second = names.take(pa.array(np.concatenate(one))), names.take(pa.array(np.concatenate(two)))
        return pa.Table.from_arrays(
            [pa.repeat(lang, len(first)), first, second, pa.array(np.concatenate(value), pa.int64())], schema=gap_schema
        )

    gap_schema = pa.schema(
        [("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]
    )
    found = dealt.drop("blocks", "other").groupBy("lang", "part", "a", "b").applyInArrow(
        gaps, "lang string, source string, item string, value long"
    )
    # Which of two sources comes first depends on the order of a block's rows: the blocks of a pair meet by name.
    ends = F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")
    summed = found.groupBy("lang", *ends).agg(F.sum("value").alias("value"))
    there = F.struct("source", "item")
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    both = summed.select("lang", "value", F.explode(F.array(there, back)).alias("pair"))
    return both.select("lang", "pair.source", "pair.item", "value")


def audit(
    docs: DataFrame,
    least_docs: int = 30,
    top: int = 50,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    shard_terms: int = SHARD_TERMS,
    load_bytes: int = LOAD_BYTES,
) -> DataFrame:
    """lang, source, part, item, value, rank."""
    # Whole texts can be long; the usual 10000 rows of a batch would be held four times on their way to a task.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    rows = _grouped(docs, text, lang, source)
    terms = vocabulary(rows, least_docs)
    counts = materialize(recount(rows, transducers(terms, shard_terms), shard_terms, load_bytes), "recount")
    totals = counts.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("n_sources"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = materialize(
        groups.join(of_lang, "lang").join(sizes, "lang", "left").na.fill(0, ["total", "lang_total", "terms"]),
        "groups",
    )
    pairs = distances(counts, groups)
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_rank).alias("rank")
    )
    whole = counts.groupBy("lang", "ordinal").agg(F.sum("occurrences").alias("whole"))
    above = (
        counts.join(groups, ["lang", "source"])
        .join(whole, ["lang", "ordinal"])
        .select(
            "lang", "source", "ordinal",
            (_share("occurrences", "total", "terms") - _share("whole", "lang_total", "terms")).alias("value"),
        )
        .filter("value > 0")
    )
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    above = above.withColumns({"rank": F.row_number().over(by_ordinal)}).filter(F.col("rank") <= top)
    named = above.join(terms, ["lang", "ordinal"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"
    )
    return pairs.unionByName(named)


QUERY_SQL = r"""
with docs as (
  select doc_id, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') words
  from documents
),
numbered as (select row_number() over () row_id, * from docs),
words as (select row_id, lang, source, unnest(words) term from numbered),
kept as (select lang, term from words group by all having count(distinct row_id) >= 30),
sizes as (
  select l.lang, count(k.term) v from (select distinct lang from docs) l left join kept k on k.lang = l.lang group by all
),
counted as (select lang, source, term, count(*) c from words join kept using (lang, term) group by all),
pairs_of as (select distinct lang, source from docs),
totals as (
  select g.lang, g.source, coalesce(sum(c), 0) n
  from pairs_of g left join counted c on c.lang = g.lang and c.source = g.source group by all
),
shares as (
  select t.lang, t.source, k.term, coalesce(c.c, 0) c,
    1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (t.n + 5 * s.v) p
  from totals t join sizes s on s.lang = t.lang join kept k on k.lang = t.lang
    left join counted c on c.lang = t.lang and c.source = t.source and c.term = k.term
),
lang_counts as (select lang, term, sum(c) c from shares group by all),
lang_totals as (select lang, sum(n) n from totals group by all),
lang_shares as (
  select c.lang, c.term, 1 + (1000000000::hugeint * (c.c + 5)) // (t.n + 5 * s.v) q
  from lang_counts c join lang_totals t on t.lang = c.lang join sizes s on s.lang = c.lang
),
gaps as (
  select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
),
pair as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(g.value, 0) value
  from pairs_of a join pairs_of b on a.lang = b.lang and a.source <> b.source
    left join gaps g on g.lang = a.lang and g.source = a.source and g.item = b.source
),
term as (
  select a.lang, a.source, 'term' part, a.term item, a.p - q.q value
  from shares a join lang_shares q on q.lang = a.lang and q.term = a.term where a.c > 0 and a.p > q.q
),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) rank
  from (select * from pair union all select * from term)
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked
where part = 'pair' or rank <= 50
"""
