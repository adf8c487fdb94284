"""Quality rules, line first: lines that fail a rule go, then documents that lost too much.

Everything is DataFrame functions over arrays inside one row, so the operator neither shuffles nor
leaves the JVM, and a very long text costs n log n in its own words.

Defined cases: a null text counts as an empty one (all counts 0, ``base_failed``, not kept); lines of
white space never fail and weigh nothing; repeated rows are judged one by one; an empty table gives an
empty table; input columns whose names are those of results are replaced by the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.session import materialize

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BARS = "|›»·•¦"

# Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept all cookies",
    "we use cookies",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "terms of use",
    "terms of service",
    "privacy policy",
    "all rights reserved",
    "click here",
    "read more",
    "sign up for our newsletter",
    "subscribe to our",
    "share on facebook",
    "follow us on",
    "skip to content",
    "back to top",
    "lorem ipsum",
)


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules and of the verdict on the document.

    ``symbols_per_words`` 4 means: a symbol for every four words, or more, fails the line.
    """

    symbols_per_words: int = 4
    shouts_per_words: int = 2
    bars_per_words: int = 3
    least_marks: int = 3
    boilerplate_words: int = 40
    lost_percent: int = 40


def _absent(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_absent(text, characters))


def line_fails(line: Column, rules: LineRules) -> Column:
    """True for a line with words that breaks the punctuation, navigation or boilerplate rule."""
    words = F.size(F.array_remove(F.split(line, "[\\x20\\x09-\\x0D]+"), ""))
    symbols = _count(line, SYMBOLS.replace("|", ""))
    shouts = _count(line, "!")
    bars = _count(line, BARS)
    no_sentence = ~line.rlike("[.!?…:;。！？](?:[\"”»)'\\]]*\\s|[\"”»)'\\]]*$)")
    punctuation = (
        (no_sentence & (words >= 3))
        | ((symbols >= rules.least_marks) & (symbols * rules.symbols_per_words >= words))
        | ((shouts >= rules.least_marks) & (shouts * rules.shouts_per_words >= words))
    )
    navigation = (bars >= 2) & (bars * rules.bars_per_words >= words)
    boilerplate = (words <= rules.boilerplate_words) & F.lower(line).rlike("|".join(BOILERPLATE))
    return (words > 0) & (punctuation | navigation | boilerplate)


def with_line_verdict(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Adds ``clean_text`` (lines that pass), ``n_bad_lines``, ``lost_percent`` and ``line_kept``."""
    staged = docs.withColumns({"__lines": F.split(F.coalesce(F.col(text), F.lit("")), "\n")})
    staged = staged.withColumns(
        {"__good": F.filter("__lines", lambda line: ~line_fails(line, rules))}
    )
    # Lengths without white space: blank lines and indents have no weight.
    whole = F.length(_absent(F.array_join("__lines", ""), SEPARATORS))
    good = F.length(_absent(F.array_join("__good", ""), SEPARATORS))
    staged = staged.withColumns({"__whole": whole, "__lost": whole - good})
    return staged.withColumns(
        {
            "clean_text": F.array_join("__good", "\n"),
            "n_bad_lines": (F.size("__lines") - F.size("__good")).cast("long"),
            "lost_percent": F.coalesce(100.0 * F.col("__lost") / F.nullif("__whole", F.lit(0)), F.lit(0.0)),
            "line_kept": (F.col("__whole") > 0)
            & (100 * F.col("__lost") <= rules.lost_percent * F.col("__whole")),
        }
    ).drop("__lines", "__good", "__whole", "__lost")


def with_base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five counts and ``base_failed``.

    Windows of three words are compared by 64-bit hashes. A window is repeated if its hash stands next
    to an equal one after sorting; the words covered by repeated windows are counted from the sorted
    window starts, each adding the words that the previous one did not cover.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    staged = docs.withColumns(
        {
            "__words": F.array_remove(F.split(body, "[\\x20\\x09-\\x0D]+"), ""),
            "__lines": F.filter(
                F.split(body, "\n"), lambda line: F.length(_absent(line, SEPARATORS)) > 0
            ),
        }
    )
    staged = staged.withColumns(
        {
            "__windows": F.slice(
                F.transform(
                    "__words",
                    lambda word, i: F.xxhash64(
                        word, F.get("__words", i + 1), F.get("__words", i + 2)
                    ),
                ),
                F.lit(1),
                F.greatest(F.size("__words") - 2, F.lit(0)),
            )
        }
    )
    staged = staged.withColumns(
        {"__again": F.size(F.array_distinct("__windows")) < F.size("__windows")}
    )
    staged = staged.withColumns(
        {
            "__sorted": F.when(
                F.col("__again"),
                F.sort_array(
                    F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
                ),
            )
        }
    )
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    staged = staged.withColumns(
        {
            "__starts": F.sort_array(
                F.transform(
                    F.filter(
                        "__sorted",
                        lambda x, i: same(x, F.get("__sorted", i - 1)) | same(x, F.get("__sorted", i + 1)),
                    ),
                    lambda x: x["i"],
                )
            )
        }
    )
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda acc, i: F.struct(
            i.alias("last"), (acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total")
        ),
        lambda acc: acc["total"],
    )
    staged = staged.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(_absent(body, SEPARATORS)).cast("long"),
            "n_symbols": _count(body, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        }
    )
    return staged.withColumns(
        {
            "base_failed": (F.col("n_words") < 50)
            | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        }
    ).drop("__words", "__lines", "__windows", "__again", "__sorted", "__starts")


def quality_rules(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` with counts, cleaned text and ``kept``."""
    judged = with_line_verdict(with_base_counts(docs, text), text, rules)
    return judged.withColumns({"kept": ~F.col("base_failed") & F.col("line_kept")}).drop("line_kept")


def clean_documents(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Kept rows with their input columns, ``text`` being the cleaned one.

    The verdict is written before it filters: pushed below the projections, the filter would hold all their
    nested expressions many times over, which takes the optimizer beyond any time.
    """
    # Under neutral names, since input columns may be called like results.
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    own = f"c{docs.columns.index(text)}"
    held = quality_rules(inner, own, rules).select(
        F.col("kept").alias("keep"),
        *[(F.col("clean_text") if c == own else F.col(c)).alias(c) for c in inner.columns],
    )
    written = materialize(held, "judged")
    return written.filter("keep").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


# The same rules in DuckDB SQL, for the default parameters.
BASE_SQL = """
words_ as (
  select doc_id, coalesce(text, '') as body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from documents),
windows_ as (
  select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as w
  from words_, unnest(range(1, len(ws) - 1)) as u(i)),
counted_ as (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows_),
covered_ as (
  select doc_id, count(distinct p) as n_repeat_words
  from counted_, unnest([i, i + 1, i + 2]) as u(p) where n > 1 group by doc_id),
lines_ as (
  select doc_id, x, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) as nw,
         length(regexp_replace(x, '[^#*$%&<>]', '', 'g')) as sy,
         length(regexp_replace(x, '[^!]', '', 'g')) as sh,
         length(regexp_replace(x, '[^|›»·•¦]', '', 'g')) as ba,
         length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) as weight
  from words_, unnest(string_split(body, chr(10))) as u(x)),
lost_ as (
  select doc_id, sum(weight) as whole,
         sum(case when nw > 0 and (
               (not regexp_matches(x, '[.!?…:;。！？](?:["”»)''\\]]*[\\t\\n\\x0b\\f\\r ]|["”»)''\\]]*$)') and nw >= 3)
               or (sy >= 3 and sy * 4 >= nw) or (sh >= 3 and sh * 2 >= nw)
               or (ba >= 2 and ba * 3 >= nw)
               or (nw <= 40 and regexp_matches(lower(x), '{phrases}'))) then weight else 0 end) as lost
  from lines_ group by doc_id),
base_ as (
  select w.doc_id, len(ws)::bigint as n_words,
         length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, whole, lost
  from words_ w left join covered_ using (doc_id) left join lost_ using (doc_id))
""".replace("{phrases}", "|".join(BOILERPLATE))

QUERY_SQL = f"""
with {BASE_SQL}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
         and whole > 0 and 100 * lost <= 40 * whole as kept
from base_
"""
