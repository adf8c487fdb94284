"""Preference formatting: one prompt for what two conversations share, and two masked completions.

The longest common prefix of turns (equal role and text) is rendered once as the prompt. What follows in
the chosen and in the rejected conversation becomes its completion: segments of text, each with a flag that
tells whether the loss counts it (the words and end mark of assistant turns) or not.

All is array functions within a row; a conversation is one training example, so its turns stand in one row.

Defined cases: null texts are empty; a null role is rendered as "none" and not trained on; turns of equal
number are ordered by role and text, null numbers first; repeated turns stay; turns without conversation id
are left out; if one conversation is a prefix of the other, its completion is empty, and ``usable`` is
false if either has nothing to train on; an empty table gives an empty table; results replace input columns
of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"
TRAINED = "assistant"


def conversations(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """conv_id and its turns in order (array of role and text)."""
    row = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("none")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return (
        turns.filter(F.col(conv_id).isNotNull())
        .groupBy(F.col(conv_id).alias("conv_id"))
        .agg(F.sort_array(F.collect_list(row)).alias("turns"))
        .select(
            "conv_id",
            F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(
                "turns"
            ),
        )
    )


def _segments(turns: Column) -> Column:
    """Header and body of each turn, with their flags."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit("<|"), t["role"], F.lit("|>\n")).alias("text"), F.lit(False).alias("train")),
                F.struct(
                    F.concat(t["text"], F.lit(END)).alias("text"), (t["role"] == TRAINED).alias("train")
                ),
            ),
        )
    )


def rendered(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def mask(segments: Column) -> Column:
    """Flag and number of characters of each segment, as text."""
    return F.array_join(
        F.transform(
            segments, lambda s: F.concat(s["train"].cast("int"), F.lit(":"), F.length(s["text"]))
        ),
        ",",
    )


def preference_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` (two arrays of role and text) with n_common, prompt, two arrays of segments and usable."""
    left, right = F.coalesce(F.col(chosen), F.array()), F.coalesce(F.col(rejected), F.array())
    staged = pairs.withColumns({"__left": left, "__right": right})
    shorter = F.least(F.size("__left"), F.size("__right"))
    staged = staged.withColumns(
        {
            # Places where the two differ; the first one ends the common prefix.
            "__differ": F.zip_with(
                F.slice("__left", F.lit(1), shorter),
                F.slice("__right", F.lit(1), shorter),
                lambda a, b: ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])),
            ),
            "__shorter": shorter,
        }
    )
    first = F.array_position("__differ", F.lit(True))
    staged = staged.withColumns(
        {"n_common": F.when(first > 0, first - 1).otherwise(F.col("__shorter")).cast("long")}
    )
    start = F.col("n_common").cast("int")
    tail = lambda side: F.slice(side, start + 1, F.greatest(F.size(side) - start, F.lit(0)))
    staged = staged.withColumns(
        {
            "prompt": rendered(_segments(F.slice("__left", F.lit(1), start))),
            "chosen_segments": _segments(tail("__left")),
            "rejected_segments": _segments(tail("__right")),
        }
    )
    trains = lambda name: F.exists(name, lambda s: s["train"])
    return staged.withColumns(
        {"usable": trains("chosen_segments") & trains("rejected_segments")}
    ).drop("__left", "__right", "__differ", "__shorter")


def with_borrowed_replies(convs: DataFrame, block: int = 256) -> DataFrame:
    """Pairs from plain conversations: the rejected side ends in another conversation's last reply.

    Conversations are dealt by a hash of their ids to buckets of ``block`` on average, whatever the ids are and however
    far apart; each borrows from the next one of its bucket, by id, that has a reply, the last from the first. A
    conversation without a reply, or the only one with a reply in its bucket, has an equal rejected side.
    """
    buckets = max(1, -(-convs.count() // block))
    places = F.filter(
        F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull()
    )
    staged = convs.withColumns({"__last": F.coalesce(F.array_max(places), F.lit(-1))})
    staged = staged.withColumns(
        {"__reply": F.when(F.col("__last") >= 0, F.get("turns", F.col("__last")))}
    )
    bits = F.conv(F.substring(F.md5(F.col("conv_id").cast("string").cast("binary")), 1, 13), 16, 10).cast("long")
    in_block = Window.partitionBy(bits % buckets).orderBy("conv_id")
    whole = in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = in_block.rowsBetween(1, Window.unboundedFollowing)
    borrowed = F.coalesce(
        F.first("__reply", ignorenulls=True).over(later), F.first("__reply", ignorenulls=True).over(whole)
    )
    staged = staged.withColumns({"__borrowed": borrowed})
    return staged.select(
        "conv_id",
        F.col("turns").alias("chosen"),
        F.when(
            (F.col("__last") >= 0) & F.col("__borrowed").isNotNull(),
            F.concat(F.slice("turns", F.lit(1), F.col("__last")), F.array("__borrowed")),
        )
        .otherwise(F.col("turns"))
        .alias("rejected"),
    )


QUERY_SQL = """
with convs as (
  select conv_id, list({'role': coalesce(role, 'none'), 'text': coalesce(text, '')}
                       order by turn nulls first, coalesce(role, 'none'), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id),
placed as (
  select conv_id, turns,
         coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), 0) as last
  from convs),
borrowed_ as (
  select conv_id, turns, last,
         coalesce(first(case when last > 0 then turns[last] end ignore nulls)
                    over (w rows between 1 following and unbounded following),
                  first(case when last > 0 then turns[last] end ignore nulls)
                    over (w rows between unbounded preceding and unbounded following)) as reply
  from placed window w as (
    partition by ('0x' || substr(md5(conv_id::varchar), 1, 13))::bigint % greatest(1, (select (count(*) + 255) // 256 from convs))
    order by conv_id)),
pairs as (
  select conv_id, turns as l,
         case when last > 0 and reply is not null then list_concat(turns[1:last - 1], [reply]) else turns end as r
  from borrowed_),
cut as (
  select *, coalesce(list_min(list_filter(range(1, least(len(l), len(r)) + 1),
                                          lambda i: l[i].role <> r[i].role or l[i].text <> r[i].text)) - 1,
                     least(len(l), len(r))) as k
  from pairs),
parts as (
  select conv_id, k, l[1:k] as p, l[k + 1:] as c, r[k + 1:] as d from cut)
select conv_id, k::bigint as n_common,
       array_to_string(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') as prompt,
       array_to_string(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') as chosen,
       array_to_string(list_transform(d, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') as rejected,
       array_to_string(list_transform(c, lambda t: '0:' || (length(t.role) + 5) || ',' || (t.role = 'assistant')::int || ':' || (length(t.text) + 8)), ',') as chosen_mask,
       array_to_string(list_transform(d, lambda t: '0:' || (length(t.role) + 5) || ',' || (t.role = 'assistant')::int || ':' || (length(t.text) + 8)), ',') as rejected_mask,
       (len(list_filter(c, lambda t: t.role = 'assistant')) > 0 and len(list_filter(d, lambda t: t.role = 'assistant')) > 0) as usable
from parts
"""
