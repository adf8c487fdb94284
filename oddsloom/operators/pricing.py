"""Quotes to priced lines: book panels, best sides, no-vig pairs and line quality.

A *line* is (snapshot, event, market, player, point). Quotes shrink to one row per line and
book in the first aggregation (combined map-side, so a hot line costs one row per book and
task), and to one row per line with a small ``panel`` array of its books in the second.
Everything else is arithmetic on that array, without another shuffle; leaving one book out
is a filter on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import odds, parsing

IDENTITY = ["snapshot_id", "event_id", "market", "player"]
LINE = [*IDENTITY, "point"]
# Lines of a player in an event lie together: no step on lines, identities or a player's context deals them out again.
TOGETHER = ["snapshot_id", "event_id", "player"]


def typed_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes with clean keys: whole prices, over/under sides, a missing point as zero."""
    return quotes.select(
        "snapshot_id",
        F.coalesce("event_id", F.lit("")).alias("event_id"),
        F.coalesce("market", F.lit("")).alias("market"),
        F.coalesce("player", F.lit("")).alias("player"),
        F.coalesce(F.col("point").cast("double"), F.lit(0.0)).alias("point"),
        parsing.text(F.col("book")).alias("book"),
        parsing.side(F.col("side")).alias("side"),
        parsing.american_price(F.col("price")).alias("price"),
        "last_update",
        F.coalesce("link", F.lit("")).alias("link"),
    )


def snapshot_clock(quotes: DataFrame) -> DataFrame:
    """Newest quote time per snapshot, the clock its quotes are aged against."""
    return quotes.groupBy("snapshot_id").agg(F.max("last_update").alias("now_utc"))


# An offer as one number, for hash aggregation: its cost, then its time in microseconds.
_COST_SHIFT, _TIME_SHIFT, _NO_TIME = 10**9, 10**17, 10**18


def _packed(cost: Column, at: Column) -> Column:
    time = F.coalesce(F.unix_micros(at) + F.lit(_TIME_SHIFT), F.lit(0))
    whole = (cost + F.lit(_COST_SHIFT)).cast("decimal(11,0)") * F.lit(_NO_TIME).cast("decimal(19,0)")
    return (whole + time.cast("decimal(19,0)")).cast("decimal(31,0)")


def _unpacked(packed: Column) -> Column:
    unit = F.lit(_NO_TIME).cast("decimal(31,0)")
    time = (packed % unit).cast("long")
    cost = ((packed - packed % unit) / unit).cast("long") - F.lit(_COST_SHIFT)
    return F.when(
        packed.isNotNull(),
        F.struct(
            cost.cast("int").alias("cost"),
            F.when(time > 0, F.timestamp_micros(time - F.lit(_TIME_SHIFT))).alias("last_update"),
            F.lit(None).cast("string").alias("link"),
        ),
    )


def line_books(quotes: DataFrame, links: bool = True) -> DataFrame:
    """One row per line and book: best and worst price of each side, with its origin.

    A text in an aggregate makes Spark sort all quotes. Without ``links`` an offer is cost and time, packed into
    one number, and quotes are only hashed; offers then have a null link.
    """

    def offer(side: str) -> Column:
        priced = (F.col("side") == side) & F.col("price").isNotNull()
        cost = -F.col("price")
        if links:
            return F.min(F.when(priced, F.struct(cost.alias("cost"), "last_update", "link")))
        return F.min(F.when(priced, _packed(cost, F.col("last_update"))))

    def lowest(side: str) -> Column:
        return F.min(F.when(F.col("side") == side, F.col("price")))

    def quoted(side: str) -> Column:
        return F.coalesce(F.bool_or(F.col("side") == side), F.lit(False))

    grouped = typed_quotes(quotes).groupBy(*LINE, "book").agg(
        offer("over").alias("over_offer"),
        offer("under").alias("under_offer"),
        lowest("over").alias("over_low"),
        lowest("under").alias("under_low"),
        quoted("over").alias("over_quoted"),
        quoted("under").alias("under_quoted"),
        F.max("last_update").alias("last_seen"),
    )
    if not links:
        grouped = grouped.withColumns(
            {c: _unpacked(F.col(c)) for c in ("over_offer", "under_offer")}
        )
    over = F.when(F.col("book") != "", -F.col("over_offer.cost"))
    under = F.when(F.col("book") != "", -F.col("under_offer.cost"))
    return (
        grouped.withColumn("over_price", over)
        .withColumn("under_price", under)
        .withColumn("p_over_implied", odds.implied_probability(F.col("over_price")))
        .withColumn("p_under_implied", odds.implied_probability(F.col("under_price")))
        .withColumn(
            "p_over_fair", odds.no_vig_over(F.col("p_over_implied"), F.col("p_under_implied"))
        )
        .withColumn("hold", odds.hold(F.col("p_over_implied"), F.col("p_under_implied")))
    )


def fair_pairs(books: DataFrame) -> DataFrame:
    """Books quoting both sides of a line, with implied and no-vig probabilities."""
    return books.where(F.col("p_over_fair").isNotNull()).select(
        *LINE, "book", "over_price", "under_price", "p_over_implied", "p_under_implied",
        "p_over_fair", (1.0 - F.col("p_over_fair")).alias("p_under_fair"), "hold",
    )


def line_panels(books: DataFrame) -> DataFrame:
    """One row per line with the array of its books (as many entries as bookmakers).

    Books are dealt out by :data:`TOGETHER`, so that what is gathered or joined by longer keys needs no shuffle.
    """
    entry = F.struct(
        "book", "over_offer", "under_offer", "over_low", "under_low", "over_quoted",
        "under_quoted", "p_over_fair", "hold",
    )
    return books.repartition(*TOGETHER).groupBy(*LINE).agg(
        F.sort_array(F.collect_list(entry)).alias("panel"),
        F.max("last_seen").alias("freshest_quote"),
    )


def without_book(panel: Column, book: Column) -> Column:
    return F.filter(panel, lambda b: b["book"] != book)


def panel_best(panel: Column, side: str) -> Column:
    """Best offer of a side as struct(price, book, last_update, link); null if none.

    Highest price first; ties go to the first book name, then the earliest quote.
    """
    offers = F.transform(
        F.filter(panel, lambda b: b[f"{side}_offer"].isNotNull()),
        lambda b: F.struct(
            b[f"{side}_offer"]["cost"].alias("cost"),
            b["book"].alias("book"),
            b[f"{side}_offer"]["last_update"].alias("last_update"),
            b[f"{side}_offer"]["link"].alias("link"),
        ),
    )
    return F.array_min(offers)


def panel_book_count(panel: Column, side: str) -> Column:
    return F.size(F.filter(panel, lambda b: b[f"{side}_quoted"] & (b["book"] != "")))


def panel_shop_delta(panel: Column, side: str) -> Column:
    """Best minus worst price of a side; zero without prices."""
    best = -F.array_min(F.transform(panel, lambda b: b[f"{side}_offer"]["cost"]))
    worst = F.array_min(F.transform(panel, lambda b: b[f"{side}_low"]))
    return F.coalesce(best - worst, F.lit(0))


def panel_pairs(panel: Column) -> Column:
    return F.filter(panel, lambda b: b["p_over_fair"].isNotNull())


def best_pair_columns(df: DataFrame, panel: str = "panel", suffix: str = "") -> DataFrame:
    """Best offers of both sides and the no-vig pair they form."""
    over_price = -F.col(f"over_best{suffix}.cost")
    under_price = -F.col(f"under_best{suffix}.cost")
    over_p, under_p = odds.implied_probability(over_price), odds.implied_probability(under_price)
    return df.withColumns(
        {
            f"over_best{suffix}": panel_best(F.col(panel), "over"),
            f"under_best{suffix}": panel_best(F.col(panel), "under"),
        }
    ).withColumns(
        {
            f"p_over_best{suffix}": odds.no_vig_over(over_p, under_p),
            f"hold_best{suffix}": odds.hold(over_p, under_p),
        }
    )


def quality_columns(
    df: DataFrame, panel: str = "panel", suffix: str = "", stale_minutes: int = 20
) -> DataFrame:
    """Depth, hold, dispersion and freshness scores with quality and uncertainty.

    Needs ``hold_best`` of the same panel as fallback and ``freshest_quote``/``now_utc``.
    Freshness looks at the whole line, also when a book is left out of the panel.
    """

    def col(name: str) -> Column:
        return F.col(f"{name}{suffix}")

    horizon = max(5.0, 2.0 * max(stale_minutes, 1))
    pairs = panel_pairs(F.col(panel))
    # Both sides of a pair have prices, so no value is missing. ``array_sort`` would be interpreted, lambda by lambda.
    ordered = F.sort_array(F.transform(pairs, lambda b: b["p_over_fair"]))
    holds = F.sort_array(F.transform(pairs, lambda b: b["hold"]))
    age = odds.clamp(
        odds.round6(odds.clamp(_age_minutes(), 0.0, 1e12)), 0.0, 1e12
    )
    step1 = df.withColumns(
        {
            f"ordered_p{suffix}": ordered,
            f"books_used{suffix}": F.transform(pairs, lambda b: b["book"]),
            f"hold_median{suffix}": odds.sorted_quantile(holds, 0.5),
            f"quote_age_minutes{suffix}": age,
        }
    )
    values = col("ordered_p")
    step2 = step1.withColumns(
        {
            f"book_pair_count{suffix}": F.size(values),
            f"p_over_median{suffix}": odds.sorted_quantile(values, 0.5),
            f"p_over_iqr{suffix}": odds.sorted_quantile(values, 0.75)
            - odds.sorted_quantile(values, 0.25),
            f"p_over_range{suffix}": F.array_max(values) - F.array_min(values),
        }
    ).drop(f"ordered_p{suffix}")

    def score(loss: Column) -> Column:
        return F.coalesce(odds.clamp(1.0 - loss, 0.0, 1.0), F.lit(0.0))

    used_hold = F.coalesce(col("hold_median"), col("hold_best"))
    step3 = step2.withColumns(
        {
            f"depth_score{suffix}": odds.clamp(col("book_pair_count") / 4.0, 0.0, 1.0),
            f"hold_score{suffix}": score(odds.clamp(used_hold, 0.0, 1.0) / 0.12),
            f"dispersion_score{suffix}": score(
                odds.clamp(F.coalesce(col("p_over_iqr"), col("p_over_range")), 0.0, 1.0) / 0.15
            ),
            f"freshness_score{suffix}": score(col("quote_age_minutes") / horizon),
        }
    )
    shortfall = (
        F.lit(0.01)
        + (1.0 - col("depth_score")) * 0.05
        + (1.0 - col("hold_score")) * 0.02
        + (1.0 - col("dispersion_score")) * 0.05
        + (1.0 - col("freshness_score")) * 0.03
    )
    return step3.withColumns(
        {
            f"quality_score{suffix}": odds.round6(
                col("depth_score") * 0.30 + col("hold_score") * 0.25
                + col("dispersion_score") * 0.25 + col("freshness_score") * 0.20),
            f"uncertainty_band{suffix}": odds.round6(
                odds.clamp(F.greatest(shortfall, col("p_over_iqr") / 2.0), 0.01, 0.2)),
        }
    )


def _age_minutes() -> Column:
    micros = F.unix_micros("now_utc") - F.unix_micros("freshest_quote")
    return micros / F.lit(60_000_000.0)


def priced_lines(
    quotes: DataFrame, stale_minutes: int = 20, clock: DataFrame | None = None, links: bool = True
) -> DataFrame:
    """Lines with best sides, depth tier and pricing quality.

    ``clock`` gives ``now_utc`` per snapshot; by default the newest quote of the snapshot. ``links`` as in
    :func:`line_books`.
    """
    panels = line_panels(line_books(quotes, links))
    clocked = panels.join(clock if clock is not None else snapshot_clock(quotes), "snapshot_id", "left")
    panel = F.col("panel")
    named = F.transform(F.filter(panel, lambda b: b["book"] != ""), lambda b: b["book"])
    sided = clocked.withColumns(
        {
            "books": named,
            "book_count": F.size(named),
            "tier": F.when(F.size(named) >= 2, "A").otherwise("B"),
            "over_books": panel_book_count(panel, "over"),
            "under_books": panel_book_count(panel, "under"),
            "over_shop_delta": panel_shop_delta(panel, "over"),
            "under_shop_delta": panel_shop_delta(panel, "under"),
        }
    )
    return quality_columns(best_pair_columns(sided), stale_minutes=stale_minutes)
