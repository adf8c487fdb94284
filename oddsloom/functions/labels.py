"""Display text built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsloom.functions.names import team_code

# Short market labels.
MARKET_LABELS = {
    "player_points": "P",
    "player_rebounds": "R",
    "player_assists": "A",
    "player_threes": "3PM",
    "player_points_rebounds_assists": "PRA",
    "player_points_rebounds": "P+R",
    "player_points_assists": "P+A",
    "player_rebounds_assists": "R+A",
    "player_blocks": "BLK",
    "player_steals": "STL",
    "player_blocks_steals": "Stocks",
    "player_turnovers": "TO",
}

# Market words used in brief tickets.
MARKET_WORDS = {
    "player_points": "points",
    "player_rebounds": "rebounds",
    "player_assists": "assists",
    "player_threes": "three-pointers",
    "player_points_rebounds_assists": "points+rebounds+assists",
}


def _choose(value: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def market_label(market: Column) -> Column:
    spelled = F.upper(F.replace(market, F.lit("_"), F.lit(" ")))
    return F.coalesce(_choose(market, MARKET_LABELS), spelled)


def market_words(market: Column) -> Column:
    return F.coalesce(_choose(market, MARKET_WORDS), F.replace(market, F.lit("_"), F.lit(" ")))


def american_text(price: Column) -> Column:
    return F.coalesce(
        F.when(price > 0, F.concat(F.lit("+"), price.cast("string"))).otherwise(
            price.cast("string")
        ),
        F.lit(""),
    )


def point_text(point: Column) -> Column:
    """Whole numbers without decimals, others with one."""
    return F.coalesce(
        F.when(point == F.floor(point), F.floor(point).cast("string")).otherwise(
            F.format_string("%.1f", point)
        ),
        F.lit(""),
    )


def percent_text(value: Column, decimals: int = 1, signed: bool = False) -> Column:
    sign = "+" if signed else ""
    return F.coalesce(F.when(value.isNotNull(), F.format_string(f"%{sign}.{decimals}f%%", value)), F.lit(""))


def prop_label(player: Column, side: Column, point: Column, market: Column) -> Column:
    return F.concat_ws(
        " ", player, F.upper(side), F.format_string("%.1f", point), market_label(market)
    )


def ticket_label(player: Column, side: Column, point: Column, market: Column) -> Column:
    return F.concat_ws(" ", player, F.upper(side), point.cast("string"), market)


def brief_ticket(
    player: Column, side: Column, point: Column, market: Column, price: Column, book: Column
) -> Column:
    side_text = F.when(side == "", F.lit("TBD")).otherwise(F.upper(side))
    book_text = F.coalesce(F.nullif(book, F.lit("")), F.lit("unknown_book"))
    return F.concat(
        player, F.lit(" "), side_text, F.lit(" "), point_text(point), F.lit(" "),
        market_words(market), F.lit(" @ "), american_text(price), F.lit(" ("), book_text, F.lit(")"),
    )


def spread_label(home_team: Column, home_spread: Column) -> Column:
    """Home-side spread such as ``BOS -4.5``; near-zero spreads are a pick'em."""
    code = team_code(home_team)
    home = F.coalesce(F.nullif(code, F.lit("")), home_team)
    sign = F.when(home_spread > 0, F.lit("+")).otherwise(F.lit(""))
    return (
        F.when(home_spread.isNull(), F.lit(""))
        .when(F.abs(home_spread) < 0.05, F.concat(home, F.lit(" PK")))
        .otherwise(F.concat(home, F.lit(" "), sign, F.format_string("%.1f", home_spread)))
    )


# The sentences of the report and when each applies.
def rationale(
    player: Column, market: Column, side: Column, p_hit: Column, p_fair: Column,
    injury: Column, teammates_out: Column, spread_abs: Column, total: Column,
    minutes: Column, usage: Column,
) -> Column:
    """First two applicable sentences explaining a pick."""
    sentences = F.array_compact(
        F.array(
            F.when(
                p_hit.isNotNull() & p_fair.isNotNull(),
                F.format_string(
                    "Model p(%s) %.3f vs no-vig baseline %.3f for %s %s.",
                    side, p_hit, p_fair, player, market_label(market),
                ),
            ),
            F.when(
                teammates_out > 0,
                F.format_string(
                    "Usage proxy lifts due to %d unavailable teammate(s) on his team today.",
                    teammates_out,
                ),
            ),
            F.when(
                minutes.isNotNull() & usage.isNotNull(),
                F.format_string(
                    "Minutes/usage core model projects about %.1f minutes with usage delta %+.2f%%.",
                    minutes, usage * 100.0,
                ),
            ),
            F.when(
                injury.isin("questionable", "doubtful", "day_to_day"),
                F.concat(F.lit("Availability is "), injury, F.lit(", so confidence is trimmed.")),
            ),
            F.when(
                spread_abs >= 8.0,
                F.lit("Blowout risk adjustment applied because spread is 8+ points."),
            ),
            F.when(
                total.isNotNull(),
                F.format_string("Game environment anchor uses market total around %.1f.", total),
            ),
        )
    )
    fallback = F.lit("Edge comes from price shopping across books versus normalized market baseline.")
    return F.when(F.size(sentences) > 0, F.array_join(F.slice(sentences, 1, 2), " ")).otherwise(fallback)


# The notes of the report.
def risk_notes(injury: Column, roster: Column, spread_abs: Column, tier: Column) -> Column:
    notes = F.concat_ws(
        ", ",
        F.when(
            injury.isin("questionable", "doubtful", "day_to_day", "unknown"),
            F.concat(F.lit("injury="), injury),
        ),
        F.when(~roster.isin("active", "rostered"), F.concat(F.lit("roster="), roster)),
        F.when(spread_abs >= 8.0, F.lit("blowout_risk")),
        F.when(tier == "B", F.lit("single_book_quote")),
    )
    return F.when(notes == "", F.lit("none")).otherwise(notes)
