"""Capped portfolio selection: greedy in rank order under daily, player and game caps.

The greedy rule depends on everything selected before a row, so it is replayed in order, but
only on the few rows that can matter. With caps p per player and g per game and m picks:

* below the best p rows of a (player, game) pair nothing can be picked;
* a player's picks lie within its best p + ceil(m/g)*p rows, as a row passed over before
  them was passed over for a full game, and at most ceil(m/g) games fill up;
* a game's picks lie within its best g + m*p rows by the same argument for players;
* picking stops after at most m + m*p*(1+ceil(m/g)) + ceil(m/g)*(g+m*p) surviving rows.

Each cut is a top-k per group, which Spark limits inside every task before the shuffle, so a
hot snapshot, game or player never gathers in one task. The replay then folds an array of
that fixed length. Reasons for rows left out follow from the picks alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions import odds

RANKINGS = ("default", "best_ev", "ev_low_quality_weighted", "calibrated_ev_low")
PRIOR_WEIGHT = 0.25


@dataclass(frozen=True)
class Caps:
    """Hard limits of one portfolio; a player or game cap of zero means no cap."""

    max_picks: int = 5
    max_per_player: int = 1
    max_per_game: int = 2


def effective_picks(top_n: int, max_picks: int) -> int:
    """Daily cap from report size and configured picks."""
    top = max(0, top_n)
    return top if max_picks <= 0 else min(max_picks, top)


def primary_value(ranking: Column) -> Column:
    """Ranking value of a candidate under one of the four ranking modes."""
    best = F.coalesce("best_ev", F.lit(-1.0))
    low = F.coalesce("ev_low", F.lit(-1.0))
    calibrated = F.coalesce("ev_low_calibrated", low)
    weight = odds.clamp(F.coalesce("calibration_confidence", F.lit(0.0)), 0.0, 1.0) * 0.3
    value = (
        F.when(ranking == "best_ev", best)
        .when(ranking == "calibrated_ev_low", low * (1.0 - weight) + calibrated * weight)
        .when(
            ranking == "ev_low_quality_weighted",
            low * (F.coalesce("quality_score", F.lit(0.0)) * 0.5 + 0.5),
        )
        .otherwise(low)
    )
    return value + F.coalesce("historical_prior_delta", F.lit(0.0)) * PRIOR_WEIGHT


def rank_key(ranking: Column) -> Column:
    """Ascending sort struct; smaller is picked first."""
    return F.struct(
        (-primary_value(ranking)).alias("value"),
        (-F.coalesce("quality_score", F.lit(-1.0))).alias("quality"),
        (-F.coalesce("best_ev", F.lit(-1.0))).alias("ev"),
        F.coalesce("quote_age_minutes", F.lit(1_000_000.0)).alias("age"),
        F.col("event_id"),
        F.col("player_key"),
        F.col("market"),
        F.coalesce("point", F.lit(0.0)).alias("point"),
        F.col("recommended_side"),
    )


def _best(df: DataFrame, groups: list[str | Column], limit: int) -> DataFrame:
    """Best ``limit`` rows of each group."""
    order = Window.partitionBy(*groups).orderBy("rank_key")
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def contenders(eligible: DataFrame, groups: list[str], caps: Caps) -> DataFrame:
    """The bounded set of rows from which the portfolio is picked."""
    m, p, g = caps.max_picks, caps.max_per_player, caps.max_per_game
    # A blank player or game is not capped: such a row forms a group of its own.
    alone = F.to_json("rank_key")
    slim = eligible.select(
        *groups,
        "event_id",
        "player_key",
        "rank_key",
        F.when(F.col("player_key") == "", alone).otherwise(F.col("player_key")).alias("player_group"),
        F.when(F.col("event_id") == "", alone).otherwise(F.col("event_id")).alias("game_group"),
    )
    full_games = ceil(m / g) if g > 0 else 0
    per_game = g + (m * p if p > 0 else 0)
    per_player = p + full_games * p
    total = m
    if p > 0:
        slim = _best(slim, [*groups, "player_group", "game_group"], p)
        slim = _best(slim, [*groups, "player_group"], per_player)
        total += m * per_player
    if g > 0:
        slim = _best(slim, [*groups, "game_group"], per_game)
        total += full_games * per_game
    return _best(slim, groups, total)


def selections(eligible: DataFrame, groups: list[str], caps: Caps) -> DataFrame:
    """One row per group with the ordered array ``picks`` of its selected rows."""
    m, p, g = caps.max_picks, caps.max_per_player, caps.max_per_game
    item = "struct<rank_key: {}, event_id: string, player_key: string>"
    rank_type = eligible.schema["rank_key"].dataType.simpleString()
    empty = F.array().cast(f"array<{item.format(rank_type)}>")

    def step(picked: Column, row: Column) -> Column:
        same_player = F.size(F.filter(picked, lambda s: s["player_key"] == row["player_key"]))
        same_game = F.size(F.filter(picked, lambda s: s["event_id"] == row["event_id"]))
        allowed = F.size(picked) < m
        if p > 0:
            allowed = allowed & ((row["player_key"] == "") | (same_player < p))
        if g > 0:
            allowed = allowed & ((row["event_id"] == "") | (same_game < g))
        return F.when(allowed, F.concat(picked, F.array(row))).otherwise(picked)

    rows = F.array_sort(F.collect_list(F.struct("rank_key", "event_id", "player_key")))
    return (
        contenders(eligible, groups, caps)
        .groupBy(*groups)
        .agg(rows.alias("rows"))
        .select(*groups, F.aggregate("rows", empty, step).alias("picks"))
    )


def _ranked(candidates: DataFrame, ranking: Column | None) -> DataFrame:
    """Eligible candidates with their rank key."""
    ranking = ranking if ranking is not None else F.col("portfolio_ranking")
    return candidates.where(F.col("eligible")).withColumn("rank_key", rank_key(ranking))


def picks(
    candidates: DataFrame,
    caps: Caps = Caps(),
    groups: list[str] | None = None,
    ranking: Column | None = None,
) -> DataFrame:
    """The ordered ``picks`` of each group, a row per group: all that a portfolio has to store."""
    return selections(_ranked(candidates, ranking), groups or ["snapshot_id", "strategy_id"], caps)


def with_picks(
    candidates: DataFrame,
    picks: DataFrame,
    caps: Caps = Caps(),
    groups: list[str] | None = None,
    ranking: Column | None = None,
) -> DataFrame:
    """Eligible candidates with selected flag, rank and the cap that stopped the others."""
    keyed = picks.withColumn("pick_keys", F.transform("picks", lambda s: s["rank_key"]))
    joined = _ranked(candidates, ranking).join(keyed, groups or ["snapshot_id", "strategy_id"], "left")
    key = F.col("rank_key")
    placed = joined.withColumn("position", F.array_position("pick_keys", key))
    selected = F.coalesce(F.col("position") > 0, F.lit(False))
    # Picks lie in order: the day is full before a row if the last of all picks comes before it.
    day_full = (
        F.coalesce(F.get("pick_keys", F.lit(caps.max_picks - 1)) < key, F.lit(False))
        if caps.max_picks > 0
        else F.lit(True)
    )
    earlier = F.filter(
        "picks",
        lambda s: (s["rank_key"] < key)
        & (s["player_key"] == F.col("player_key"))
        & (F.col("player_key") != ""),
    )
    player_full = (F.size(earlier) >= caps.max_per_player) if caps.max_per_player > 0 else F.lit(False)
    reason = (
        F.when(selected, "")
        .when(day_full, "portfolio_cap_daily")
        .when(player_full, "portfolio_cap_player")
        .otherwise("portfolio_cap_game")
    )
    return placed.withColumns(
        {
            "portfolio_selected": selected,
            "portfolio_rank": F.when(selected, F.col("position")).cast("int"),
            "portfolio_reason": reason,
        }
    ).drop("picks", "pick_keys", "rank_key", "position")


def select_portfolio(
    candidates: DataFrame,
    caps: Caps = Caps(),
    groups: list[str] | None = None,
    ranking: Column | None = None,
) -> DataFrame:
    """Portfolio of each group; candidates are read twice, once for the picks."""
    return with_picks(candidates, picks(candidates, caps, groups, ranking), caps, groups, ranking)
