"""Probability adjustments from context: availability, minutes/usage, market and minutes model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import names, odds

# Probability and minutes taken off for an uncertain player.
STATUS_PROBABILITY_CUT = {"doubtful": 0.12, "questionable": 0.06, "day_to_day": 0.04, "probable": 0.02}
STATUS_MINUTES_CUT = {"doubtful": 6.0, "questionable": 3.0, "day_to_day": 2.0, "probable": 0.5}

# Expected minutes of a player quoted in a market.
BASELINE_MINUTES = {
    "player_points": 31.0,
    "player_rebounds": 30.0,
    "player_assists": 31.0,
    "player_threes": 30.0,
    "player_points_rebounds_assists": 32.0,
}
DEFAULT_BASELINE_MINUTES = 30.0

# Weight of minutes, usage and missing opponents per market.
MARKET_WEIGHTS = {
    "player_points": (0.008, 0.65, 0.006),
    "player_rebounds": (0.007, 0.35, 0.004),
    "player_assists": (0.008, 0.45, 0.004),
    "player_threes": (0.006, 0.5, 0.003),
    "player_points_rebounds_assists": (0.009, 0.75, 0.007),
    "player_turnovers": (0.005, 0.4, -0.005),
    "player_blocks": (0.004, 0.2, -0.003),
    "player_steals": (0.004, 0.2, -0.003),
    "player_blocks_steals": (0.004, 0.2, -0.003),
}
DEFAULT_MARKET_WEIGHTS = (0.007, 0.4, 0.003)

# Weight of a minutes-model difference per market.
MINUTES_MODEL_WEIGHTS = {
    "player_points": 0.008,
    "player_rebounds": 0.007,
    "player_assists": 0.008,
    "player_threes": 0.006,
    "player_points_rebounds_assists": 0.009,
    "player_points_rebounds": 0.008,
    "player_points_assists": 0.008,
    "player_rebounds_assists": 0.007,
    "player_turnovers": 0.005,
    "player_blocks": 0.004,
    "player_steals": 0.004,
    "player_blocks_steals": 0.004,
}
DEFAULT_MINUTES_MODEL_WEIGHT = 0.007


def _weight(key: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for name, value in table.items():
        condition = key == name
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def context_adjustment() -> Column:
    """Probability shift from injuries, teammates, opponents and a lopsided spread."""
    sidelined = F.col("roster_status").isin("inactive", "not_on_roster") | F.col(
        "injury_status"
    ).isin("out_for_season", "out")
    teammates = (
        F.col("teammate_out_count") * 0.015
        + F.col("teammate_doubtful_count") * 0.01
        + F.col("teammate_questionable_count") * 0.005
    )
    opponents = F.col("opponent_out_count") * 0.008 + F.col("opponent_doubtful_count") * 0.005
    spread = F.coalesce("spread_abs", F.lit(0.0))
    lopsided = F.when(spread >= 12.0, 0.025).when(spread >= 8.0, 0.015).otherwise(0.0)
    shift = (
        -_weight(F.col("injury_status"), STATUS_PROBABILITY_CUT, 0.0)
        + F.least(teammates, F.lit(0.05))
        + F.least(opponents, F.lit(0.03))
        - lopsided
    )
    return F.when(sidelined, F.lit(-0.49)).otherwise(shift)


def with_adjustments(df: DataFrame) -> DataFrame:
    """Adds context, minutes/usage and market adjustments to lines with player context."""
    spread = F.coalesce("spread_abs", F.lit(0.0))
    lopsided = F.when(spread >= 12.0, 2.0).when(spread >= 8.0, 1.0).otherwise(0.0)
    unknown = F.col("roster_status").isin("unknown_roster", "unknown_event")
    uncertain = F.col("injury_status").isin("questionable", "doubtful")
    relief = F.least(
        F.lit(4.0), F.col("teammate_out_count") * 1.1 + F.col("teammate_doubtful_count") * 0.5
    )
    baseline = _weight(F.col("market"), BASELINE_MINUTES, DEFAULT_BASELINE_MINUTES)
    projected = (
        baseline
        + relief
        - _weight(F.col("injury_status"), STATUS_MINUTES_CUT, 0.0)
        - F.when(unknown, 1.5).otherwise(0.0)
        - lopsided
    )
    usage = odds.clamp(
        F.col("teammate_out_count") * 0.012 + F.col("teammate_doubtful_count") * 0.006, -0.08, 0.09
    ) - F.when(uncertain, 0.01).otherwise(0.0)
    step = df.withColumns(
        {
            "context_adjustment": context_adjustment(),
            "baseline_minutes": baseline,
            "projected_minutes": F.round(odds.clamp(projected, 10.0, 40.0), 2),
            "usage_delta": F.round(usage, 4),
        }
    ).withColumn("minutes_delta", F.round(F.col("projected_minutes") - F.col("baseline_minutes"), 2))

    def market_weight(position: int) -> Column:
        table = {m: w[position] for m, w in MARKET_WEIGHTS.items()}
        return _weight(F.col("market"), table, DEFAULT_MARKET_WEIGHTS[position])

    delta = (
        F.col("minutes_delta") * market_weight(0)
        + F.col("usage_delta") * market_weight(1)
        + F.col("opponent_out_count") * market_weight(2)
    )
    return step.withColumn("market_delta", odds.clamp(delta, -0.12, 0.12))


def with_minutes_model(df: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """Adds the minutes prediction of a line: exact (event, market) first, else the player's.

    The last prediction row wins for a repeated key.
    """
    fields = ["minutes_p10", "minutes_p50", "minutes_p90", "p_active", "confidence_score"]
    if predictions is None:
        empty = df.withColumns({f: F.lit(None).cast("double") for f in fields})
        return _with_minutes_delta(empty)
    payload = F.max_by(F.struct(*fields), F.col("row_order"))
    keyed = predictions.withColumn("player_key", names.person_key(F.col("player"))).where(
        F.col("player_key") != ""
    )
    exact = keyed.groupBy(
        "snapshot_id", "event_id", "player_key", F.lower(F.trim("market")).alias("market")
    ).agg(payload.alias("exact_prediction"))
    by_player = keyed.groupBy("snapshot_id", "player_key").agg(payload.alias("player_prediction"))
    joined = df.join(exact, ["snapshot_id", "event_id", "player_key", "market"], "left").join(
        by_player, ["snapshot_id", "player_key"], "left"
    )
    chosen = F.coalesce("exact_prediction", "player_prediction")
    picked = joined.withColumn("prediction", chosen).withColumns(
        {f: F.col(f"prediction.{f}") for f in fields}
    )
    return _with_minutes_delta(picked.drop("prediction", "exact_prediction", "player_prediction"))


def _with_minutes_delta(df: DataFrame) -> DataFrame:
    weight = _weight(F.col("market"), MINUTES_MODEL_WEIGHTS, DEFAULT_MINUTES_MODEL_WEIGHT)
    minutes = (F.col("minutes_p50") - F.col("projected_minutes")) * weight * 0.75
    penalty = (F.coalesce("p_active", F.lit(1.0)) - 1.0) * 0.2
    confidence = odds.clamp(F.coalesce("confidence_score", F.lit(0.0)), 0.0, 1.0)
    shift = odds.clamp((minutes + penalty) * F.greatest(F.lit(0.1), confidence), -0.08, 0.08)
    return df.withColumns(
        {
            "minutes_band": F.when(
                F.col("minutes_p90") >= F.col("minutes_p10"),
                odds.round6(F.col("minutes_p90") - F.col("minutes_p10")),
            ),
            "minutes_prob_delta_over": F.coalesce(shift, F.lit(0.0)),
        }
    )
