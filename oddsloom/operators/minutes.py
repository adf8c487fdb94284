"""Minutes features and baselines from box scores, with strictly preceding row frames.

Windows run per player or per team over that entity's own games. A season is under a hundred
games and a career a few thousand rows, so a partition stays small whatever the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions import odds

FEATURES = (
    "prev_minutes_mean", "prev_minutes_std", "prev_minutes_short", "prev_minutes_trend",
    "prev_active_rate", "games_played", "games_on_team", "days_on_team", "new_team_phase_ord",
    "team_prev_minutes_mean", "team_prev_active_count",
)


def _before(keys: list[str], games: int):
    return Window.partitionBy(*keys).orderBy("game_date", "game_id").rowsBetween(-games, -1)


def _rolling(fn, value: str, keys: list[str], games: int, need: int) -> Column:
    frame = _before(keys, games)
    return F.when(F.count(value).over(frame) >= need, fn(value).over(frame))


def feature_frame(boxscore: DataFrame, history: int = 10, need: int = 3) -> DataFrame:
    """Per player-game features from earlier games only."""
    history, need = max(2, history), max(1, need)
    base = boxscore.where(
        (F.coalesce("player_id", F.lit("")) != "")
        & (F.coalesce("team_id", F.lit("")) != "")
        & F.col("game_date").isNotNull()
    ).withColumn("actual_minutes", F.coalesce(F.col("minutes").cast("double"), F.lit(0.0))).withColumn(
        "active_target", (F.col("actual_minutes") > 0).cast("int")
    )
    team_games = base.groupBy("team_id", "game_id", "game_date").agg(
        F.sum("actual_minutes").alias("total"), F.sum("active_target").alias("active")
    )
    teams = team_games.select(
        "team_id", "game_id",
        _rolling(F.avg, "total", ["team_id"], 5, 2).alias("team_prev_minutes_mean"),
        _rolling(F.avg, "active", ["team_id"], 5, 2).alias("team_prev_active_count"),
    )
    player, stint = ["player_id"], ["player_id", "team_id"]
    joined = base.join(teams, ["team_id", "game_id"], "left")
    ordered = Window.partitionBy(*player).orderBy("game_date", "game_id")
    on_team = Window.partitionBy(*stint).orderBy("game_date", "game_id")
    windowed = joined.withColumns(
        {
            "mean": _rolling(F.avg, "actual_minutes", player, history, need),
            "std": _rolling(F.stddev_samp, "actual_minutes", player, history, need),
            "short": _rolling(F.avg, "actual_minutes", player, min(3, history), 1),
            "rate": _rolling(F.avg, "active_target", player, history, need),
            "games_played": F.row_number().over(ordered) - 1,
            "games_on_team": F.row_number().over(on_team) - 1,
            "days_on_team": F.greatest(
                F.lit(0), F.date_diff("game_date", F.min("game_date").over(on_team))
            ),
        }
    )
    phase = F.when(F.col("games_on_team") < 5, 0).when(F.col("games_on_team") <= 10, 1).otherwise(2)
    return windowed.select(
        "game_id", "game_date", "player_id", "team_id", "actual_minutes", "active_target",
        F.element_at(F.array(F.lit("lt_5"), F.lit("g5_10"), F.lit("gt_10")), phase + 1).alias("new_team_phase"),
        F.coalesce("mean", F.lit(24.0)).alias("prev_minutes_mean"),
        F.coalesce("std", F.lit(0.0)).alias("prev_minutes_std"),
        F.coalesce("short", "mean", F.lit(24.0)).alias("prev_minutes_short"),
        F.coalesce(F.col("short") - F.col("mean"), F.lit(0.0)).alias("prev_minutes_trend"),
        F.coalesce("rate", F.lit(0.95)).alias("prev_active_rate"),
        "games_played", "games_on_team", "days_on_team",
        phase.alias("new_team_phase_ord"),
        F.coalesce("team_prev_minutes_mean", F.lit(240.0)).alias("team_prev_minutes_mean"),
        F.coalesce("team_prev_active_count", F.lit(8.0)).alias("team_prev_active_count"),
    )


def with_eval_flag(rows: DataFrame, eval_days: int) -> DataFrame:
    """Marks the last days as evaluation rows; the newest date is one value."""
    newest = rows.agg(F.max("game_date").alias("newest"))
    cutoff = F.date_sub("newest", max(1, eval_days) - 1)
    return rows.join(F.broadcast(newest)).withColumn("is_eval", F.col("game_date") >= cutoff).drop("newest")


def baseline_predictions(boxscore: DataFrame, history: int = 10, need: int = 3, eval_days: int = 7) -> DataFrame:
    """Mean of the preceding games as prediction, with errors and history used."""
    history, need = max(1, history), max(1, need)
    base = boxscore.where(
        (F.coalesce("player_id", F.lit("")) != "") & F.col("game_date").isNotNull()
    ).withColumn("actual_minutes", F.coalesce(F.col("minutes").cast("double"), F.lit(0.0)))
    predicted = base.select(
        "game_id", "game_date", "player_id", "team_id", "actual_minutes",
        _rolling(F.avg, "actual_minutes", ["player_id"], history, need).alias("pred_minutes"),
        F.count("actual_minutes").over(_before(["player_id"], history)).alias("history_games_used"),
    )
    error = F.col("actual_minutes") - F.col("pred_minutes")
    return with_eval_flag(predicted, eval_days).withColumns(
        {"abs_error": F.abs(error), "sq_error": error * error}
    )


def baseline_metrics(predictions: DataFrame) -> DataFrame:
    """Error of the evaluation window and the date ranges."""
    scored = F.col("pred_minutes").isNotNull()
    held_out = scored & F.col("is_eval")
    error = F.col("actual_minutes") - F.col("pred_minutes")
    return predictions.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(scored).alias("rows_scored"),
        F.count_if(held_out).alias("rows_eval_scored"),
        F.avg(F.when(held_out, F.col("abs_error"))).alias("mae"),
        F.sqrt(F.avg(F.when(held_out, F.col("sq_error")))).alias("rmse"),
        F.avg(F.when(held_out, error)).alias("bias"),
        F.min("game_date").alias("train_start"),
        F.max("game_date").alias("train_end"),
        F.min(F.when(held_out, F.col("game_date"))).alias("eval_start"),
        F.max(F.when(held_out, F.col("game_date"))).alias("eval_end"),
    )


def evaluate_predictions(predictions: DataFrame) -> DataFrame:
    """Errors, interval coverage and Brier score per tenure phase, with a total row."""
    scored = predictions.where(F.col("actual_minutes").isNotNull())
    error = F.col("actual_minutes") - F.col("minutes_p50")
    active = (F.col("actual_minutes") > 0).cast("double")
    covered = F.col("actual_minutes").between(F.col("minutes_p10"), F.col("minutes_p90"))
    return scored.rollup("new_team_phase").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
        F.avg(covered.cast("double")).alias("coverage"),
        F.avg(F.pow(F.col("p_active") - active, 2)).alias("brier_active"),
        F.avg("confidence_score").alias("confidence_score"),
    ).withColumn("new_team_phase", F.coalesce("new_team_phase", F.lit("all")))


def confidence(games_played: Column, games_on_team: Column, band: Column, p_active: Column) -> Column:
    """Confidence from history, tenure, interval width and availability."""
    return odds.round6(
        odds.clamp(games_played / 40.0, 0.0, 1.0) * 0.35
        + odds.clamp(games_on_team / 20.0, 0.0, 1.0) * 0.25
        + (1.0 - odds.clamp(band / 20.0, 0.0, 1.0)) * 0.2
        + odds.clamp(p_active, 0.0, 1.0) * 0.2
    )


def quality_flags(games_on_team: Column, games_played: Column, p_active: Column) -> Column:
    return F.concat_ws(
        ",",
        F.when(games_on_team < 5, F.lit("new_team")),
        F.when(games_played < 10, F.lit("low_history")),
        F.when(p_active < 0.75, F.lit("availability_risk")),
    )


def possessions(actions: DataFrame) -> DataFrame:
    """Runs of actions with the same team in possession, numbered per game.

    Gaps and islands per game: a game has a few hundred actions.
    """
    teams = actions.where(F.col("team_id") > 0).groupBy("game_id").agg(
        F.sort_array(F.collect_set("team_id")).alias("teams")
    )
    order = Window.partitionBy("game_id").orderBy("action_number")
    held = actions.where(F.col("possession") > 0).select("game_id", "action_number", "possession")
    starts = held.withColumn(
        "starts",
        F.coalesce((F.col("possession") != F.lag("possession").over(order)), F.lit(True)).cast("int"),
    )
    numbered = starts.withColumn("possession_id", F.sum("starts").over(order))
    runs = numbered.groupBy("game_id", "possession_id").agg(
        F.min("action_number").alias("start_event_num"),
        F.max("action_number").alias("end_event_num"),
        F.first("possession").alias("offense"),
    )
    other = F.get(F.filter("teams", lambda t: t != F.col("offense")), 0)
    return runs.join(teams, "game_id", "left").select(
        "game_id", "possession_id", "start_event_num", "end_event_num",
        F.col("offense").cast("string").alias("offense_team_id"),
        F.when(F.size("teams") == 2, other.cast("string")).otherwise("").alias("defense_team_id"),
    )


def verify_report(games: DataFrame, boxscore: DataFrame, events: DataFrame, runs: DataFrame) -> DataFrame:
    """Violation counts of the clean tables, one row per check."""

    def orphans(rows: DataFrame, label: str) -> DataFrame:
        lost = rows.select("game_id").distinct().join(games.select("game_id"), "game_id", "left_anti")
        return lost.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(f"{label}_missing_game_reference").alias("check"), F.lit("failure").alias("level"), "n"
        )

    def repeats(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
        twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        return twice.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(f"{label}_duplicate_key").alias("check"), F.lit("failure").alias("level"), "n"
        )

    def blanks(column: str) -> DataFrame:
        empty = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
        return games.agg(F.count_if(empty).alias("n")).select(
            F.lit(f"games_missing_{column}").alias("check"), F.lit("failure").alias("level"), "n"
        )

    team_minutes = boxscore.groupBy("game_id", "team_id").agg(
        F.sum(F.coalesce("minutes", F.lit(0.0))).alias("m")
    )
    bands = team_minutes.agg(
        F.count_if(F.col("m") < 240.0).alias("low_warn"),
        F.count_if(F.col("m") < 200.0).alias("low_fail"),
        F.count_if(F.col("m") > 400.0).alias("high_warn"),
    ).select(
        F.explode(
            F.array(
                F.struct(F.lit("team_minutes_below_240").alias("check"), F.lit("warning").alias("level"), F.col("low_warn").alias("n")),
                F.struct(F.lit("team_minutes_below_200").alias("check"), F.lit("failure").alias("level"), F.col("low_fail").alias("n")),
                F.struct(F.lit("team_minutes_above_400").alias("check"), F.lit("warning").alias("level"), F.col("high_warn").alias("n")),
            )
        ).alias("r")
    ).select("r.*")
    parts = [
        orphans(boxscore, "boxscore_players"), orphans(events, "pbp_events"), orphans(runs, "possessions"),
        repeats(events, ["game_id", "event_num"], "pbp_events"),
        repeats(runs, ["game_id", "possession_id"], "possessions"),
        blanks("home_team_id"), blanks("away_team_id"), bands,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
