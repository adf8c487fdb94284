"""Rosters and injuries from results, feeds and fallbacks; event context with the last writer's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import names, parsing, states


def rosters_from_results(games: DataFrame, players: DataFrame) -> DataFrame:
    """Active, inactive and all players per team, from box scores.

    ``games`` has snapshot_id, game_id, home_team and away_team; ``players`` snapshot_id, player, team and status.
    Teams without players keep empty sets.
    """
    keys = ["snapshot_id", "team"]
    team_games = games.select(
        "snapshot_id",
        "game_id",
        F.explode(
            F.array(names.team_key(F.col("home_team")), names.team_key(F.col("away_team")))
        ).alias("team"),
    ).where(F.col("team") != "")
    key = names.person_key(F.col("player"))
    inactive = F.upper(F.trim("status")) == "INACTIVE"
    members = (
        players.select(
            "snapshot_id",
            names.team_key(F.col("team")).alias("team"),
            key.alias("member"),
            F.coalesce(inactive, F.lit(False)).alias("inactive"),
        )
        .where((F.col("member") != "") & (F.col("team") != ""))
        .groupBy(*keys)
        .agg(
            F.array_sort(F.collect_set(F.when(~F.col("inactive"), F.col("member")))).alias("active"),
            F.array_sort(F.collect_set(F.when(F.col("inactive"), F.col("member")))).alias("inactive"),
            F.array_sort(F.collect_set("member")).alias("members"),
        )
    )
    played = team_games.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.nullif("game_id", F.lit("")))).alias("game_ids")
    )
    none = F.array().cast("array<string>")
    return played.join(members, keys, "full").select(
        *keys,
        *[F.coalesce(c, none).alias(c) for c in ("active", "inactive", "members", "game_ids")],
    )


def injuries_from_results(players: DataFrame) -> DataFrame:
    """Injury rows from box scores: inactive players are out, others available."""
    return players.select(
        "snapshot_id",
        F.trim("player").alias("player"),
        names.person_key(F.col("player")).alias("player_key"),
        names.team_key(F.col("team")).alias("team_norm"),
        F.when(F.upper(F.trim("status")) == "INACTIVE", "out").otherwise("available").alias("status"),
        F.lit("historical_boxscore_status").alias("note"),
        F.lit("historical_boxscore").alias("source"),
    ).where((F.col("player") != "") & (F.col("player_key") != "") & (F.col("team_norm") != ""))


def feed_rosters(athletes: DataFrame, injuries: DataFrame) -> DataFrame:
    """Rosters of a feed; players that the injury feed lists as unlikely are inactive."""
    unlikely = (
        injuries.select("snapshot_id", names.person_key(F.col("player")).alias("member"), "status")
        .where(states.injury_status(F.col("status")).isin("out", "out_for_season", "doubtful"))
        .select("snapshot_id", "member", F.lit(True).alias("unlikely"))
        .distinct()
    )
    members = athletes.select(
        "snapshot_id", names.team_key(F.col("team")).alias("team"), names.person_key(F.col("player")).alias("member")
    ).where((F.col("member") != "") & (F.col("team") != ""))
    out = F.coalesce("unlikely", F.lit(False))
    return (
        members.join(unlikely, ["snapshot_id", "member"], "left")
        .groupBy("snapshot_id", "team")
        .agg(
            F.array_sort(F.collect_set(F.when(~out, F.col("member")))).alias("active"),
            F.array_sort(F.collect_set(F.when(out, F.col("member")))).alias("inactive"),
            F.array_sort(F.collect_set("member")).alias("members"),
        )
    )


def with_fallback(primary: DataFrame, fallback: DataFrame, scope: DataFrame) -> DataFrame:
    """Primary rosters, and for teams of ``scope`` that have none there, those of the fallback."""
    keys = ["snapshot_id", "team"]
    columns = [*keys, "active", "inactive", "members"]
    held = primary.where(F.size("members") > 0).select(*columns)
    missing = scope.select(*keys).distinct().join(held.select(*keys), keys, "left_anti")
    found = fallback.select(*columns).join(missing, keys, "left_semi")
    # A primary row without members gives way to the fallback's row, if there is one.
    empty = primary.where(F.size("members") == 0).select(*columns).join(found.select(*keys), keys, "left_anti")
    tag = lambda frame, name: frame.withColumn("roster_source", F.lit(name))
    return tag(held, "primary").unionByName(tag(empty, "primary")).unionByName(tag(found, "fallback"))


def first_ready(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the first source that was read well, per snapshot.

    ``sources`` has snapshot_id, source, priority and status; ``rows`` snapshot_id and source.
    """
    best = (
        sources.where(F.col("status") == "ok")
        .groupBy("snapshot_id")
        .agg(F.min_by("source", F.struct("priority", "source")).alias("source"))
    )
    return rows.join(best, ["snapshot_id", "source"], "left_semi")


def last_event_context(responses: DataFrame) -> DataFrame:
    """Event context of a snapshot: of the responses that name an event, the last one counts.

    ``responses`` has snapshot_id, event_id, request_order and the context columns.
    """
    values = [c for c in responses.columns if c not in ("snapshot_id", "event_id", "request_order")]
    named = responses.where(parsing.text(F.col("event_id")) != "")
    last = named.groupBy("snapshot_id", "event_id").agg(
        F.max_by(F.struct(*values), "request_order").alias("row")
    )
    return last.select("snapshot_id", "event_id", "row.*")


def game_results(games: DataFrame, players: DataFrame, failed: DataFrame) -> DataFrame:
    """Games with their number of box-score players, and the error of a box score that was not read."""
    keys = ["snapshot_id", "game_id"]
    counted = players.groupBy(*keys).agg(F.count(F.lit(1)).alias("players"))
    errors = failed.groupBy(*keys).agg(F.min("error").alias("error"))
    return (
        games.join(counted, keys, "left")
        .join(errors, keys, "left")
        .withColumns(
            {
                "players": F.coalesce("players", F.lit(0)),
                "error": F.when(
                    F.coalesce("players", F.lit(0)) == 0, F.coalesce("error", F.lit("boxscore_missing"))
                ).otherwise(""),
            }
        )
    )


def first_filled(*columns: Column) -> Column:
    """First value that is not blank: an alias column stands in for an absent one."""
    return F.coalesce(*[F.nullif(parsing.text(c), F.lit("")) for c in columns], F.lit(""))
