"""Game context: event lines, injuries, rosters and what they say about each player.

Context is reduced to one row per (snapshot, event, player) before it meets the priced
lines. Join sides are left to the optimizer: their size is known at run time, not here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions import clocks, labels, names, states

EVENT = ["snapshot_id", "event_id"]
COUNTED_STATUSES = ("out", "out_for_season", "doubtful", "questionable")


def keyed_context(context: DataFrame) -> DataFrame:
    """Event context with canonical home and away keys."""
    return context.select(
        *EVENT, "home_team", "away_team", "commence_time",
        names.team_key(F.col("home_team")).alias("home"),
        names.team_key(F.col("away_team")).alias("away"),
    )


def event_lines(slate: DataFrame, context: DataFrame) -> DataFrame:
    """Median total and home spread per event, with teams and tip time.

    Quotes are counted per distinct point first, so a hot event reaches the shuffle as a
    few counted points; the median weighs each point by its count.
    """
    counted = (
        slate.where(F.col("point").isNotNull() & F.col("market").isin("totals", "spreads"))
        .withColumn(
            "side_team", F.when(F.col("market") == "spreads", names.team_key(F.col("side")))
        )
        .groupBy(*EVENT, "market", "side_team", "point")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keyed = keyed_context(context)
    sided = counted.join(keyed.select(*EVENT, "home", "away"), EVENT, "left").withColumn(
        "home_point",
        F.when(F.col("side_team") == "", None)
        .when(F.col("side_team") == F.col("home"), F.col("point"))
        .when(F.col("side_team") == F.col("away"), -F.col("point")),
    )

    def median(value: Column, market: str) -> Column:
        kept = F.when(F.col("market") == market, value)
        return F.round(F.percentile(kept, 0.5, F.col("n")), 1)

    medians = sided.groupBy(*EVENT).agg(
        median(F.col("point"), "totals").alias("total"),
        median(F.col("home_point"), "spreads").alias("home_spread"),
    )
    return medians.join(keyed, EVENT, "full_outer").select(
        *EVENT,
        F.coalesce("home_team", F.lit("")).alias("home_team"),
        F.coalesce("away_team", F.lit("")).alias("away_team"),
        F.coalesce("home", F.lit("")).alias("home"),
        F.coalesce("away", F.lit("")).alias("away"),
        "commence_time",
        clocks.tip_label(F.col("commence_time")).alias("tip_et"),
        "total",
        "home_spread",
        F.abs("home_spread").alias("spread_abs"),
        labels.spread_label(
            F.coalesce(F.nullif("home_team", F.lit("")), F.lit("Home")), F.col("home_spread")
        ).alias("spread_text"),
    )


def clean_injuries(injuries: DataFrame) -> DataFrame:
    """Injury rows with canonical keys; rows without a usable name are dropped."""
    return injuries.select(
        "snapshot_id",
        "source",
        F.trim("player").alias("player"),
        names.person_key(F.col("player")).alias("player_key"),
        "team",
        names.team_key(F.col("team")).alias("team_norm"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("note", F.lit("")).alias("note"),
        F.coalesce("date_update", F.lit("")).alias("date_update"),
        "row_order",
    ).where(F.col("player_key") != "")


def merged_injuries(injuries: DataFrame) -> DataFrame:
    """One row per player: the official report wins, the team comes from the secondary feed.

    The last row of a source wins within it. ``max_by`` combines map-side, so a player
    repeated in many rows costs one candidate row per task and source.
    """
    row = F.struct("player", "team", "team_norm", "status", "note", "date_update")

    def last(source: str) -> Column:
        return F.max_by(F.when(F.col("source") == source, row), F.when(F.col("source") == source, F.col("row_order")))

    sides = clean_injuries(injuries).groupBy("snapshot_id", "player_key").agg(
        last("official").alias("official"), last("secondary").alias("secondary")
    )

    def pick(field: str, first: str, second: str) -> Column:
        return F.coalesce(F.col(f"{first}.{field}"), F.col(f"{second}.{field}")).alias(field)

    return sides.select(
        "snapshot_id",
        "player_key",
        pick("player", "official", "secondary"),
        pick("status", "official", "secondary"),
        pick("note", "official", "secondary"),
        pick("date_update", "official", "secondary"),
        pick("team", "secondary", "official"),
        pick("team_norm", "secondary", "official"),
        F.when(F.col("official").isNotNull(), "official").otherwise("secondary").alias("source"),
        F.col("official").isNotNull().alias("listed_officially"),
    )


def gravest_injuries(injuries: DataFrame) -> DataFrame:
    """Injury index: the gravest status per player, then the latest update."""
    severity = states.rank_of(F.col("status"), states.INJURY_SEVERITY)
    order = F.struct(severity, F.col("date_update"), F.col("row_order"))
    best = F.max_by(F.struct("status", "date_update", "team_norm", "source"), order)
    return (
        clean_injuries(injuries)
        .groupBy("snapshot_id", "player_key")
        .agg(best.alias("best"))
        .select("snapshot_id", "player_key", "best.*")
    )


def team_injury_counts(merged: DataFrame) -> DataFrame:
    """Players per status and team."""
    return (
        merged.where(F.col("team_norm") != "")
        .groupBy("snapshot_id", F.col("team_norm").alias("team"))
        .agg(*[F.count_if(F.col("status") == s).alias(s) for s in COUNTED_STATUSES])
    )


def source_health(injuries: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Rows per injury source, and whether the source can be used.

    ``feeds`` (snapshot_id, source, status, parse_status) tells how each source was read; a source is ready
    when it has rows, its status is ``ok`` and its parse status is empty or ``ok``. Without ``feeds`` rows suffice.
    """
    counts = injuries.groupBy("snapshot_id").agg(
        F.count_if(F.col("source") == "official").alias("official_rows"),
        F.count_if(F.col("source") == "secondary").alias("secondary_rows"),
    )
    if feeds is None:
        usable = counts.withColumns({"official_ok": F.lit(True), "secondary_ok": F.lit(True)})
    else:
        good = (F.col("status") == "ok") & F.coalesce("parse_status", F.lit("")).isin("", "ok")
        read = feeds.groupBy("snapshot_id").agg(
            *[
                F.coalesce(F.bool_and(F.when(F.col("source") == s, good)), F.lit(False)).alias(f"{s}_ok")
                for s in ("official", "secondary")
            ]
        )
        usable = counts.join(read, "snapshot_id", "left")
    return usable.select(
        "snapshot_id",
        "official_rows",
        "secondary_rows",
        ((F.col("official_rows") > 0) & F.coalesce("official_ok", F.lit(False))).alias("official_ready"),
        ((F.col("secondary_rows") > 0) & F.coalesce("secondary_ok", F.lit(False))).alias("secondary_ready"),
    )


def team_rosters(roster: DataFrame) -> DataFrame:
    """Active, inactive and full member sets of a team; a team has a few dozen members."""
    key = names.person_key(F.col("player"))
    status = F.upper(F.trim("status"))
    return (
        roster.withColumn("member", key)
        .where(F.col("member") != "")
        .groupBy("snapshot_id", names.team_key(F.col("team")).alias("team"))
        .agg(
            F.array_sort(F.collect_set(F.when(status == "ACTIVE", F.col("member")))).alias("active"),
            F.array_sort(F.collect_set(F.when(status == "INACTIVE", F.col("member")))).alias("inactive"),
            F.array_sort(F.collect_set("member")).alias("members"),
        )
    )


def event_rosters(context: DataFrame, rosters: DataFrame) -> DataFrame:
    """Context rows with the rosters of both teams; a missing team leaves nulls."""

    def of(side: str) -> DataFrame:
        return rosters.select(
            "snapshot_id",
            F.col("team").alias(side),
            *[F.col(c).alias(f"{side}_{c}") for c in ("active", "inactive", "members")],
        )

    keyed = keyed_context(context).select(*EVENT, "home", "away")
    return keyed.join(of("home"), ["snapshot_id", "home"], "left").join(
        of("away"), ["snapshot_id", "away"], "left"
    )


def with_aliases(players: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """Player rows with their key and aliases, one hop through the identity map if given."""
    keyed = players.withColumns(
        {
            "player_key": names.person_key(F.col("player")),
            "aliases": names.name_aliases(F.col("player")),
        }
    )
    if identity is None:
        return keyed
    known = identity.select(F.col("player_key").alias("alias"), F.col("aliases").alias("more"), "teams")
    distinct_names = keyed.select("player", "aliases").distinct()
    hops = (
        distinct_names.select("player", F.explode("aliases").alias("alias"))
        .join(known, "alias")
        .groupBy("player")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("more"))).alias("more"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("teams")))).alias("identity_teams"),
        )
    )
    return (
        keyed.join(hops, "player", "left")
        .withColumn(
            "aliases",
            F.array_union("aliases", F.coalesce("more", F.array().cast("array<string>"))),
        )
        .drop("more")
    )


def roster_status_column() -> Column:
    """Roster status from alias/roster overlaps; needs event_rosters and aliases columns."""

    def listed(kind: str) -> Column:
        return F.arrays_overlap("aliases", f"home_{kind}") | F.arrays_overlap("aliases", f"away_{kind}")

    unmapped = F.coalesce(F.col("home"), F.lit("")) == ""
    unmapped = unmapped | (F.coalesce(F.col("away"), F.lit("")) == "")
    return (
        F.when(unmapped, "unknown_event")
        .when(F.col("home_members").isNull() | F.col("away_members").isNull(), "unknown_roster")
        .when(listed("inactive"), "inactive")
        .when(listed("active"), "active")
        .when(listed("members"), "rostered")
        .otherwise("not_on_roster")
    )


def _exclusive_team() -> Column:
    at_home = F.coalesce(F.arrays_overlap("aliases", "home_members"), F.lit(False))
    at_away = F.coalesce(F.arrays_overlap("aliases", "away_members"), F.lit(False))
    both_known = F.col("home_members").isNotNull() & F.col("away_members").isNotNull()
    return F.when(both_known & at_home & ~at_away, F.col("home")).when(
        both_known & at_away & ~at_home, F.col("away")
    )


def player_context(
    players: DataFrame,
    context: DataFrame,
    roster: DataFrame,
    injuries: DataFrame,
    identity: DataFrame | None = None,
) -> DataFrame:
    """Roster and injury status, team, opponent and injury counts per (event, player)."""
    merged = merged_injuries(injuries)
    rosters = team_rosters(roster)
    keyed = with_aliases(players.select(*EVENT, "player").distinct(), identity)
    placed = keyed.join(event_rosters(context, rosters), EVENT, "left").withColumn(
        "roster_status", roster_status_column()
    )
    injured = placed.join(
        merged.select(
            "snapshot_id", "player_key", F.col("status").alias("listed_status"), "note",
            F.col("team_norm").alias("injury_team"), "listed_officially",
        ),
        ["snapshot_id", "player_key"],
        "left",
    ).join(source_health(injuries).select("snapshot_id", "official_ready"), "snapshot_id", "left")
    unlisted = (
        F.coalesce("official_ready", F.lit(False))
        & ~F.coalesce("listed_officially", F.lit(False))
        & states.clean_roster(F.col("roster_status"))
    )
    note = F.coalesce("note", F.lit(""))
    in_game = F.col("injury_team").isin(F.col("home"), F.col("away")) & (F.col("injury_team") != "")
    identity_team = (
        F.get(
            F.filter("identity_teams", lambda t: (t == F.col("home")) | (t == F.col("away"))), 0
        )
        if identity is not None
        else F.lit(None).cast("string")
    )
    resolved = injured.withColumns(
        {
            "injury_status": F.when(unlisted, "available_unlisted").otherwise(
                F.coalesce("listed_status", F.lit("unknown"))
            ),
            "injury_note": F.when(
                unlisted & (note == ""), "Not listed on official NBA injury report."
            ).otherwise(note),
            "player_team": F.coalesce(
                _exclusive_team(), F.when(in_game, F.col("injury_team")), identity_team, F.lit("")
            ),
        }
    ).withColumn(
        "opponent_team",
        F.when(F.col("player_team") == "", "")
        .when(F.col("player_team") == F.col("home"), F.col("away"))
        .when(F.col("player_team") == F.col("away"), F.col("home"))
        .otherwise(""),
    )
    counts = team_injury_counts(merged)

    def of(role: str) -> DataFrame:
        return counts.select(
            "snapshot_id",
            F.col("team").alias(f"{role}_team"),
            *[F.col(s).alias(f"{role}_{s}") for s in COUNTED_STATUSES],
        )

    counted = resolved.join(of("player"), ["snapshot_id", "player_team"], "left").join(
        of("opponent"), ["snapshot_id", "opponent_team"], "left"
    )
    own_row = F.coalesce(F.col("injury_team") == F.col("player_team"), F.lit(False))

    def teammates(status: str) -> Column:
        self_count = F.when(own_row & (F.col("listed_status") == status), 1).otherwise(0)
        return F.coalesce(F.col(f"player_{status}"), F.lit(0)) - self_count

    def opponents(status: str) -> Column:
        return F.coalesce(F.col(f"opponent_{status}"), F.lit(0))

    return counted.select(
        *EVENT, "player", "player_key", "roster_status", "injury_status", "injury_note",
        "player_team", "opponent_team",
        (teammates("out") + teammates("out_for_season")).alias("teammate_out_count"),
        teammates("doubtful").alias("teammate_doubtful_count"),
        teammates("questionable").alias("teammate_questionable_count"),
        (opponents("out") + opponents("out_for_season")).alias("opponent_out_count"),
        opponents("doubtful").alias("opponent_doubtful_count"),
    )


def missing_event_mappings(quotes: DataFrame, context: DataFrame) -> DataFrame:
    """Quoted events without context."""
    quoted = quotes.select("snapshot_id", F.trim("event_id").alias("event_id")).distinct()
    return quoted.where(F.col("event_id") != "").join(context.select(*EVENT), EVENT, "left_anti")


def key_injuries(injuries: DataFrame, context: DataFrame, top_n: int = 20) -> DataFrame:
    """Gravest current injuries of the teams in play, numbered per snapshot."""
    keyed = keyed_context(context)
    in_scope = (
        keyed.select("snapshot_id", F.explode(F.array("home", "away")).alias("team_norm")).distinct()
    )
    rank = states.rank_of(F.col("status"), states.KEY_INJURY_RANK)
    listed = merged_injuries(injuries).where(rank > 0)
    scoped = listed.join(in_scope, ["snapshot_id", "team_norm"], "left_semi")
    order = Window.partitionBy("snapshot_id").orderBy(rank.desc(), "date_update", "player")
    return (
        scoped.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= top_n)
        .select("snapshot_id", "position", "player", "team", "status", "note", "date_update")
    )


def stale_flag(fetched_at: Column, now: Column, max_hours: float) -> Column:
    """True when a context is missing its fetch time or older than the limit."""
    hours = (F.unix_micros(now) - F.unix_micros(fetched_at)) / F.lit(3_600_000_000.0)
    return F.coalesce(hours > max(0.0, max_hours), F.lit(True))
