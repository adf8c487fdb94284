"""Report views of candidates: top lists, sweeps, same-game pairs, overlaps and briefs.

Lists are top-k windows, which Spark limits inside each task before the shuffle. No view
ranks a whole report in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions import labels, names, odds, states
from oddsloom.operators.candidates import candidate_order

REPORT = ["snapshot_id", "strategy_id"]
LINE_TIES = ["event_id", "player", "point", "market"]


def top(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """Best rows per key in a total order, with their position."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(window)).where(
        F.col("position") <= max(0, limit)
    )


def watchlist(candidates: DataFrame, top_n: int) -> DataFrame:
    """Best ineligible candidates per report."""
    return top(candidates.where(~F.col("eligible")), REPORT, candidate_order(), top_n)


def ranked_plays(portfolio: DataFrame) -> DataFrame:
    return portfolio.where("portfolio_selected").withColumn("position", F.col("portfolio_rank"))


def tier_plays(portfolio: DataFrame, tier: str, top_n: int) -> DataFrame:
    """Selected plays of one tier in rank order (A: top value, B: one source)."""
    kept = portfolio.where(F.col("portfolio_selected") & (F.col("tier") == tier))
    return top(kept, REPORT, [F.col("portfolio_rank").asc()], top_n)


def price_watchlist(candidates: DataFrame) -> DataFrame:
    """Ineligible candidates that a better price would turn into plays."""
    return candidates.where(
        ~F.col("eligible")
        & F.col("reason").isin("ev_below_threshold", "tier_b_blocked")
        & F.col("play_to_american").isNotNull()
    )


def under_sweep(candidates: DataFrame, limit: int = 5) -> DataFrame:
    """Qualified unders and closest misses per report, with the count of qualified ones."""
    unders = candidates.where(F.col("recommended_side") == "under")
    counts = candidates.groupBy(*REPORT).agg(
        F.count_if(F.col("eligible") & (F.col("recommended_side") == "under")).alias("qualified_count")
    )
    miss_order = [
        odds.zero_as_missing(F.col("best_ev"), -999.0).desc(), *candidate_order(),
    ]
    listed = top(unders.where("eligible"), REPORT, candidate_order(), limit).withColumn(
        "list", F.lit("qualified")
    ).unionByName(
        top(unders.where(~F.col("eligible")), REPORT, miss_order, limit).withColumn(
            "list", F.lit("closest_miss")
        )
    )
    return listed.join(counts, REPORT).withColumn(
        "status", F.when(F.col("qualified_count") >= 2, "ok").otherwise("insufficient")
    )


def same_game_pairs(candidates: DataFrame, top_n: int = 10, legs: int = 8) -> DataFrame:
    """Two-leg combinations of the best eligible rows of a game, with a correlation haircut.

    Only the best ``legs`` rows of a game pair up, at most 28 pairs whatever the game holds.
    """
    keys = [*REPORT, "event_id"]
    # Legs keep the candidates' own order among equal values, so the score comes next.
    order = [
        odds.zero_as_missing(F.col("best_ev"), -999.0).desc(),
        odds.zero_as_missing(F.col("score"), -9999.0).desc(),
        *[F.col(c) for c in LINE_TIES],
    ]
    leg = F.struct(
        "position", "player", "market", "point", "recommended_side", "selected_price",
        "model_p_hit", "player_team",
    )
    best = top(candidates.where(F.col("eligible") & (F.col("event_id") != "")), keys, order, legs)
    grouped = best.groupBy(*keys).agg(F.array_sort(F.collect_list(leg)).alias("legs"))
    paired = grouped.withColumn("a", F.explode("legs")).withColumn(
        "b", F.explode(F.filter("legs", lambda x: x["position"] > F.col("a.position")))
    )
    a, b = F.col("a"), F.col("b")
    both_over = (a["recommended_side"] == "over") & (b["recommended_side"] == "over")
    scoring = ("player_points", "player_assists", "player_points_rebounds_assists")
    haircut = (
        F.when(a["player"] == b["player"], 0.15)
        .when((a["player_team"] == b["player_team"]) & both_over, 0.12)
        .when(a["market"].isin(*scoring) | b["market"].isin(*scoring), 0.08)
        .otherwise(0.05)
    )
    joint = a["model_p_hit"] * b["model_p_hit"]
    payout = odds.decimal_odds(a["selected_price"]) * odds.decimal_odds(b["selected_price"])
    combos = paired.where(joint.isNotNull() & payout.isNotNull()).select(
        *keys, "a", "b", joint.alias("joint"), haircut.alias("haircut"), payout.alias("payout")
    )
    p = F.col("joint") * (1.0 - F.col("haircut"))
    american = odds.american_odds(F.col("payout"))
    ev = p * (F.col("payout") - 1.0) - (1.0 - p)
    priced = combos.select(
        *keys,
        F.col("a.player").alias("player_a"), F.col("a.market").alias("market_a"),
        F.col("a.point").alias("point_a"), F.col("a.recommended_side").alias("side_a"),
        F.col("b.player").alias("player_b"), F.col("b.market").alias("market_b"),
        F.col("b.point").alias("point_b"), F.col("b.recommended_side").alias("side_b"),
        odds.round6(F.col("joint")).alias("independence_joint_p"),
        "haircut",
        odds.round6(p).alias("adjusted_joint_p"),
        odds.round6(F.col("payout")).alias("unboosted_decimal"),
        american.alias("unboosted_american"),
        F.round(ev * 100.0 + 1e-9, 3).alias("ev_per_100"),
        odds.round6(odds.kelly_fraction(p, american) / 2.0).alias("recommended_fractional_kelly"),
    )
    final = [
        odds.zero_as_missing(F.col("ev_per_100"), -999.0).desc(),
        *[F.col(c) for c in ("event_id", "player_a", "market_a", "point_a", "player_b", "market_b", "point_b")],
    ]
    return top(priced, REPORT, final, top_n)


def ranked_overlap(portfolio: DataFrame) -> DataFrame:
    """Picks shared by all strategies and by any, per snapshot."""
    picks = portfolio.where("portfolio_selected")
    strategies = picks.groupBy("snapshot_id").agg(F.count_distinct("strategy_id").alias("strategies"))
    shared = picks.groupBy(
        "snapshot_id", "event_id", "player", "market", "point", "recommended_side"
    ).agg(F.count_distinct("strategy_id").alias("n"))
    return shared.join(strategies, "snapshot_id").groupBy("snapshot_id").agg(
        F.max("strategies").alias("strategies"),
        F.count_if(F.col("n") == F.col("strategies")).alias("intersection_all"),
        F.count(F.lit(1)).alias("union_all"),
    )


def report_summary(candidates: DataFrame) -> DataFrame:
    """Counters of a report."""
    ok = F.col("eligible")
    return candidates.groupBy(*REPORT).agg(
        F.count_distinct("event_id").alias("events"),
        F.count(F.lit(1)).alias("candidate_lines"),
        F.count_if(F.col("tier") == "A").alias("tier_a_lines"),
        F.count_if(F.col("tier") == "B").alias("tier_b_lines"),
        F.count_if(ok).alias("eligible_lines"),
        F.count_if(ok & (F.col("tier") == "A")).alias("eligible_tier_a"),
        F.count_if(ok & (F.col("tier") == "B")).alias("eligible_tier_b"),
        F.count_if(ok & F.col("pre_bet_ready")).alias("eligible_pre_bet_ready"),
        F.count_if(ok & (F.col("recommended_side") == "under")).alias("qualified_unders"),
        F.avg("quality_score").alias("avg_quality_score_all"),
        F.avg(F.when(ok, F.col("quality_score"))).alias("avg_quality_score_eligible"),
        F.avg(F.when(ok, F.col("ev_low"))).alias("avg_ev_low_eligible"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("actionability_rate"),
    )


def exclusion_reasons(portfolio: DataFrame) -> DataFrame:
    return (
        portfolio.where(F.col("portfolio_reason") != "")
        .groupBy(*REPORT, "portfolio_reason")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def roster_warnings(candidates: DataFrame, limit: int = 30) -> DataFrame:
    """First distinct roster warnings per report in text order."""
    warning = states.roster_warning(F.col("roster_status"), F.col("player"), F.col("event_id"))
    distinct = candidates.select(*REPORT, warning.alias("warning")).where(
        F.col("warning").isNotNull()
    ).distinct()
    return top(distinct, REPORT, [F.col("warning").asc()], limit)


def verified_players(portfolio: DataFrame) -> DataFrame:
    """First play of each (player, team) among the selected plays, tier A before B, with a roster link."""
    key = [*REPORT, "player_key", "player_team"]
    order = [F.col("tier").asc(), F.col("portfolio_rank").asc()]
    first = top(portfolio.where("portfolio_selected"), key, order, 1)
    return first.withColumn(
        "verification_link", names.roster_link(F.col("player_team"), F.col("player"))
    )


# --- briefs ----------------------------------------------------------------------------


def action(best_ev: Column, injury: Column, roster: Column, reason: Column, watch: bool = False) -> Column:
    """GO, LEAN or NO-GO of a row; only clean availability can be played."""
    blocked = (
        F.lit(watch)
        | reason.isin("injury_gate", "roster_gate")
        | ~states.clean_injury(injury)
        | ~states.clean_roster(roster)
        | best_ev.isNull()
    )
    return (
        F.when(blocked, "NO-GO")
        .when(best_ev >= 0.05, "GO")
        .when(best_ev >= 0.02, "LEAN")
        .otherwise("NO-GO")
    )


def action_rank(value: Column) -> Column:
    return F.when(value == "GO", 0).when(value == "LEAN", 1).when(value == "NO-GO", 2).otherwise(3)


def _fixed(value: Column, places: int) -> Column:
    """Digits of a number, rounded as its binary value lies (halves to even)."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


# The sentences of edge notes and reasons.
def edge_note(best_ev: Column, kelly: Column) -> Column:
    pct = F.coalesce(best_ev, F.lit(0.0)) * 100.0
    strength = (
        F.when(pct >= 8.0, "Strong edge").when(pct >= 4.0, "Moderate edge")
        .when(pct > 0.0, "Thin edge").otherwise("No edge")
    )
    stake = (
        F.when(kelly >= 0.10, "Higher stake").when(kelly >= 0.05, "Medium stake")
        .when(kelly > 0.0, "Small stake").otherwise("No stake")
    )
    signed = F.concat(F.when(pct >= 0, "+").otherwise(""), _fixed(pct, 1))
    note = F.format_string("%s (%s%% est.), %s", strength, signed, stake)
    return F.when(best_ev.isNull() & kelly.isNull(), "n/a").otherwise(note)


def plain_reason(verdict: Column, injury: Column, roster: Column, tier: Column, best_ev: Column, reason: Column) -> Column:
    ev = F.coalesce(_fixed(best_ev, 3), F.lit("n/a"))
    risky = (reason == "injury_gate") | injury.isin("out", "out_for_season", "doubtful")
    unrostered = (reason == "roster_gate") | roster.isin("inactive", "not_on_roster")
    no_go = (
        F.when(risky, "No-go because player availability risk is too high.")
        .when(unrostered, "No-go because roster check does not confirm active status.")
        .otherwise(
            F.format_string("No-go due to weak edge or missing confidence signals (EV %s).", ev)
        )
    )
    lean = F.format_string("Lean: positive edge (EV %s) but not strong enough for full GO.", ev)
    go = F.format_string(
        "Go: verified availability with tier %s market depth and positive edge (EV %s).", tier, ev
    )
    return F.when(verdict == "NO-GO", no_go).when(verdict == "LEAN", lean).otherwise(go)


def brief_plays(portfolio: DataFrame) -> DataFrame:
    """Selected plays with verdict, ticket text, notes and brief rank."""
    side = F.when(F.col("recommended_side") == "under", "under").otherwise("over")
    price = F.when(side == "under", F.col("under_price")).otherwise(F.col("over_price"))
    verdict = action(F.col("best_ev"), F.col("injury_status"), F.col("roster_status"), F.col("reason"))
    rows = portfolio.where("portfolio_selected").withColumns(
        {
            "action_default": verdict,
            "game_label": names.game_label(F.col("away_team"), F.col("home_team")),
            "ticket": labels.brief_ticket(
                F.col("player"), side, F.col("point"), F.col("market"), price, F.col("selected_book")
            ),
            "edge_note": edge_note(F.col("best_ev"), F.col("best_kelly")),
        }
    )
    return rows.withColumn(
        "plain_reason",
        plain_reason(
            F.col("action_default"), F.col("injury_status"), F.col("roster_status"), F.col("tier"),
            F.col("best_ev"), F.col("reason"),
        ),
    )


def brief_order() -> list[Column]:
    return [
        action_rank(F.col("action_default")).asc(),
        odds.zero_as_missing(F.col("best_ev"), -999.0).desc(),
        F.col("game_label").asc(), F.col("player").asc(),
        *[F.col(c).asc() for c in ("event_id", "market", "point")],
    ]


def game_cards(plays: DataFrame, per_game: int = 5, min_ev: float = 0.01) -> DataFrame:
    """Best plays per game: clear ones, else any playable one, else all."""
    playable = F.col("action_default").isin("GO", "LEAN")
    level = (
        F.when(playable & (F.col("best_ev") >= max(0.0, min_ev)), 2)
        .when(F.col("action_default") != "NO-GO", 1)
        .otherwise(0)
    )
    leveled = plays.withColumn("level", level)
    reached = leveled.groupBy(*REPORT, "event_id").agg(F.max("level").alias("wanted"))
    kept = leveled.join(reached, [*REPORT, "event_id"]).where(
        F.when(F.col("wanted") == 2, F.col("level") == 2)
        .when(F.col("wanted") == 1, F.col("level") >= 1)
        .otherwise(F.lit(True))
    )
    return top(kept, [*REPORT, "event_id"], brief_order(), per_game).drop("level", "wanted")


def best_available(plays: DataFrame) -> DataFrame:
    """First GO or LEAN play of a report that is ready to bet."""
    ready = plays.where(F.col("action_default").isin("GO", "LEAN") & F.col("pre_bet_ready"))
    return top(ready, REPORT, brief_order(), 1)
