"""Queries over quotes: pairs, lines, curves, context and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.functions import odds
from oddsloom.operators import candidates, context, pricing, reference_curve
from oddsloom.plans import bindings as b
from oddsloom.plans.catalog import candidates_stage, inputs, lines_stage, portfolio_stage, r6, raw_candidates_stage, register, ts
from oddsloom.plans.oracles import decimal

LINE = "snapshot_id event_id market player point"
LINE_SQL = "snapshot_id, event_id, market, player, point"


@register(
    "book_fair_pairs",
    f"{LINE} book over_price under_price p_over_implied p_under_implied p_over_fair hold",
    f"select {LINE_SQL}, book, cast(over_price as integer) as over_price, cast(under_price as integer) as under_price, "
    f"{r6('p_over_implied p_under_implied p_over_fair hold')} from o_pairs",
)
def book_fair_pairs(spark, sf):
    return pricing.fair_pairs(pricing.line_books(b.quotes(spark, sf), links=False))


@register(
    "line_best_sides",
    f"{LINE} tier book_count over_price over_book over_link over_books over_shop_delta "
    "under_price under_book under_link under_books under_shop_delta over_decimal under_decimal",
    f"select {LINE_SQL}, case when book_count >= 2 then 'A' else 'B' end as tier, "
    "cast(book_count as integer) as book_count, cast(over_price as integer) as over_price, "
    "over_book, over_link, cast(over_books as integer) as over_books, "
    "cast(over_delta as integer) as over_shop_delta, cast(under_price as integer) as under_price, "
    "under_book, under_link, cast(under_books as integer) as under_books, "
    "cast(under_delta as integer) as under_shop_delta, "
    f"round({decimal('over_price')}, 6) as over_decimal, "
    f"round({decimal('under_price')}, 6) as under_decimal from o_scn where xb = ''",
)
def line_best_sides(spark, sf):
    lines = pricing.priced_lines(b.quotes(spark, sf))
    over, under = -F.col("over_best.cost"), -F.col("under_best.cost")
    return lines.withColumns(
        {
            "over_price": over,
            "under_price": under,
            "over_book": F.col("over_best.book"),
            "under_book": F.col("under_best.book"),
            "over_link": F.col("over_best.link"),
            "under_link": F.col("under_best.link"),
            "over_decimal": odds.decimal_odds(over),
            "under_decimal": odds.decimal_odds(under),
        }
    )


@register(
    "line_pricing_quality",
    f"{LINE} books_used book_pair_count p_over_median hold_median p_over_iqr p_over_range freshest_quote "
    "quote_age_minutes depth_score hold_score dispersion_score freshness_score quality_score uncertainty_band",
    f"select {LINE_SQL}, books_used, cast(n_pairs as integer) as book_pair_count, "
    f"{r6('p_over_median=p_med hold_median=hold_med p_over_iqr=iqr p_over_range=rng quote_age_minutes=age')}, "
    f"{ts('freshest', 'freshest_quote')}, "
    f"{r6('depth_score=depth hold_score=hold_sc dispersion_score=disp_sc freshness_score=fresh_sc')}, "
    "quality as quality_score, band as uncertainty_band from o_scn where xb = ''",
)
def line_pricing_quality(spark, sf):
    """Flagship: quotes to line quality."""
    return pricing.priced_lines(b.quotes(spark, sf), links=False)


@register(
    "reference_curve",
    f"{LINE} raw p_over hold weight",
    f"select {LINE_SQL}, {r6('raw p_over hold weight=w')} from o_curve where xb = ''",
)
def reference_curve_points(spark, sf):
    points = reference_curve.reference_points(pricing.priced_lines(b.quotes(spark, sf), links=False))
    return reference_curve.curve_points(reference_curve.reference_curves(points))


@register(
    "reference_estimate",
    f"{LINE} method points ref_p ref_hold curve_books",
    f"select {LINE_SQL}, ref_method as method, cast(n_points as integer) as points, {r6('ref_p ref_hold')}, "
    "curve_books from o_scn where xb = ''",
)
def reference_estimate(spark, sf):
    lines = candidates.with_reference(pricing.priced_lines(b.quotes(spark, sf), links=False))
    return lines.select(
        *pricing.LINE, "reference.method", "reference.points",
        F.col("reference.p_over").alias("ref_p"), F.col("reference.hold").alias("ref_hold"),
        "curve_books",
    )


_MEDIAN_BASE = (
    "case when p_med is not null and hold_med is not null then {a} when ref_p is not null then {b} else {c} end"
)


@register(
    "baseline_selection",
    f"{LINE} p_over_fair hold baseline_used reference_method line_source",
    f"select {LINE_SQL}, round({_MEDIAN_BASE.format(a='p_med', b='ref_p', c='p_best')}, 6) as p_over_fair, "
    f"round({_MEDIAN_BASE.format(a='hold_med', b='ref_hold', c='hold_best')}, 6) as hold, "
    + _MEDIAN_BASE.format(a="'median_book'", b="'median_book_interpolated'", c="'best_sides_fallback'")
    + " as baseline_used, case when p_med is not null and hold_med is not null then 'exact' else ref_method end as reference_method, "
    + _MEDIAN_BASE.format(a="'exact_point_pairs'", b="'reference_curve'", c="'best_sides'")
    + " as line_source from o_scn where xb = ''",
)
def baseline_selection(spark, sf):
    lines = candidates.with_reference(pricing.priced_lines(b.quotes(spark, sf), links=False))
    chosen = candidates.baseline(F.col, F.lit("median_book"), F.lit("best_sides"))
    return lines.withColumn("base", chosen).select(
        *pricing.LINE, F.col("base.p_over").alias("p_over_fair"), "base.hold",
        F.col("base.used").alias("baseline_used"), "base.reference_method",
        candidates.line_source(F.col("base.used")).alias("line_source"),
    )


@register(
    "leave_one_out_pricing",
    f"{LINE} excluded_book book_pair_count p_over_best hold_best p_over_median hold_median quality_score "
    "uncertainty_band method ref_p ref_hold curve_books",
    f"select {LINE_SQL}, xb as excluded_book, cast(n_pairs as integer) as book_pair_count, "
    f"{r6('p_over_best=p_best hold_best p_over_median=p_med hold_median=hold_med')}, quality as quality_score, "
    f"band as uncertainty_band, ref_method as method, {r6('ref_p ref_hold')}, curve_books from o_scn where xb <> ''",
)
def leave_one_out_pricing(spark, sf):
    lines = pricing.priced_lines(b.quotes(spark, sf), links=False)
    return candidates.leave_one_out(lines).withColumns(
        {
            "method": F.col("reference.method"),
            "ref_p": F.col("reference.p_over"),
            "ref_hold": F.col("reference.hold"),
        }
    )


@register(
    "event_lines",
    "snapshot_id event_id home_team away_team tip_et total home_spread spread_abs spread_text",
    "select snapshot_id, event_id, home_team, away_team, "
    "coalesce(strftime(commence_time - interval 5 hour, '%I:%M %p') || ' ET', '') as tip_et, total, home_spread, "
    "abs(home_spread) as spread_abs, case when home_spread is null then '' when abs(home_spread) < 0.05 then "
    "{h} || ' PK' else {h} || case when home_spread > 0 then ' +' else ' ' end || printf('%.1f', home_spread) end as spread_text "
    "from o_events".format(
        h="case when home_team = '' then 'HOME' else upper(substr(split_part(home_team, ' ', 2), 1, 3)) end"
    ),
)
def event_lines(spark, sf):
    return context.event_lines(b.slate(spark, sf), b.event_context(spark, sf))


@register(
    "injury_merge",
    "snapshot_id player_key player status note date_update team source listed_officially",
    "select snapshot_id, player_key, player, status, note, date_update, team, source, listed_officially from o_inj",
)
def injury_merge(spark, sf):
    return context.merged_injuries(b.injuries(spark, sf))


@register(
    "injury_index",
    "snapshot_id player_key status date_update source",
    "select snapshot_id, player_key, status, date_update, source from (select *, "
    "regexp_replace(lower(trim(player)), '[^a-z0-9]+', '', 'g') as player_key, row_number() over (partition by snapshot_id, "
    "regexp_replace(lower(trim(player)), '[^a-z0-9]+', '', 'g') order by case status when 'out_for_season' then 6 "
    "when 'out' then 5 when 'doubtful' then 4 when 'questionable' then 3 when 'probable' then 2 when 'available' then 1 "
    "when 'day_to_day' then 1 else 0 end desc, date_update desc, row_order desc) as rn from fx_injuries) where rn = 1",
)
def injury_index(spark, sf):
    return context.gravest_injuries(b.injuries(spark, sf))


@register(
    "team_injury_counts",
    "snapshot_id team out out_for_season doubtful questionable",
    "select snapshot_id, team, out, out_for_season, doubtful, questionable from o_team_counts",
)
def team_injury_counts(spark, sf):
    return context.team_injury_counts(context.merged_injuries(b.injuries(spark, sf)))


@register(
    "key_injuries",
    "snapshot_id position player team status note date_update",
    "select * from (select i.snapshot_id, cast(row_number() over (partition by i.snapshot_id order by case i.status "
    "when 'out_for_season' then 5 when 'out' then 4 when 'doubtful' then 3 else 2 end desc, i.date_update, i.player) as integer) "
    "as position, i.player, i.team, i.status, i.note, i.date_update from o_inj i where i.status in "
    "('out_for_season', 'out', 'doubtful', 'questionable') and exists (select 1 from fx_context c where "
    "c.snapshot_id = i.snapshot_id and i.team in (c.home_team, c.away_team))) where position <= 20",
)
def key_injuries(spark, sf):
    return context.key_injuries(b.injuries(spark, sf), b.event_context(spark, sf))


@register(
    "team_rosters",
    "snapshot_id team active inactive members",
    "select snapshot_id, team, coalesce(string_agg(player_key, ',' order by player_key) filter (active), '') as active, "
    "coalesce(string_agg(player_key, ',' order by player_key) filter (inactive), '') as inactive, "
    "string_agg(player_key, ',' order by player_key) as members from o_roster group by 1, 2",
)
def team_rosters(spark, sf):
    return context.team_rosters(b.roster(spark, sf))


@register(
    "roster_status",
    "snapshot_id event_id player roster_status injury_status injury_note player_team opponent_team",
    "select snapshot_id, event_id, player, roster_status, injury_status, injury_note, player_team, opponent_team from o_pctx",
)
def roster_status(spark, sf):
    i = inputs(spark, sf)
    return context.player_context(i.quotes, i.event_context, i.roster, i.injuries)


@register(
    "teammate_counts",
    "snapshot_id event_id player teammate_out_count teammate_doubtful_count teammate_questionable_count "
    "opponent_out_count opponent_doubtful_count",
    "select snapshot_id, event_id, player, t_out as teammate_out_count, t_doubtful as teammate_doubtful_count, "
    "t_questionable as teammate_questionable_count, o_out as opponent_out_count, o_doubtful as opponent_doubtful_count from o_pctx",
)
def teammate_counts(spark, sf):
    i = inputs(spark, sf)
    return context.player_context(i.quotes, i.event_context, i.roster, i.injuries)


@register(
    "missing_event_mappings",
    "snapshot_id event_id",
    "select distinct q.snapshot_id, q.event_id from fx_quotes q where not exists (select 1 from fx_context c "
    "where c.snapshot_id = q.snapshot_id and c.event_id = q.event_id)",
)
def missing_event_mappings(spark, sf):
    return context.missing_event_mappings(b.quotes(spark, sf), b.event_context(spark, sf))


@register(
    "source_health",
    "snapshot_id official_rows secondary_rows official_ready secondary_ready",
    "select snapshot_id, official_rows, secondary_rows, official_rows > 0 and cast(right(snapshot_id, 2) as integer) % 4 <> 0 as official_ready, "
    "secondary_rows > 0 and cast(right(snapshot_id, 2) as integer) % 3 <> 0 as secondary_ready from o_health",
)
def source_health(spark, sf):
    """Every fourth official report fails to parse, every third secondary feed is not read."""
    injuries = b.injuries(spark, sf)
    day = F.expr("int(right(snapshot_id, 2))")
    official = F.col("source") == "official"
    feeds = injuries.select("snapshot_id", "source").distinct().select(
        "snapshot_id", "source",
        F.when(~official & (day % 3 == 0), "error").otherwise("ok").alias("status"),
        F.when(official & (day % 4 == 0), "error").otherwise("").alias("parse_status"),
    )
    return context.source_health(injuries, feeds)


@register(
    "context_adjustment",
    f"{LINE} context_adjustment baseline_minutes projected_minutes minutes_delta usage_delta market_delta "
    "minutes_p50 minutes_band minutes_prob_delta_over",
    f"select {LINE_SQL}, {r6('context_adjustment=adjustment baseline_minutes=base_min projected_minutes=proj_min minutes_delta=min_delta usage_delta market_delta minutes_p50=mp50 minutes_band minutes_prob_delta_over=min_shift_raw')} from o_adj",
)
def context_adjustment(spark, sf):
    return lines_stage(spark, sf)


CAND = f"strategy_id {LINE}"
CAND_SQL = f"strategy_id, {LINE_SQL}"


@register(
    "strategy_candidates",
    f"{CAND} tier recommended_side selected_price selected_book baseline_used line_source reference_line_method "
    "baseline_books_used_count book_pair_count p_over_fair hold model_p_hit fair_p_hit p_hit_low p_hit_high ev_over ev_under "
    "best_ev best_kelly ev_low ev_high quality_score uncertainty_band eligible reason",
    f"select {CAND_SQL}, tier, recommended_side, cast(price as integer) as selected_price, book as selected_book, "
    "used as baseline_used, line_source, ref_method as reference_line_method, cast(n_base_books as integer) as baseline_books_used_count, "
    f"cast(n_pairs as integer) as book_pair_count, {r6('p_over_fair=fair hold model_p_hit=p_hit fair_p_hit=p_fair p_hit_low p_hit_high ev_over ev_under best_ev best_kelly ev_low ev_high quality_score=quality uncertainty_band=band')}, "
    "eligible, reason from o_cand",
)
def strategy_candidates(spark, sf):
    """All twenty recipes over every line in one job."""
    return candidates_stage(spark, sf)


@register(
    "candidate_gates",
    "snapshot_id strategy_id reason candidates pre_bet_ready_count",
    "select snapshot_id, strategy_id, reason, count(*) as candidates, count(*) filter (pre_bet_ready) as pre_bet_ready_count "
    "from o_cand group by 1, 2, 3",
)
def candidate_gates(spark, sf):
    return candidates_stage(spark, sf).groupBy("snapshot_id", "strategy_id", "reason").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("pre_bet_ready").alias("pre_bet_ready_count"),
    )


@register(
    "candidate_targets",
    f"{CAND} target_roi play_to_decimal play_to_american breakeven_decimal breakeven_american score_base score",
    f"select {CAND_SQL}, target_roi, play_to_decimal, play_to_american, breakeven_decimal, breakeven_american, "
    f"{r6('score_base score')} from o_cand",
)
def candidate_targets(spark, sf):
    return candidates_stage(spark, sf)


@register(
    "candidate_calibration",
    f"{CAND} calibration_source calibration_sample_size calibration_confidence calibration_delta p_hit_calibrated "
    "p_hit_low_calibrated ev_calibrated ev_low_calibrated historical_prior_delta historical_prior_sample_size",
    f"select {CAND_SQL}, cal_source as calibration_source, cal_n as calibration_sample_size, "
    f"{r6('calibration_confidence=cal_conf calibration_delta=cal_delta p_hit_calibrated=p_cal p_hit_low_calibrated=p_low_cal ev_calibrated ev_low_calibrated historical_prior_delta=prior_delta')}, "
    "prior_n as historical_prior_sample_size from o_cand",
)
def candidate_calibration(spark, sf):
    return candidates_stage(spark, sf)


@register(
    "portfolio_selection",
    f"{CAND} recommended_side portfolio_selected portfolio_rank portfolio_reason",
    f"select {CAND_SQL}, recommended_side, portfolio_selected, portfolio_rank, portfolio_reason from o_port",
)
def portfolio_selection(spark, sf):
    return portfolio_stage(spark, sf)


@register(
    "odds_health",
    "snapshot_id strategy_id status odds_stale latest_quote oldest_quote age_latest_min age_oldest_min",
    f"select snapshot_id, strategy_id, status, odds_stale, {ts('latest', 'latest_quote')}, {ts('oldest', 'oldest_quote')}, "
    "round(age_latest, 2) as age_latest_min, round(age_oldest, 2) as age_oldest_min from o_odds_health",
)
def odds_health(spark, sf):
    clock = pricing.snapshot_clock(b.quotes(spark, sf))
    return candidates.odds_health(raw_candidates_stage(spark, sf), clock)


@register(
    "health_gated_candidates", "snapshot_id strategy_id health_gates eligible reason rows",
    "select c.snapshot_id, c.strategy_id, gates as health_gates, eligible, reason, count(*) as rows from o_cand c "
    "join o_gates g on g.snapshot_id = c.snapshot_id and g.strategy_id = c.strategy_id group by all",
)
def health_gated_candidates(spark, sf):
    keys = ["snapshot_id", "strategy_id", "health_gates", "eligible", "reason"]
    return candidates_stage(spark, sf).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
