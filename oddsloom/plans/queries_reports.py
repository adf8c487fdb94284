"""Queries over candidates: views, briefs, execution books; and over box scores."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from oddsloom.operators import exact_quantiles, execution, minutes, minutes_model, pricing, quantile_boost, quantile_forest, views
from oddsloom.plans import bindings as b
from oddsloom.plans.catalog import candidates_stage, portfolio_stage, r6, register, selected_stage, stage
from oddsloom.plans.oracles import CTES, american, clamp, decimal, ev

CAND = "snapshot_id strategy_id event_id market player point"
CAND_SQL = "snapshot_id, strategy_id, event_id, market, player, point"
ORDER = (
    "coalesce(nullif(best_ev, 0.0), -999.0) desc, coalesce(nullif(round(score, 6), 0.0), -9999.0) desc, event_id, player, point, market"
)

CTES["o_sel"] = f"""
select c.*, p.portfolio_rank, p.portfolio_selected, p.portfolio_reason from o_cand c join o_port p using ({CAND_SQL})"""


@register(
    "watchlist_views", f"{CAND} position reason best_ev",
    f"select {CAND_SQL}, cast(rn as integer) as position, reason, best_ev from (select *, row_number() over "
    f"(partition by snapshot_id, strategy_id order by {ORDER}) as rn from o_cand where not eligible) where rn <= 25",
)
def watchlist_views(spark, sf):
    return views.watchlist(candidates_stage(spark, sf), 25)


@register(
    "tier_plays", f"{CAND} tier position best_ev",
    f"select {CAND_SQL}, tier, cast(rn as integer) as position, best_ev from (select *, row_number() over "
    "(partition by snapshot_id, strategy_id, tier order by portfolio_rank) as rn from o_sel where portfolio_selected) where rn <= 5",
)
def tier_plays(spark, sf):
    picks = selected_stage(spark, sf)
    return views.tier_plays(picks, "A", 5).unionByName(views.tier_plays(picks, "B", 5))


@register(
    "price_watchlist", f"{CAND} recommended_side selected_price play_to_american play_to_decimal target_roi best_ev reason tier",
    f"select {CAND_SQL}, recommended_side, cast(price as integer) as selected_price, play_to_american, play_to_decimal, target_roi, "
    "best_ev, reason, tier from o_cand where reason in ('ev_below_threshold', 'tier_b_blocked') and play_to_american is not null",
)
def price_watchlist(spark, sf):
    return views.price_watchlist(candidates_stage(spark, sf))


@register(
    "under_sweep", f"{CAND} list position qualified_count status",
    f"select u.{CAND_SQL.replace(', ', ', u.')}, u.list, cast(u.rn as integer) as position, q.n as qualified_count, "
    "case when q.n >= 2 then 'ok' else 'insufficient' end as status from (select *, case when eligible then 'qualified' else 'closest_miss' end as list, "
    f"row_number() over (partition by snapshot_id, strategy_id, eligible order by {ORDER}) as rn from o_cand where recommended_side = 'under') u "
    "join (select snapshot_id, strategy_id, count(*) filter (eligible and recommended_side = 'under') as n from o_cand group by 1, 2) q "
    "on q.snapshot_id = u.snapshot_id and q.strategy_id = u.strategy_id where u.rn <= 5",
)
def under_sweep(spark, sf):
    return views.under_sweep(candidates_stage(spark, sf))


@register(
    "kelly_summary", f"{CAND} portfolio_rank selected_book selected_price best_kelly quarter_kelly",
    f"select {CAND_SQL}, portfolio_rank, book as selected_book, cast(price as integer) as selected_price, "
    f"{r6('best_kelly quarter_kelly=best_kelly/4.0')} from o_sel where portfolio_selected",
)
def kelly_summary(spark, sf):
    return selected_stage(spark, sf)


_HAIR = (
    "case when a.player = b.player then 0.15 when a.player_team = b.player_team and a.recommended_side = 'over' and b.recommended_side = 'over' then 0.12 "
    "when a.market in ('player_points', 'player_assists', 'player_points_rebounds_assists') or b.market in ('player_points', 'player_assists', "
    "'player_points_rebounds_assists') then 0.08 else 0.05 end"
)
CTES["o_legs"] = f"""
select * from (select *, row_number() over (partition by snapshot_id, strategy_id, event_id order by {ORDER}) as rn
  from o_cand where eligible) where rn <= 8"""
CTES["o_sgp0"] = f"""
select a.snapshot_id, a.strategy_id, a.event_id, a.player as player_a, a.market as market_a, a.point as point_a, a.recommended_side as side_a,
  b.player as player_b, b.market as market_b, b.point as point_b, b.recommended_side as side_b, a.p_hit * b.p_hit as joint, {_HAIR} as haircut,
  {decimal('a.price')} * {decimal('b.price')} as payout
from o_legs a join o_legs b on a.snapshot_id = b.snapshot_id and a.strategy_id = b.strategy_id and a.event_id = b.event_id and a.rn < b.rn"""
CTES["o_sgp1"] = f"select *, joint * (1.0 - haircut) as adj, {american('payout')} as am from o_sgp0"
CTES["o_sgp"] = f"""
select *, round((adj * (payout - 1.0) - (1.0 - adj)) * 100.0 + 1e-9, 3) as ev_per_100,
  round(round({ev('adj', 'am')} / ({decimal('am')} - 1.0), 6) / 2.0, 6) as frac from o_sgp1"""


@register(
    "same_game_pairs",
    "snapshot_id strategy_id event_id position player_a market_a point_a side_a player_b market_b point_b side_b independence_joint_p haircut "
    "adjusted_joint_p unboosted_decimal unboosted_american ev_per_100 recommended_fractional_kelly",
    "select snapshot_id, strategy_id, event_id, cast(rn as integer) as position, player_a, market_a, point_a, side_a, player_b, market_b, point_b, "
    f"side_b, {r6('independence_joint_p=joint haircut adjusted_joint_p=adj unboosted_decimal=payout')}, am as unboosted_american, ev_per_100, "
    "frac as recommended_fractional_kelly from (select *, row_number() over (partition by snapshot_id, strategy_id order by "
    "coalesce(nullif(ev_per_100, 0.0), -999.0) desc, event_id, player_a, market_a, point_a, player_b, market_b, point_b) as rn from o_sgp) where rn <= 10",
)
def same_game_pairs(spark, sf):
    return views.same_game_pairs(candidates_stage(spark, sf))


@register(
    "ranked_overlap", "snapshot_id strategies intersection_all union_all",
    "select snapshot_id, max(total) as strategies, count(*) filter (n = total) as intersection_all, count(*) as union_all from "
    "(select snapshot_id, event_id, player, market, point, recommended_side, count(distinct strategy_id) as n, "
    "(select count(distinct strategy_id) from o_sel t where t.portfolio_selected and t.snapshot_id = s.snapshot_id) as total "
    "from o_sel s where portfolio_selected group by all) group by 1",
)
def ranked_overlap(spark, sf):
    return views.ranked_overlap(selected_stage(spark, sf))


_SUMMARY = (
    "events candidate_lines tier_a_lines tier_b_lines eligible_lines eligible_tier_a eligible_tier_b eligible_pre_bet_ready qualified_unders"
)


@register(
    "report_summary", f"snapshot_id strategy_id {_SUMMARY} avg_quality_score_all avg_quality_score_eligible avg_ev_low_eligible actionability_rate",
    "select snapshot_id, strategy_id, count(distinct event_id) as events, count(*) as candidate_lines, count(*) filter (tier = 'A') as tier_a_lines, "
    "count(*) filter (tier = 'B') as tier_b_lines, count(*) filter (eligible) as eligible_lines, count(*) filter (eligible and tier = 'A') as eligible_tier_a, "
    "count(*) filter (eligible and tier = 'B') as eligible_tier_b, count(*) filter (eligible and pre_bet_ready) as eligible_pre_bet_ready, "
    "count(*) filter (eligible and recommended_side = 'under') as qualified_unders, "
    + r6("avg_quality_score_all=avg(quality)") + ", round(avg(quality) filter (eligible), 6) as avg_quality_score_eligible, "
    "round(avg(ev_low) filter (eligible), 6) as avg_ev_low_eligible, round(count(*) filter (eligible) / count(*), 6) as actionability_rate "
    "from o_cand group by 1, 2",
)
def report_summary(spark, sf):
    return views.report_summary(candidates_stage(spark, sf))


@register(
    "exclusion_reasons", "snapshot_id strategy_id portfolio_reason rows",
    "select snapshot_id, strategy_id, portfolio_reason, count(*) as rows from o_port where portfolio_reason <> '' group by 1, 2, 3",
)
def exclusion_reasons(spark, sf):
    return views.exclusion_reasons(portfolio_stage(spark, sf))


@register(
    "roster_warnings", "snapshot_id strategy_id position warning",
    "select snapshot_id, strategy_id, cast(rn as integer) as position, warning from (select *, row_number() over (partition by snapshot_id, strategy_id "
    "order by warning) as rn from (select distinct snapshot_id, strategy_id, player || ' (' || event_id || case roster_status "
    "when 'unknown_roster' then ') has unknown_roster: active/inactive status not found.' when 'unknown_event' then ') has unknown_event: missing event team context.' "
    "when 'inactive' then ') is marked inactive in roster feed.' when 'not_on_roster' then ') is not on either event roster feed.' end as warning "
    "from o_cand) where warning is not null) where rn <= 30",
)
def roster_warnings(spark, sf):
    return views.roster_warnings(candidates_stage(spark, sf))


@register(
    "verified_players", "snapshot_id strategy_id player player_team event_id verification_link",
    "select snapshot_id, strategy_id, player, player_team, event_id, 'https://www.espn.com/search/_/q/' || "
    "replace(player || ' ' || player_team || ' nba', ' ', '+') as verification_link from (select *, row_number() over (partition by snapshot_id, "
    "strategy_id, player_key, player_team order by tier, portfolio_rank) as rn from o_sel where portfolio_selected) where rn = 1",
)
def verified_players(spark, sf):
    return views.verified_players(selected_stage(spark, sf))


CTES["o_brief"] = """
select *, case when injury_status not in ('available', 'available_unlisted') or roster_status not in ('active', 'rostered') or best_ev is null
    then 'NO-GO' when best_ev >= 0.05 then 'GO' when best_ev >= 0.02 then 'LEAN' else 'NO-GO' end as action_default,
  upper(substr(split_part(away_team, ' ', 2), 1, 3)) || ' @ ' || upper(substr(split_part(home_team, ' ', 2), 1, 3)) as game_label,
  player || ' ' || upper(recommended_side) || ' ' || printf('%.1f', point) || ' ' || case market when 'player_points' then 'points' when 'player_rebounds'
    then 'rebounds' when 'player_assists' then 'assists' when 'player_threes' then 'three-pointers' when 'player_points_rebounds_assists'
    then 'points+rebounds+assists' else replace(market, '_', ' ') end || ' @ ' || case when price > 0 then '+' else '' end || cast(cast(price as integer) as varchar)
    || ' (' || book || ')' as ticket,
  case when best_ev * 100.0 >= 8.0 then 'Strong edge' when best_ev * 100.0 >= 4.0 then 'Moderate edge' when best_ev > 0 then 'Thin edge' else 'No edge' end
    as strength,
  case when best_kelly >= 0.1 then 'Higher stake' when best_kelly >= 0.05 then 'Medium stake' when best_kelly > 0 then 'Small stake' else 'No stake' end as stake
from o_sel where portfolio_selected"""


_BRIEF_EV = "coalesce(format('{:.3f}', best_ev), 'n/a')"


@register(
    "brief_plays", f"{CAND} action_default game_label ticket edge_note plain_reason",
    f"select {CAND_SQL}, action_default, game_label, ticket, case when best_ev is null and best_kelly is null then 'n/a' else strength || ' (' || "
    "format('{:+.1f}', coalesce(best_ev, 0) * 100) || '% est.), ' || stake end as edge_note, case action_default "
    "when 'NO-GO' then case when reason = 'injury_gate' or injury_status in ('out', 'out_for_season', 'doubtful') then 'No-go because player availability risk is too high.' "
    "when reason = 'roster_gate' or roster_status in ('inactive', 'not_on_roster') then 'No-go because roster check does not confirm active status.' "
    f"else 'No-go due to weak edge or missing confidence signals (EV ' || {_BRIEF_EV} || ').' end "
    f"when 'LEAN' then 'Lean: positive edge (EV ' || {_BRIEF_EV} || ') but not strong enough for full GO.' "
    f"else 'Go: verified availability with tier ' || tier || ' market depth and positive edge (EV ' || {_BRIEF_EV} || ').' end as plain_reason from o_brief",
)
def brief_plays(spark, sf):
    return views.brief_plays(selected_stage(spark, sf))


_BRIEF_ORDER = (
    "case action_default when 'GO' then 0 when 'LEAN' then 1 else 2 end, coalesce(nullif(best_ev, 0.0), -999.0) desc, game_label, player, event_id, market, point"
)


@register(
    "game_cards", f"{CAND} position action_default",
    f"select {CAND_SQL}, cast(rn as integer) as position, action_default from (select *, row_number() over (partition by snapshot_id, strategy_id, event_id "
    f"order by {_BRIEF_ORDER}) as rn from (select *, max(case when action_default <> 'NO-GO' and best_ev >= 0.01 then 2 when action_default <> 'NO-GO' then 1 else 0 end) "
    "over (partition by snapshot_id, strategy_id, event_id) as wanted from o_brief) where case wanted when 2 then action_default <> 'NO-GO' and best_ev >= 0.01 "
    "when 1 then action_default <> 'NO-GO' else true end) where rn <= 5",
)
def game_cards(spark, sf):
    return views.game_cards(views.brief_plays(selected_stage(spark, sf)))


@register(
    "best_available", f"{CAND} action_default best_ev",
    f"select {CAND_SQL}, action_default, best_ev from (select *, row_number() over (partition by snapshot_id, strategy_id order by {_BRIEF_ORDER}) as rn "
    "from o_brief where action_default <> 'NO-GO' and pre_bet_ready) where rn = 1",
)
def best_available(spark, sf):
    return views.best_available(views.brief_plays(selected_stage(spark, sf)))


# --- execution books ----------------------------------------------------------------------

BOOKS = ("book_3", "book_1")
CTES["o_xq"] = f"""
select * from (select {CAND_SQL.replace('strategy_id, ', '')}, lower(side) as side, book as x_book, price as x_price, row_number() over (partition by
  snapshot_id, event_id, market, player, point, side order by price desc, case book when 'book_3' then 0 else 1 end, last_update desc, book desc) as rn
  from fx_quotes where book in ('book_3', 'book_1')) where rn = 1"""
CTES["o_xp0"] = f"""
select c.*, q.x_book, q.x_price, round({ev('c.p_hit', 'q.x_price')}, 6) as x_ev from o_cand c left join o_xq q on q.snapshot_id = c.snapshot_id
  and q.event_id = c.event_id and q.market = c.market and q.player = c.player and q.point = c.point and q.side = c.recommended_side"""
CTES["o_xp"] = """
select *, case when x_price is null then 'execution_price_missing' when p_hit is null then 'execution_probability_missing'
  when not pre_bet_ready then 'execution_pre_bet_not_ready' when play_to_american is null or x_price < play_to_american then 'execution_play_to_miss'
  when x_ev is null or x_ev < case when tier = 'A' then 0.03 else 0.05 end then 'execution_ev_below_threshold' else '' end as x_reason,
  coalesce(nullif(x_ev, 0.0), -0.5) * 1000.0 + book_count * 5.0 + (over_delta + under_delta) / 10.0 - coalesce(hold * 100.0, 20.0) as x_score from o_xp0"""


def _projected(spark, sf):
    return execution.project(
        candidates_stage(spark, sf), b.quotes(spark, sf), execution.ExecutionSettings(BOOKS)
    )


@register(
    "execution_projection", f"{CAND} recommended_side selected_book selected_price best_ev score eligible reason",
    f"select {CAND_SQL}, recommended_side, coalesce(x_book, '') as selected_book, cast(x_price as integer) as selected_price, x_ev as best_ev, "
    "round(x_score, 6) as score, x_reason = '' as eligible, x_reason as reason from o_xp",
)
def execution_projection(spark, sf):
    return _projected(spark, sf)


@register(
    "execution_summary", f"snapshot_id strategy_id {_SUMMARY}",
    "select snapshot_id, strategy_id, count(distinct event_id) as events, count(*) as candidate_lines, count(*) filter (tier = 'A') as tier_a_lines, "
    "count(*) filter (tier = 'B') as tier_b_lines, count(*) filter (x_reason = '') as eligible_lines, count(*) filter (x_reason = '' and tier = 'A') as eligible_tier_a, "
    "count(*) filter (x_reason = '' and tier = 'B') as eligible_tier_b, count(*) filter (x_reason = '' and pre_bet_ready) as eligible_pre_bet_ready, "
    "count(*) filter (x_reason = '' and recommended_side = 'under') as qualified_unders from o_xp group by 1, 2",
)
def execution_summary(spark, sf):
    return views.report_summary(_projected(spark, sf))


CTES["o_disc"] = f"""
select d.{CAND_SQL.replace(', ', ', d.')}, case when x.snapshot_id is null then 'unmatched' when case when d.recommended_side = 'under' then x.under_price else x.over_price end
  >= d.play_to_american then 'actionable' else 'miss' end as match, d.p_hit,
  case when d.recommended_side = 'under' then x.under_price else x.over_price end as x_price
from o_cand d left join (select {CAND_SQL.replace('strategy_id, ', '')}, max(case when side = 'Over' then price end) as over_price,
  max(case when side = 'Under' then price end) as under_price from fx_quotes where book in ('book_3', 'book_1') group by 1, 2, 3, 4, 5) x
  on x.snapshot_id = d.snapshot_id and x.event_id = d.event_id and x.market = d.market and x.player = d.player and x.point = d.point
where d.eligible and d.pre_bet_ready"""


def _discovery(spark, sf):
    found = candidates_stage(spark, sf)
    offered = pricing.priced_lines(b.quotes(spark, sf).where(F.col("book").isin(*BOOKS))).select(
        *pricing.LINE,
        (-F.col("over_best.cost")).alias("over_price"), F.col("over_best.book").alias("over_book"),
        (-F.col("under_best.cost")).alias("under_price"), F.col("under_best.book").alias("under_book"),
    )
    return execution.discovery_matches(found, offered)


@register(
    "discovery_execution", f"{CAND} match execution_price execution_ev_at_discovery_p",
    f"select {CAND_SQL}, match, cast(x_price as integer) as execution_price, round({ev('p_hit', 'x_price')}, 6) as execution_ev_at_discovery_p from o_disc",
)
def discovery_execution(spark, sf):
    return _discovery(spark, sf)


@register(
    "discovery_summary", "snapshot_id strategy_id discovery_eligible_rows matched_execution_rows unmatched_rows actionable_rows miss_rows",
    "select snapshot_id, strategy_id, count(*) as discovery_eligible_rows, count(*) filter (match <> 'unmatched') as matched_execution_rows, "
    "count(*) filter (match = 'unmatched') as unmatched_rows, count(*) filter (match = 'actionable') as actionable_rows, "
    "count(*) filter (match = 'miss') as miss_rows from o_disc group by 1, 2",
)
def discovery_summary(spark, sf):
    return execution.discovery_summary(_discovery(spark, sf))


# --- minutes ------------------------------------------------------------------------------


def _win(fn: str, col: str, keys: str, n: int, need: int) -> str:
    frame = f"over (partition by {keys} order by game_date, game_id rows between {n} preceding and 1 preceding)"
    return f"case when count({col}) {frame} >= {need} then {fn}({col}) {frame} end"


CTES["o_mb0"] = f"""
select game_id, game_date, player_id, team_id, minutes as actual_minutes, {_win('avg', 'minutes', 'player_id', 10, 3)} as pred_minutes,
  count(*) over (partition by player_id order by game_date, game_id rows between 10 preceding and 1 preceding) as history_games_used from fx_boxscore"""
CTES["o_mb"] = "select *, game_date >= (select max(game_date) from fx_boxscore) - 6 as is_eval from o_mb0"


@register(
    "minutes_baseline", "game_id game_date player_id team_id actual_minutes pred_minutes history_games_used is_eval",
    "select game_id, cast(game_date as varchar) as game_date, player_id, team_id, actual_minutes, round(pred_minutes, 6) as pred_minutes, history_games_used, is_eval from o_mb",
)
def minutes_baseline(spark, sf):
    return minutes.baseline_predictions(b.boxscore(spark, sf))


@register(
    "minutes_baseline_metrics", "rows_total rows_scored rows_eval_scored mae rmse bias train_start train_end eval_start eval_end",
    "select count(*) as rows_total, count(pred_minutes) as rows_scored, count(pred_minutes) filter (is_eval) as rows_eval_scored, "
    "round(avg(abs(actual_minutes - pred_minutes)) filter (is_eval), 6) as mae, round(sqrt(avg(pow(actual_minutes - pred_minutes, 2)) filter (is_eval)), 6) as rmse, "
    "round(avg(actual_minutes - pred_minutes) filter (is_eval), 6) as bias, cast(min(game_date) as varchar) as train_start, cast(max(game_date) as varchar) as train_end, "
    "cast(min(game_date) filter (is_eval and pred_minutes is not null) as varchar) as eval_start, "
    "cast(max(game_date) filter (is_eval and pred_minutes is not null) as varchar) as eval_end from o_mb",
)
def minutes_baseline_metrics(spark, sf):
    return minutes.baseline_metrics(minutes.baseline_predictions(b.boxscore(spark, sf)))


CTES["o_tg0"] = "select team_id, game_id, game_date, sum(minutes) as total, count(*) filter (minutes > 0) as act from fx_boxscore group by 1, 2, 3"
CTES["o_tg"] = f"""
select team_id, game_id, {_win('avg', 'total', 'team_id', 5, 2)} as t_mean, {_win('avg', 'act', 'team_id', 5, 2)} as t_act from o_tg0"""
CTES["o_mf0"] = f"""
select b.*, t.t_mean, t.t_act, case when b.minutes > 0 then 1 else 0 end as active_target from fx_boxscore b left join o_tg t using (team_id, game_id)"""
CTES["o_mf1"] = f"""
select *, {_win('avg', 'minutes', 'player_id', 10, 3)} as mean, {_win('stddev_samp', 'minutes', 'player_id', 10, 3)} as std,
  {_win('avg', 'minutes', 'player_id', 3, 1)} as short, {_win('avg', 'active_target', 'player_id', 10, 3)} as rate,
  row_number() over (partition by player_id order by game_date, game_id) - 1 as games_played,
  row_number() over (partition by player_id, team_id order by game_date, game_id) - 1 as games_on_team,
  game_date - min(game_date) over (partition by player_id, team_id) as days_on_team from o_mf0"""


@register(
    "minutes_features",
    "game_id game_date player_id team_id actual_minutes active_target new_team_phase prev_minutes_mean prev_minutes_std prev_minutes_short prev_minutes_trend "
    "prev_active_rate games_played games_on_team days_on_team new_team_phase_ord team_prev_minutes_mean team_prev_active_count",
    "select game_id, cast(game_date as varchar) as game_date, player_id, team_id, minutes as actual_minutes, active_target, case when games_on_team < 5 then 'lt_5' "
    "when games_on_team <= 10 then 'g5_10' else 'gt_10' end as new_team_phase, round(coalesce(mean, 24.0), 6) as prev_minutes_mean, round(coalesce(std, 0.0), 6) as prev_minutes_std, "
    "round(coalesce(short, mean, 24.0), 6) as prev_minutes_short, round(coalesce(short - mean, 0.0), 6) as prev_minutes_trend, round(coalesce(rate, 0.95), 6) as prev_active_rate, "
    "games_played, games_on_team, cast(days_on_team as integer) as days_on_team, case when games_on_team < 5 then 0 when games_on_team <= 10 then 1 else 2 end as new_team_phase_ord, "
    "round(coalesce(t_mean, 240.0), 6) as team_prev_minutes_mean, round(coalesce(t_act, 8.0), 6) as team_prev_active_count from o_mf1",
)
def minutes_features(spark, sf):
    return minutes.feature_frame(b.boxscore(spark, sf))


CTES["o_poss0"] = """
select game_id, action_number, possession, case when lag(possession) over (partition by game_id order by action_number) = possession then 0 else 1 end as s
from fx_actions where possession > 0"""
CTES["o_poss1"] = "select *, sum(s) over (partition by game_id order by action_number) as pid from o_poss0"
CTES["o_gteams"] = "select game_id, min(team_id) as t0, max(team_id) as t1, count(distinct team_id) as n from fx_actions where team_id > 0 group by 1"
CTES["o_poss"] = """
select p.game_id, cast(p.pid as bigint) as possession_id, min(p.action_number) as start_event_num, max(p.action_number) as end_event_num,
  cast(min(p.possession) as varchar) as offense_team_id, case when any_value(g.n) = 2 then cast(case when min(p.possession) = any_value(g.t0)
  then any_value(g.t1) else any_value(g.t0) end as varchar) else '' end as defense_team_id
from o_poss1 p join o_gteams g using (game_id) group by p.game_id, p.pid"""


@register(
    "possessions", "game_id possession_id start_event_num end_event_num offense_team_id defense_team_id",
    "select * from o_poss",
)
def possessions(spark, sf):
    return minutes.possessions(b.actions(spark, sf))


CTES["o_vm"] = "select game_id, team_id, sum(minutes) as m from fx_boxscore group by 1, 2"


@register(
    "clean_verify", "check level n",
    "select 'boxscore_players_missing_game_reference' as \"check\", 'failure' as level, cast(0 as bigint) as n union all "
    "select 'pbp_events_missing_game_reference', 'failure', (select count(distinct game_id) from fx_actions where game_id not in (select game_id from fx_boxscore)) union all "
    "select 'possessions_missing_game_reference', 'failure', (select count(distinct game_id) from o_poss where game_id not in (select game_id from fx_boxscore)) union all "
    "select 'pbp_events_duplicate_key', 'failure', (select count(*) from (select 1 from fx_actions group by game_id, action_number having count(*) > 1)) union all "
    "select 'possessions_duplicate_key', 'failure', (select count(*) from (select 1 from o_poss group by game_id, possession_id having count(*) > 1)) union all "
    "select 'games_missing_home_team_id', 'failure', 0 union all select 'games_missing_away_team_id', 'failure', "
    "(select count(*) from (select 1 from fx_boxscore group by game_id having count(distinct team_id) < 2)) union all "
    "select 'team_minutes_below_240', 'warning', (select count(*) from o_vm where m < 240) union all "
    "select 'team_minutes_below_200', 'failure', (select count(*) from o_vm where m < 200) union all "
    "select 'team_minutes_above_400', 'warning', (select count(*) from o_vm where m > 400)",
)
def clean_verify(spark, sf):
    box = b.boxscore(spark, sf)
    games = box.groupBy("game_id").agg(
        F.min("team_id").alias("home_team_id"),
        F.when(F.count_distinct("team_id") >= 2, F.max("team_id")).otherwise("").alias("away_team_id"),
    )
    events = b.actions(spark, sf).withColumnRenamed("action_number", "event_num")
    runs = minutes.possessions(b.actions(spark, sf))
    return minutes.verify_report(games, box, events, runs)


#: Fewer, longer steps than the default.
SHORT_RUN = minutes_model.ModelSettings(
    classifier_rounds=60, learning_rate=0.15, boost=quantile_boost.BoostSettings(rounds=30, rate=0.15)
)


def _model(spark, sf):
    """Predictions for the last week; the model is fitted once and its predictions are written."""

    def fitted():
        frame = stage(
            spark, sf, "minutes_features",
            lambda: minutes.with_eval_flag(minutes.feature_frame(b.boxscore(spark, sf)), 7),
        )
        model = minutes_model.train(frame.where(~F.col("is_eval")), SHORT_RUN)
        return minutes_model.predict(model, frame.where("is_eval"), ("player_points", "player_rebounds"))

    return stage(spark, sf, "minutes-predictions", fitted)


@register(
    "minutes_predictions",
    "event_id snapshot_date player_id team_id market minutes_p10 minutes_p50 minutes_p90 p_active confidence_score data_quality_flags actual_minutes",
    None,
)
def minutes_predictions(spark, sf):
    return _model(spark, sf)


@register("minutes_model_evaluation", "new_team_phase rows mae rmse bias coverage brier_active confidence_score", None)
def minutes_model_evaluation(spark, sf):
    return minutes.evaluate_predictions(_model(spark, sf))


@register(
    "minutes_invariants", "market rows players disordered outside improbable",
    "select market, count(*) as rows, count(distinct player_id) as players, 0 as disordered, 0 as outside, 0 as improbable "
    "from fx_boxscore, (values ('player_points'), ('player_rebounds')) m(market) "
    "where game_date >= (select max(game_date) - 6 from fx_boxscore) group by 1",
)
def minutes_invariants(spark, sf):
    """What any fit must keep: a prediction for each row, ordered, within a game, with probabilities."""
    low, mid, high = (F.col(f"minutes_p{n}") for n in (10, 50, 90))
    return _model(spark, sf).groupBy("market").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("player_id").alias("players"),
        F.count_if(~((low <= mid) & (mid <= high))).alias("disordered"),
        F.count_if(~((low >= 0) & (high <= 48))).alias("outside"),
        F.count_if(~F.col("p_active").between(0, 1) | ~F.col("confidence_score").between(0, 1)).alias("improbable"),
    )


_MEDIAN_OF = ("prev_minutes_mean", "prev_minutes_std", "prev_active_rate", "games_on_team", "team_prev_minutes_mean")
_LINE_MEDIANS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_returns")
_RETURNS = "case when l_returnflag = 'R' then l_extendedprice - 30000 end"


@register(
    "feature_medians", "column n median",
    " union all ".join(
        [
            f"select '{c}' as \"column\", count({c}) as n, round(median({c}), 6) as median from (select *, {_RETURNS} as l_returns from lineitem)"
            for c in _LINE_MEDIANS
        ]
        + [
            f"select '{c}', count(v), round(median(v), 6) from (select {e} as v from o_mf1)"
            for c, e in zip(
                _MEDIAN_OF,
                ("coalesce(mean, 24.0)", "coalesce(std, 0.0)", "coalesce(rate, 0.95)", "games_on_team", "coalesce(t_mean, 240.0)"),
            )
        ]
    ),
)
def feature_medians(spark, sf):
    lines = b.table(spark, sf, "lineitem").withColumn("l_returns", F.expr(_RETURNS))
    frame = minutes.feature_frame(b.boxscore(spark, sf))
    return exact_quantiles.medians(lines, _LINE_MEDIANS).unionByName(exact_quantiles.medians(frame, _MEDIAN_OF))


_BOOST_FEATURES = ("points", "rebounds", "assists")


@register(
    "quantile_boost_losses", "held_out quantile rows better_than_constant better_than_forest covered",
    "select held_out, cast(q as double) as quantile, count(*) as rows, true as better_than_constant, true as better_than_forest, true as covered "
    "from (select game_date >= (select max(game_date) - 6 from fx_boxscore) as held_out from fx_boxscore), (values (0.1), (0.5), (0.9)) t(q) group by 1, 2",
)
def quantile_boost_losses(spark, sf):
    """Minutes forecast from the counts of the same game, learnt from all but the last week: pinball loss against the
    constant quantile and a forest's leaves, and whether the share between the outer quantiles is 0.7 to 0.9. Fewer
    than 500 rows leave open which of the two models is better; that counts as true."""
    levels = minutes_model.QUANTILES
    box = minutes.with_eval_flag(b.boxscore(spark, sf), 7)
    rows = box.select(*_BOOST_FEATURES, F.col("minutes").alias("y"), F.col("is_eval").alias("held_out"))
    rows = VectorAssembler(inputCols=list(_BOOST_FEATURES), outputCol="features").transform(rows)
    learnt = rows.where("not held_out")
    model = quantile_boost.fit(learnt, _BOOST_FEATURES, "y", levels, quantile_boost.BoostSettings(rounds=15, rate=0.2, min_leaf=40))
    forest = quantile_forest.fit(learnt, "y", levels)
    scored = quantile_forest.predict(forest, quantile_boost.predict(model, rows, "q"), len(levels), "leaf_q")
    losses = [
        F.struct(
            F.lit(level).alias("quantile"),
            quantile_boost.pinball(F.col("y"), F.col("q")[i], level).alias("own"),
            quantile_boost.pinball(F.col("y"), F.lit(model.start[i]), level).alias("constant"),
            quantile_boost.pinball(F.col("y"), F.col("leaf_q")[i], level).alias("forest"),
            F.col("y").between(F.col("q")[0], F.col("q")[2]).cast("double").alias("inside"),
        )
        for i, level in enumerate(levels)
    ]
    return scored.select("held_out", F.explode(F.array(*losses)).alias("l")).groupBy("held_out", "l.quantile").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.avg("l.own") < F.avg("l.constant")).alias("better_than_constant"),
        ((F.avg("l.own") < F.avg("l.forest")) | (F.count(F.lit(1)) < 500)).alias("better_than_forest"),
        F.avg("l.inside").between(0.7, 0.9).alias("covered"),
    )
