"""Queries over tickets: scoreboards, calibration, priors, power and settlement."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.functions import clocks, odds
from oddsloom.operators import calibration, evaluation, portfolio, settlement
from oddsloom.plans import bindings as b
from oddsloom.plans.catalog import candidates_stage, r6, register, selected_stage
from oddsloom.plans.oracles import CTES, decimal, feedback_ctes

CTES["o_gr"] = """
select strategy_id, modeled_day, market, recommended_side, case result when 'W' then 'win' when 'loss' then 'loss' else 'push' end as result,
  price_american, stake_units as stake, model_p_hit as p0, p_hit_low as pl0, best_ev, ev_low, quality_score,
  case when candidate_lines > 0 then greatest(0.0, least(1.0, eligible_lines / candidate_lines)) end as act,
  case result when 'W' then stake_units * case when price_american > 0 then price_american / 100.0 else 100.0 / abs(price_american) end
    when 'loss' then -stake_units else 0.0 end as pnl, case when result = 'W' then 1 else 0 end as hit
from fx_tickets where result in ('W', 'loss', 'Push') and price_american is not null"""
CTES["o_gs"] = """
select *, case when result in ('win', 'loss') and p0 between 0 and 1 then p0 end as p,
  case when result in ('win', 'loss') and pl0 between 0 and 1 then pl0 end as pl from o_gr"""


def _board_sql(keys: str) -> str:
    return f"""
select {keys}, count(*) as rows_graded, count(p) as rows_scored, count(*) filter (result = 'win') as wins,
  count(*) filter (result = 'loss') as losses, count(*) filter (result = 'push') as pushes, sum(stake) as total_stake_units,
  sum(pnl) as total_pnl_units, sum(pnl) / sum(stake) as roi, avg(best_ev) as avg_best_ev, avg(ev_low) as avg_ev_low,
  avg(quality_score) as avg_quality_score, avg(pl) as avg_p_hit_low, avg((p - hit) * (p - hit)) as brier,
  avg((pl - hit) * (pl - hit)) as brier_low,
  avg(case when hit = 1 then -ln(greatest(0.000001, least(0.999999, p))) else -ln(1.0 - greatest(0.000001, least(0.999999, p))) end)
    filter (p is not null) as log_loss, avg(act) as actionability_rate
from o_gs group by {keys}"""


def _bins_sql(keys: str) -> str:
    return f"""
select {keys}, cast(greatest(0, least(20, floor(p / 0.05))) as integer) as bin, count(*) as count, avg(p) as avg_p,
  avg(hit) as hit_rate, avg((p - hit) * (p - hit)) as brier from o_gs where p is not null group by all"""


for _n, _k in (("s", "strategy_id"), ("m", "market, strategy_id")):
    CTES[f"o_board_{_n}"] = _board_sql(_k)
    CTES[f"o_cbins_{_n}"] = _bins_sql(_k)
    CTES[f"o_err_{_n}"] = (
        f"select {_k}, sum(abs(avg_p - hit_rate) * count) / sum(count) as ece, max(abs(avg_p - hit_rate)) as mce "
        f"from o_cbins_{_n} group by {_k}"
    )
    CTES[f"o_full_{_n}"] = f"select * from o_board_{_n} left join o_err_{_n} using ({_k})"

BOARD = (
    "rows_graded rows_scored wins losses pushes total_stake_units total_pnl_units roi avg_best_ev avg_ev_low "
    "avg_quality_score avg_p_hit_low brier brier_low log_loss ece mce actionability_rate"
)
BOARD_SQL = "rows_graded, rows_scored, wins, losses, pushes, " + r6(
    "total_stake_units total_pnl_units roi avg_best_ev avg_ev_low avg_quality_score avg_p_hit_low brier brier_low "
    "log_loss ece mce actionability_rate"
)


@register("backtest_summary", f"strategy_id {BOARD}", f"select strategy_id, {BOARD_SQL} from o_full_s")
def backtest_summary(spark, sf):
    return evaluation.scoreboard(b.tickets(spark, sf), ["strategy_id"])


@register(
    "calibration_buckets",
    "strategy_id bin bucket_low bucket_high count avg_p hit_rate brier",
    f"select strategy_id, bin, round(bin * 0.05, 6) as bucket_low, round(least(1.0, bin * 0.05 + 0.05), 6) as bucket_high, "
    f"count, {r6('avg_p hit_rate brier')} from o_cbins_s",
)
def calibration_buckets(spark, sf):
    return evaluation.calibration_bins(evaluation.graded(b.tickets(spark, sf)), ["strategy_id"])


@register("calibration_error", "strategy_id ece mce", f"select strategy_id, {r6('ece mce')} from o_err_s")
def calibration_error(spark, sf):
    bins = evaluation.calibration_bins(evaluation.graded(b.tickets(spark, sf)), ["strategy_id"])
    return evaluation.calibration_error(bins, ["strategy_id"])


def _gate_sql(n: str, segment: str) -> str:
    join = "on b.market = s.market" if segment else "on true"
    return f"""
select s.*, b.ece as base_ece, b.brier as base_brier,
  list_sort(list_filter([
    case when s.rows_graded < 200 then 'insufficient_graded' end,
    case when s.wins + s.losses <= 0 or s.rows_scored / (s.wins + s.losses) < 0.9 then 'insufficient_scored_rows' end,
    case when s.ece is null then 'missing_calibration' end, case when b.strategy_id is null then 'missing_baseline' end,
    case when s.strategy_id <> 's007' and s.ece > b.ece + 0.01 then 'calibration_regressed' end,
    case when s.strategy_id <> 's007' and s.brier > b.brier + 0.01 then 'brier_regressed' end], lambda x: x is not null)) as reasons
from o_full_{n} s left join (select * from o_full_{n} where strategy_id = 's007') b {join}"""


CTES["o_gate_s"] = _gate_sql("s", "")
CTES["o_gate_m"] = _gate_sql("m", "market")


@register(
    "promotion_gates",
    "strategy_id gate_status gate_reasons rows_win_loss scored_fraction baseline_ece",
    "select strategy_id, case when len(reasons) = 0 then 'pass' else 'fail' end as gate_status, "
    "array_to_string(reasons, ',') as gate_reasons, wins + losses as rows_win_loss, "
    f"{r6('scored_fraction=rows_scored/(wins+losses) baseline_ece=base_ece')} from o_gate_s",
)
def promotion_gates(spark, sf):
    board = evaluation.scoreboard(b.tickets(spark, sf), ["strategy_id"])
    return evaluation.promotion_gate(evaluation.with_baseline(board, []))


@register(
    "segment_scoreboard",
    f"market strategy_id gate_status gate_reasons {BOARD}",
    "select market, strategy_id, case when len(reasons) = 0 then 'pass' else 'fail' end as gate_status, "
    f"array_to_string(reasons, ',') as gate_reasons, {BOARD_SQL} from o_gate_m",
)
def segment_scoreboard(spark, sf):
    board = evaluation.scoreboard(b.tickets(spark, sf), ["market", "strategy_id"])
    return evaluation.promotion_gate(evaluation.with_baseline(board, ["market"]))


@register(
    "segment_winners",
    "market winner_id winner_roi winner_rows_graded winner_gate_status promotion_winner_id",
    "select w.market, w.strategy_id as winner_id, round(w.roi, 6) as winner_roi, w.rows_graded as winner_rows_graded, "
    "case when len(w.reasons) = 0 then 'pass' else 'fail' end as winner_gate_status, coalesce(p.strategy_id, '') as promotion_winner_id "
    "from (select *, row_number() over (partition by market order by roi desc, rows_graded desc, ece, brier, strategy_id) as rn from o_gate_m) w "
    "left join (select *, row_number() over (partition by market order by roi desc, rows_graded desc, ece, brier, strategy_id) as rn "
    "from o_gate_m where len(reasons) = 0) p on p.market = w.market and p.rn = 1 where w.rn = 1",
)
def segment_winners(spark, sf):
    board = evaluation.scoreboard(b.tickets(spark, sf), ["market", "strategy_id"])
    return evaluation.winners(
        evaluation.promotion_gate(evaluation.with_baseline(board, ["market"])), ["market"]
    )


@register(
    "roi_winner",
    "strategy_id roi rows_graded",
    "select strategy_id, round(roi, 6) as roi, rows_graded from o_full_s where rows_graded >= 50 "
    "order by o_full_s.roi desc, rows_graded desc, strategy_id limit 1",
)
def roi_winner(spark, sf):
    return evaluation.roi_winner(evaluation.scoreboard(b.tickets(spark, sf), ["strategy_id"]), 50)


CTES["o_daily"] = "select strategy_id, modeled_day as day, sum(pnl) as pnl, count(*) as graded from o_gr group by 1, 2"


@register(
    "daily_pnl", "strategy_id day pnl graded",
    "select strategy_id, cast(day as varchar) as day, round(pnl, 6) as pnl, graded from o_daily",
)
def daily_pnl(spark, sf):
    return evaluation.daily_pnl(b.tickets(spark, sf))


CTES["o_power"] = """
select s.strategy_id, count(b.pnl) as overlap_days, avg(s.pnl - b.pnl) as mean_daily_pnl_diff, stddev_samp(s.pnl - b.pnl) as sd
from o_daily s left join (select * from o_daily where strategy_id = 's007') b on s.day = b.day where s.strategy_id <> 's007' group by 1"""
CTES["o_power_t"] = """
select p.*, t.u as target_roi_uplift_per_bet, cast(greatest(1, ceil(pow((1.959963984540054 + 0.8416212335729143) * sd / (t.u * 5), 2))) as bigint)
  as required_days from o_power p cross join (values (0.01), (0.02), (0.03), (0.05)) t(u)"""


@register(
    "power_guidance",
    "strategy_id target_roi_uplift_per_bet overlap_days mean_daily_pnl_diff std_daily_pnl_diff required_days "
    "required_graded_rows meets_with_observed_days",
    f"select strategy_id, target_roi_uplift_per_bet, overlap_days, {r6('mean_daily_pnl_diff std_daily_pnl_diff=sd')}, required_days, "
    "required_days * 5 as required_graded_rows, overlap_days >= required_days as meets_with_observed_days from o_power_t",
)
def power_guidance(spark, sf):
    return evaluation.power_guidance(evaluation.daily_pnl(b.tickets(spark, sf)))


@register(
    "power_gate",
    "strategy_id rows_graded power_status power_reason observed_days required_days required_graded_rows",
    "select f.strategy_id, f.rows_graded, case when f.strategy_id = 's007' then 'baseline' when f.rows_graded < p.required_days * 5 "
    "then 'fail' else 'pass' end as power_status, case when f.strategy_id <> 's007' and f.rows_graded < p.required_days * 5 "
    "then 'underpowered_for_target_uplift' else '' end as power_reason, p.overlap_days as observed_days, p.required_days, "
    "p.required_days * 5 as required_graded_rows from o_full_s f left join o_power_t p on p.strategy_id = f.strategy_id "
    "and p.target_roi_uplift_per_bet = 0.02",
)
def power_gate(spark, sf):
    t = b.tickets(spark, sf)
    guidance = evaluation.power_guidance(evaluation.daily_pnl(t))
    return evaluation.power_gate(evaluation.scoreboard(t, ["strategy_id"]), guidance, 0.021)


def _windowed(spark, sf):
    days = b.event_context(spark, sf).select(
        clocks.snapshot_day(F.col("snapshot_id")).alias("as_of")
    ).distinct()
    daily = calibration.daily_outcomes(b.tickets(spark, sf), 0.1)
    return calibration.windowed_outcomes(daily, days, 21)


@register(
    "rolling_priors",
    "as_of strategy_id market side sample_size wins losses hit_rate posterior_hit_rate delta",
    "select cast(as_of as varchar) as as_of, strategy_id, market, side, sample_size, wins, losses, hit_rate, posterior_hit_rate, delta from o_padj",
)
def rolling_priors(spark, sf):
    return calibration.prior_adjustments(_windowed(spark, sf))


@register(
    "prior_calibration_bins",
    "as_of strategy_id scope market side bucket_index bucket_low bucket_high count avg_model_p hit_rate delta",
    "select cast(as_of as varchar) as as_of, strategy_id, scope, market, side, bucket_index, bucket_low, bucket_high, count, "
    "avg_model_p, hit_rate, delta from o_pbins",
)
def prior_calibration_bins(spark, sf):
    return calibration.prior_bins(_windowed(spark, sf))


CTES["o_map"] = """
select strategy_id, cast(floor(model_p_hit / 0.05) as integer) as bin, count(*) as count, avg(model_p_hit) as avg_p,
  avg(case when result = 'W' then 1.0 else 0.0 end) as hit_rate from fx_tickets where result in ('W', 'loss') group by 1, 2"""


@register(
    "calibration_map",
    "strategy_id bin low high count avg_p hit_rate",
    f"select strategy_id, bin, round(bin * 0.05, 6) as low, round(least(1.0, bin * 0.05 + 0.05), 6) as high, count, {r6('avg_p hit_rate')} from o_map",
)
def calibration_map(spark, sf):
    return calibration.calibration_map(b.tickets(spark, sf))


CTES["o_wf"] = """
select d.strategy_id, d.day, cast(floor(t.model_p_hit / 0.05) as integer) as bin, count(*) as count, avg(t.model_p_hit) as avg_p,
  avg(case when t.result = 'W' then 1.0 else 0.0 end) as hit_rate
from (select distinct strategy_id, modeled_day as day from fx_tickets where result in ('W', 'loss')) d
join fx_tickets t on t.strategy_id = d.strategy_id and t.modeled_day < d.day and t.result in ('W', 'loss') group by 1, 2, 3"""


@register(
    "walk_forward_map",
    "strategy_id day bin low high count avg_p hit_rate",
    f"select strategy_id, cast(day as varchar) as day, bin, round(bin * 0.05, 6) as low, round(least(1.0, bin * 0.05 + 0.05), 6) as high, "
    f"count, {r6('avg_p hit_rate')} from o_wf",
)
def walk_forward_map(spark, sf):
    return calibration.walk_forward_map(b.tickets(spark, sf))


@register(
    "calibrated_tickets",
    "strategy_id day market recommended_side p_conservative p_calibrated confidence_tier tickets",
    "select t.strategy_id, cast(t.modeled_day as varchar) as day, t.market, t.recommended_side, round(t.p_hit_low, 6) as p_conservative, "
    "round(w.hit_rate, 6) as p_calibrated, case when w.hit_rate is null then 'unrated' when round(w.hit_rate, 6) >= 0.57 and quality_score >= 0.7 "
    "and uncertainty_band <= 0.05 then 'high' when round(w.hit_rate, 6) >= 0.53 and quality_score >= 0.55 and uncertainty_band <= 0.08 "
    "then 'medium' else 'low' end as confidence_tier, count(*) as tickets from fx_tickets t left join o_wf w on w.strategy_id = t.strategy_id "
    "and w.day = t.modeled_day and round(w.bin * 0.05, 6) <= t.p_hit_low and t.p_hit_low < round(w.bin * 0.05 + 0.05, 6) group by all",
)
def calibrated_tickets(spark, sf):
    t = b.tickets(spark, sf).withColumnRenamed("modeled_day", "day")
    bins = calibration.walk_forward_map(b.tickets(spark, sf))
    annotated = calibration.annotate(t, bins)
    return annotated.groupBy(
        "strategy_id", "day", "market", "recommended_side", "p_conservative", "p_calibrated", "confidence_tier"
    ).agg(F.count(F.lit(1)).alias("tickets"))


CTES["o_fbt"] = """
select strategy_id || '|' || market || '|' || recommended_side || '|' || cast(model_p_hit as varchar) as k, a.as_of,
  strategy_id as prior_source, market, recommended_side as side, model_p_hit
from (select distinct strategy_id, market, recommended_side, model_p_hit from fx_tickets)
cross join (select max(as_of) as as_of from o_asof) a"""
feedback_ctes("o_fb_t", "o_fbt", "model_p_hit", "k")


@register(
    "calibration_feedback",
    "strategy_id market recommended_side model_p_hit source sample_size confidence delta p_calibrated bucket_index bucket_low bucket_high",
    "select i.prior_source as strategy_id, i.market, i.side as recommended_side, round(i.model_p_hit, 6) as model_p_hit, f.source, f.sample_size, "
    "f.confidence, f.delta, f.p_calibrated, f.bucket_index, f.bucket_low, f.bucket_high from o_fbt i join o_fb_t f on f.k = i.k",
)
def calibration_feedback(spark, sf):
    windowed = _windowed(spark, sf)
    side, wide = calibration.prior_profiles(
        calibration.prior_adjustments(windowed), calibration.prior_bins(windowed)
    )
    newest = b.event_context(spark, sf).agg(
        F.max(clocks.snapshot_day(F.col("snapshot_id"))).alias("as_of")
    )
    probes = b.tickets(spark, sf).select(
        "strategy_id", "market", "recommended_side", "model_p_hit"
    ).distinct().join(F.broadcast(newest)).withColumn("prior_source", F.col("strategy_id"))
    fed = calibration.with_profiles(probes, side, wide)
    return fed.withColumn("fb", calibration.feedback(F.col("model_p_hit"))).select(
        "strategy_id", "market", "recommended_side", "model_p_hit", "fb.*"
    )


# --- settlement ---------------------------------------------------------------------------

CTES["o_games"] = """
select * from (select snapshot_id, home_team, away_team, event_id as game_id, row_number() over (partition by snapshot_id, home_team, away_team
  order by event_id desc) as rn from fx_context) where rn = 1"""
CTES["o_seeds"] = "select * from o_port where portfolio_selected"
CTES["o_boxp"] = f"""
select distinct r.*, regexp_replace(lower(trim(player)), '[^a-z0-9]+', '', 'g') as key,
  regexp_replace(regexp_replace(lower(trim(player)), '[^a-z0-9]+', '', 'g'), '(jr|sr|ii|iii|iv|v)$', '') as base,
  regexp_extract(regexp_replace(lower(player), '( jr\\.)$', ''), '([a-z0-9]+)$', 1) as last_word, substr(lower(player), 1, 1) as initial
from fx_results r"""
CTES["o_set0"] = """
select s.snapshot_id, s.strategy_id, s.event_id, s.market, s.player, s.point, s.recommended_side, s.portfolio_rank, g.game_id,
  r.game_status, regexp_replace(lower(s.player), '[^a-z0-9]+', '', 'g') as key, regexp_extract(lower(s.player), '([a-z0-9]+)$', 1) as last_word
from o_seeds s join fx_context c on c.snapshot_id = s.snapshot_id and c.event_id = s.event_id
left join o_games g on g.snapshot_id = c.snapshot_id and g.home_team = c.home_team and g.away_team = c.away_team
left join (select distinct snapshot_id, event_id, game_status from fx_results) r on r.snapshot_id = g.snapshot_id and r.event_id = g.game_id"""
CTES["o_set1"] = """
select s.*, coalesce(b.key, l.key) as box_key, coalesce(b.points, l.points) as points, coalesce(b.rebounds, l.rebounds) as rebounds,
  coalesce(b.assists, l.assists) as assists, coalesce(b.threes, l.threes) as threes
from o_set0 s left join o_boxp b on b.snapshot_id = s.snapshot_id and b.event_id = s.game_id and b.base = s.key
left join (select *, count(*) over (partition by snapshot_id, event_id, last_word) as n from o_boxp) l
  on b.key is null and l.snapshot_id = s.snapshot_id and l.event_id = s.game_id and l.last_word = s.last_word and l.n = 1"""
CTES["o_set2"] = """
select *, case market when 'player_points' then points when 'player_rebounds' then rebounds when 'player_assists' then assists
  when 'player_threes' then threes when 'player_points_rebounds_assists' then points + rebounds + assists end as actual from o_set1"""
CTES["o_set"] = """
select *, case when game_id is null then 'game_not_found' when game_status = 'in_progress' then 'in_progress_pending'
    when game_status = 'scheduled' then 'scheduled_pending' when game_status is null or game_status <> 'final' then 'game_status_unknown'
    when box_key is null then 'player_not_found' when market = 'player_steals' then 'unsupported_market' else 'final_settled' end as result_reason,
  case when actual = point then 'push' when (recommended_side = 'over') = (actual > point) then 'win' else 'loss' end as graded
from o_set2"""
SETTLED_RESULT = (
    "case when result_reason like '%_pending' then 'pending' when result_reason = 'final_settled' then graded else 'unresolved' end"
)


def _settled(spark, sf):
    context = b.event_context(spark, sf)
    results = b.results(spark, sf)
    picks = selected_stage(spark, sf)
    statuses = results.select("snapshot_id", "event_id", "game_status").distinct()
    games = context.join(statuses, ["snapshot_id", "event_id"], "left").select(
        "snapshot_id", "home_team", "away_team", F.col("event_id").alias("game_id"),
        "game_status", F.col("event_id").alias("game_order"),
    )
    players = results.withColumnRenamed("event_id", "game_id")
    return settlement.settle(settlement.ticket_seeds(picks), games, players)


@register(
    "settlement",
    "snapshot_id strategy_id event_id market player point recommended_side source_game_id actual_stat_value result result_reason",
    f"select snapshot_id, strategy_id, event_id, market, player, point, recommended_side, coalesce(game_id, '') as source_game_id, "
    f"actual as actual_stat_value, {SETTLED_RESULT} as result, result_reason from o_set",
)
def settled_tickets(spark, sf):
    return _settled(spark, sf)


@register(
    "settlement_counts",
    "strategy_id total win loss push pending unresolved final_games in_progress_games scheduled_games",
    f"select strategy_id, count(*) as total, count(*) filter (r = 'win') as win, count(*) filter (r = 'loss') as loss, "
    "count(*) filter (r = 'push') as push, count(*) filter (r = 'pending') as pending, count(*) filter (r = 'unresolved') as unresolved, "
    "count(distinct game_id) filter (game_status = 'final') as final_games, count(distinct game_id) filter (game_status = 'in_progress') as in_progress_games, "
    f"count(distinct game_id) filter (game_status = 'scheduled') as scheduled_games from (select *, {SETTLED_RESULT} as r from o_set) group by 1",
)
def settlement_counts(spark, sf):
    return settlement.settlement_counts(_settled(spark, sf), ["strategy_id"])


@register(
    "ticket_seeds",
    "ticket_key snapshot_id strategy_id event_id market player point recommended_side",
    "select substr(sha256('{\"event_id\":\"' || event_id || '\",\"market\":\"' || market || '\",\"player\":\"' || lower(player) || "
    "'\",\"point\":' || cast(point as varchar) || ',\"side\":\"' || recommended_side || '\",\"version\":2}'), 1, 16) as ticket_key, "
    "snapshot_id, strategy_id, event_id, market, player, point, recommended_side from o_cand where eligible",
)
def ticket_seeds(spark, sf):
    return settlement.ticket_seeds(candidates_stage(spark, sf).where("eligible"))


@register(
    "seed_summary",
    "strategy_id rows avg_edge_pct avg_ev_per_100 avg_model_p_hit",
    "select strategy_id, count(*) as rows, round(avg(round(best_ev * 100.0 + 1e-9, 3)), 6) as avg_edge_pct, "
    f"{r6('avg_ev_per_100=avg(best_ev*100.0) avg_model_p_hit=avg(p_hit)')} from o_cand where eligible group by 1",
)
def seed_summary(spark, sf):
    return settlement.seed_summary(candidates_stage(spark, sf).where("eligible"))


@register(
    "ablation_scoreboard",
    "cap strategy_id tickets wins losses pushes total_pnl_units roi",
    "select cap, strategy_id, count(*) as tickets, count(*) filter (r = 'win') as wins, count(*) filter (r = 'loss') as losses, count(*) filter (r = 'push') as pushes, "
    "round(coalesce(sum(pnl), 0.0), 6) as total_pnl_units, round(sum(pnl) / count(pnl), 6) as roi from (select c.cap, s.strategy_id, s.r, case s.r when 'win' then "
    f"{decimal('s.price')} - 1.0 when 'loss' then -1.0 when 'push' then 0.0 end as pnl from (select o.*, {SETTLED_RESULT} as r, c.price from o_set o "
    "join o_cand c using (snapshot_id, strategy_id, event_id, market, player, point)) s join (values (1), (2), (5)) c(cap) on s.portfolio_rank <= c.cap) group by 1, 2",
)
def ablation_scoreboard(spark, sf):
    """Days, strategies and pick caps in one job.

    The picks under a smaller daily cap are the first picks under a larger one, so selection
    and settlement run once and every ticket fans out to the caps it survives.
    """
    settled = _settled(spark, sf)
    capped = settled.withColumn("cap", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5)))).where(
        F.col("portfolio_rank") <= F.col("cap")
    )
    graded = F.col("result").isin("win", "loss", "push")
    pnl = F.when(graded, odds.pnl_units(F.col("result"), F.col("selected_price"), F.lit(1.0)))
    return capped.withColumn("pnl", pnl).groupBy("cap", "strategy_id").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count_if(F.col("result") == "win").alias("wins"),
        F.count_if(F.col("result") == "loss").alias("losses"),
        F.count_if(F.col("result") == "push").alias("pushes"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl_units"),
        F.avg("pnl").alias("roi"),
    )
