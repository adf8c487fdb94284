"""Checking SQL for DuckDB, written independently of the Spark operators.

Each entry of ``CTES`` is one common table expression; :func:`query` puts the ones a final
SELECT needs, directly or through others, in front of it.
"""

from __future__ import annotations

import re

from oddsloom.plans import bindings
from oddsloom.plans.recipes import RECIPES, recipe_values_sql

IDENT = "snapshot_id, event_id, market, player"
LINE = f"{IDENT}, point"


def implied(price: str) -> str:
    return f"(case when {price} > 0 then 100.0 / ({price} + 100.0) when {price} < 0 then -{price} / (100.0 - {price}) end)"


def decimal(price: str) -> str:
    return f"(case when {price} > 0 then 1.0 + {price} / 100.0 when {price} < 0 then 1.0 - 100.0 / {price} end)"


def clamp(x: str, lo: float, hi: float) -> str:
    return f"(case when {x} is not null then greatest({lo}, least({hi}, {x})) end)"


def ev(p: str, price: str) -> str:
    return (
        f"(case when {p} > 0 and {p} < 1 and {price} <> 0 "
        f"then {p} * ({decimal(price)} - 1.0) - (1.0 - {p}) end)"
    )


def american(dec: str) -> str:
    return (
        f"cast(case when {dec} >= 2.0 then round_even(({dec} - 1.0) * 100.0, 0) "
        f"when {dec} > 1.0 then round_even(-100.0 / ({dec} - 1.0), 0) end as integer)"
    )


def person_key(name: str) -> str:
    return f"regexp_replace(lower(trim({name})), '[^a-z0-9]+', '', 'g')"


def weight_case(market: str, table: dict[str, float], default: float) -> str:
    arms = " ".join(f"when '{k}' then {v}" for k, v in table.items())
    return f"(case {market} {arms} else {default} end)"


CTES: dict[str, str] = dict(bindings.SQL)

CTES["o_clock"] = "select snapshot_id, max(last_update) as now_utc from fx_quotes group by 1"

CTES["o_bk"] = f"""
select {LINE}, book,
  max(case when side = 'Over' then price end) as over_price,
  max(case when side = 'Under' then price end) as under_price,
  min(case when side = 'Over' then price end) as over_low,
  min(case when side = 'Under' then price end) as under_low,
  max(last_update) as last_seen
from fx_quotes group by {LINE}, book"""

CTES["o_offers"] = f"""
select * from (
  select {LINE}, side, book, price, last_update, link,
    row_number() over (partition by {LINE}, side, book order by price desc, last_update, link) as rn
  from fx_quotes) where rn = 1"""

CTES["o_pairs"] = f"""
select {LINE}, book, over_price, under_price,
  {implied('over_price')} as p_over_implied, {implied('under_price')} as p_under_implied,
  {implied('over_price')} / ({implied('over_price')} + {implied('under_price')}) as p_over_fair,
  {implied('over_price')} + {implied('under_price')} - 1.0 as hold
from o_bk where over_price is not null and under_price is not null"""

# Excluded-book scenarios: '' keeps every book.
CTES["o_best0"] = f"""
select * from (select {LINE}, side, book, price, last_update, link,
  row_number() over (partition by {LINE}, side order by price desc, book, last_update, link) as rn
  from o_offers) where rn = 1"""
CTES["o_xb"] = f"""
select distinct {IDENT}, book as xb from o_best0
union select distinct {IDENT}, '' as xb from o_bk"""
CTES["o_lx"] = f"""
select l.*, x.xb from (select {LINE}, max(last_seen) as freshest, count(*) as book_count,
    max(over_price) - min(over_low) as over_delta, max(under_price) - min(under_low) as under_delta,
    count(over_price) as over_books, count(under_price) as under_books
  from o_bk group by {LINE}) l
join o_xb x using ({IDENT})"""
CTES["o_sbest"] = f"""
select * from (select b.{LINE.replace(', ', ', b.')}, x.xb, b.side, b.book, b.price, b.last_update, b.link,
    row_number() over (partition by b.{LINE.replace(', ', ', b.')}, x.xb, b.side
      order by b.price desc, b.book, b.last_update, b.link) as rn
  from o_offers b join o_xb x using ({IDENT}) where b.book <> x.xb) where rn = 1"""
CTES["o_sl0"] = f"""
select l.{LINE.replace(', ', ', l.')}, l.xb, any_value(l.freshest) as freshest,
  any_value(l.book_count) as book_count,
  any_value(coalesce(l.over_delta, 0)) as over_delta, any_value(coalesce(l.under_delta, 0)) as under_delta,
  any_value(l.over_books) as over_books, any_value(l.under_books) as under_books,
  count(p.book) as n_pairs, quantile_cont(p.p_over_fair, 0.5) as p_med,
  quantile_cont(p.hold, 0.5) as hold_med,
  quantile_cont(p.p_over_fair, 0.75) - quantile_cont(p.p_over_fair, 0.25) as iqr,
  max(p.p_over_fair) - min(p.p_over_fair) as rng,
  coalesce(string_agg(p.book, ',' order by p.book), '') as books_used
from o_lx l left join o_pairs p on {" and ".join(f"l.{c} = p.{c}" for c in LINE.split(", "))} and p.book <> l.xb
group by l.{LINE.replace(', ', ', l.')}, l.xb"""
CTES["o_sl1"] = f"""
select s.*, c.now_utc, o.book as over_book, o.price as over_price, o.last_update as over_time, o.link as over_link,
  u.book as under_book, u.price as under_price, u.last_update as under_time, u.link as under_link,
  {implied('o.price')} / ({implied('o.price')} + {implied('u.price')}) as p_best,
  {implied('o.price')} + {implied('u.price')} - 1.0 as hold_best,
  round(greatest(0.0, (epoch(c.now_utc) - epoch(s.freshest)) / 60.0), 6) as age
from o_sl0 s join o_clock c using (snapshot_id)
left join (select * from o_sbest where side = 'Over') o using ({LINE}, xb)
left join (select * from o_sbest where side = 'Under') u using ({LINE}, xb)"""
CTES["o_sl2"] = f"""
select *, least(1.0, n_pairs / 4.0) as depth,
  coalesce({clamp(f"1.0 - {clamp('coalesce(hold_med, hold_best)', 0.0, 1.0)} / 0.12", 0.0, 1.0)}, 0.0) as hold_sc,
  coalesce({clamp(f"1.0 - {clamp('coalesce(iqr, rng)', 0.0, 1.0)} / 0.15", 0.0, 1.0)}, 0.0) as disp_sc,
  coalesce({clamp("1.0 - age / 40.0", 0.0, 1.0)}, 0.0) as fresh_sc
from o_sl1"""
CTES["o_sl"] = """
select *, round(depth * 0.30 + hold_sc * 0.25 + disp_sc * 0.25 + fresh_sc * 0.20, 6) as quality,
  round(greatest(0.01, least(0.2, greatest(
    0.01 + (1.0 - depth) * 0.05 + (1.0 - hold_sc) * 0.02 + (1.0 - disp_sc) * 0.05 + (1.0 - fresh_sc) * 0.03,
    coalesce(iqr / 2.0, 0.0)))), 6) as band
from o_sl2"""

# Isotonic fit as min over starts of max over ends of the block mean.
CTES["o_pts"] = f"""
select {LINE}, xb, greatest(0.01, least(0.99, p_med)) as raw, hold_med as hold,
  cast(greatest(n_pairs, 1) as double) as w, books_used,
  row_number() over (partition by {IDENT}, xb order by point) as i
from o_sl where p_med is not null"""
CTES["o_sums"] = f"""
select *, sum(w) over (partition by {IDENT}, xb order by i) as sw,
  sum(w * raw) over (partition by {IDENT}, xb order by i) as swv from o_pts"""
CTES["o_blocks"] = f"""
select a.{IDENT.replace(', ', ', a.')}, a.xb, i.i, a.i as ai,
  max((b.swv - a.swv + a.w * a.raw) / (b.sw - a.sw + a.w)) as top
from o_sums i join o_sums a using ({IDENT}, xb) join o_sums b using ({IDENT}, xb)
where a.i <= i.i and b.i >= i.i group by a.{IDENT.replace(', ', ', a.')}, a.xb, i.i, a.i"""
CTES["o_fit"] = f"select {IDENT}, xb, i, min(top) as fit from o_blocks group by {IDENT}, xb, i"
CTES["o_curve"] = f"""
select p.{LINE.replace(', ', ', p.')}, p.xb, p.i, p.raw, p.hold, p.w, p.books_used,
  greatest(0.01, least(0.99, f.fit)) as p_over
from o_pts p join o_fit f using ({IDENT}, xb, i)"""
CTES["o_curve_sum"] = f"""
select {IDENT}, xb, quantile_cont(hold, 0.5) as hold_median, count(*) as n_points from o_curve group by {IDENT}, xb"""
CTES["o_curve_books"] = f"""
select {IDENT}, xb, string_agg(book, ',' order by book) as curve_books, count(*) as n_books from (
  select distinct c.{IDENT.replace(', ', ', c.')}, c.xb, p.book from o_curve c join o_pairs p using ({LINE}) where p.book <> c.xb)
group by {IDENT}, xb"""
CTES["o_sides"] = f"""
select t.{LINE.replace(', ', ', t.')}, t.xb,
  max(case when c.point <= t.point then c.i end) as li, min(case when c.point >= t.point then c.i end) as ri
from o_sl t join o_curve c on {" and ".join(f"t.{c} = c.{c}" for c in IDENT.split(", "))} and t.xb = c.xb
group by t.{LINE.replace(', ', ', t.')}, t.xb"""
CTES["o_est"] = f"""
select s.{LINE.replace(', ', ', s.')}, s.xb, m.n_points, b.curve_books, b.n_books,
  case when l.point = s.point then 'exact' when l.point is null then 'clamped_low'
    when r.point is null then 'clamped_high' else 'interpolated' end as method,
  greatest(0.01, least(0.99, case when l.point is not null and r.point > l.point
    then l.p_over + (r.p_over - l.p_over) * ((s.point - l.point) / (r.point - l.point))
    else coalesce(l.p_over, r.p_over) end)) as ref_p,
  case when l.point is not null and r.point > l.point
    then coalesce(l.hold + (r.hold - l.hold) * ((s.point - l.point) / (r.point - l.point)), m.hold_median)
    else coalesce(l.hold, r.hold, m.hold_median) end as ref_hold
from o_sides s join o_curve_sum m using ({IDENT}, xb)
join o_curve_books b using ({IDENT}, xb)
left join o_curve l on {" and ".join(f"s.{c} = l.{c}" for c in IDENT.split(", "))} and s.xb = l.xb and s.li = l.i
left join o_curve r on {" and ".join(f"s.{c} = r.{c}" for c in IDENT.split(", "))} and s.xb = r.xb and s.ri = r.i"""
CTES["o_scn"] = f"""
select s.*, coalesce(e.method, 'missing') as ref_method, e.ref_p, e.ref_hold, coalesce(e.n_points, 0) as n_points,
  coalesce(e.curve_books, '') as curve_books, coalesce(e.n_books, 0) as n_curve_books
from o_sl s left join o_est e using ({LINE}, xb)"""

# --- context ---------------------------------------------------------------------------

CTES["o_events"] = """
select coalesce(c.snapshot_id, m.snapshot_id) as snapshot_id, coalesce(c.event_id, m.event_id) as event_id,
  coalesce(c.home_team, '') as home_team, coalesce(c.away_team, '') as away_team, c.commence_time, m.total, m.home_spread
from fx_context c full outer join (
  select s.snapshot_id, s.event_id, round(median(case when s.market = 'totals' then s.point end), 1) as total,
    round(median(case when s.market = 'spreads' and s.side = c.home_team then s.point
      when s.market = 'spreads' and s.side = c.away_team then -s.point end), 1) as home_spread
  from fx_slate s left join fx_context c on s.snapshot_id = c.snapshot_id and s.event_id = c.event_id
  group by 1, 2) m on c.snapshot_id = m.snapshot_id and c.event_id = m.event_id"""
CTES["o_inj_src"] = f"""
select * from (select *, {person_key('player')} as player_key,
    row_number() over (partition by snapshot_id, source, {person_key('player')} order by row_order desc) as rn
  from fx_injuries) where rn = 1"""
CTES["o_inj"] = """
select coalesce(o.snapshot_id, s.snapshot_id) as snapshot_id, coalesce(o.player_key, s.player_key) as player_key,
  coalesce(o.player, s.player) as player, coalesce(o.status, s.status) as status, coalesce(o.note, s.note) as note,
  coalesce(o.date_update, s.date_update) as date_update, coalesce(s.team, o.team) as team,
  case when o.player_key is not null then 'official' else 'secondary' end as source,
  o.player_key is not null as listed_officially
from (select * from o_inj_src where source = 'official') o
full outer join (select * from o_inj_src where source = 'secondary') s
  on o.snapshot_id = s.snapshot_id and o.player_key = s.player_key"""
CTES["o_team_counts"] = """
select snapshot_id, team, count(*) filter (status in ('out', 'out_for_season')) as n_out,
  count(*) filter (status = 'out') as out, count(*) filter (status = 'out_for_season') as out_for_season,
  count(*) filter (status = 'doubtful') as doubtful, count(*) filter (status = 'questionable') as questionable
from o_inj group by 1, 2"""
CTES["o_health"] = """
select snapshot_id, count(*) filter (source = 'official') as official_rows,
  count(*) filter (source = 'secondary') as secondary_rows from fx_injuries group by 1"""
CTES["o_roster"] = f"""
select snapshot_id, team, {person_key('player')} as player_key, bool_or(status = 'ACTIVE') as active,
  bool_or(status = 'INACTIVE') as inactive from fx_roster group by 1, 2, 3"""
CTES["o_teams"] = "select distinct snapshot_id, team from o_roster"
CTES["o_pc0"] = f"""
select q.snapshot_id, q.event_id, q.player, {person_key('q.player')} as player_key, c.home_team as home, c.away_team as away,
  ht.team is not null as home_known, wt.team is not null as away_known,
  hr.player_key is not null as in_home, ar.player_key is not null as in_away,
  coalesce(hr.inactive, false) or coalesce(ar.inactive, false) as inactive,
  coalesce(hr.active, false) or coalesce(ar.active, false) as active
from (select distinct snapshot_id, event_id, player from fx_quotes) q
left join fx_context c on q.snapshot_id = c.snapshot_id and q.event_id = c.event_id
left join o_teams ht on ht.snapshot_id = q.snapshot_id and ht.team = c.home_team
left join o_teams wt on wt.snapshot_id = q.snapshot_id and wt.team = c.away_team
left join o_roster hr on hr.snapshot_id = q.snapshot_id and hr.team = c.home_team and hr.player_key = {person_key('q.player')}
left join o_roster ar on ar.snapshot_id = q.snapshot_id and ar.team = c.away_team and ar.player_key = {person_key('q.player')}"""
CTES["o_pc1"] = """
select p.*, case when home is null then 'unknown_event' when not home_known or not away_known then 'unknown_roster'
    when inactive then 'inactive' when active then 'active' when in_home or in_away then 'rostered'
    else 'not_on_roster' end as roster_status,
  i.status as listed_status, coalesce(i.note, '') as note, i.team as injury_team,
  coalesce(i.listed_officially, false) as listed_officially, coalesce(h.official_rows, 0) > 0 as official_ready
from o_pc0 p left join o_inj i on p.snapshot_id = i.snapshot_id and p.player_key = i.player_key
left join o_health h on h.snapshot_id = p.snapshot_id"""
CTES["o_pc2"] = """
select *, official_ready and not listed_officially and roster_status in ('active', 'rostered') as unlisted,
  case when home_known and away_known and in_home and not in_away then home
    when home_known and away_known and in_away and not in_home then away
    when injury_team in (home, away) then injury_team else '' end as player_team
from o_pc1"""
CTES["o_pc"] = """
select p.*, case when unlisted then 'available_unlisted' else coalesce(listed_status, 'unknown') end as injury_status,
  case when unlisted and note = '' then 'Not listed on official NBA injury report.' else note end as injury_note,
  case when player_team = '' then '' when player_team = home then away when player_team = away then home else '' end as opponent_team
from o_pc2 p"""
CTES["o_pctx"] = """
select p.snapshot_id, p.event_id, p.player, p.player_key, p.roster_status, p.injury_status, p.injury_note,
  p.player_team, p.opponent_team,
  coalesce(t.n_out, 0) - case when coalesce(p.injury_team = p.player_team, false) and p.listed_status in ('out', 'out_for_season') then 1 else 0 end as t_out,
  coalesce(t.doubtful, 0) - case when coalesce(p.injury_team = p.player_team, false) and p.listed_status = 'doubtful' then 1 else 0 end as t_doubtful,
  coalesce(t.questionable, 0) - case when coalesce(p.injury_team = p.player_team, false) and p.listed_status = 'questionable' then 1 else 0 end as t_questionable,
  coalesce(o.n_out, 0) as o_out, coalesce(o.doubtful, 0) as o_doubtful
from o_pc p left join o_team_counts t on t.snapshot_id = p.snapshot_id and t.team = p.player_team
left join o_team_counts o on o.snapshot_id = p.snapshot_id and o.team = p.opponent_team"""

_CUT_P = {"doubtful": 0.12, "questionable": 0.06, "day_to_day": 0.04, "probable": 0.02}
_CUT_M = {"doubtful": 6.0, "questionable": 3.0, "day_to_day": 2.0, "probable": 0.5}
_MIN_W = {"player_points": 0.008, "player_rebounds": 0.007, "player_assists": 0.008, "player_threes": 0.006, "player_points_rebounds_assists": 0.009, "player_steals": 0.004}
_USE_W = {"player_points": 0.65, "player_rebounds": 0.35, "player_assists": 0.45, "player_threes": 0.5, "player_points_rebounds_assists": 0.75, "player_steals": 0.2}
_OPP_W = {"player_points": 0.006, "player_rebounds": 0.004, "player_assists": 0.004, "player_threes": 0.003, "player_points_rebounds_assists": 0.007, "player_steals": -0.003}
_BASE_M = {"player_points": 31.0, "player_rebounds": 30.0, "player_assists": 31.0, "player_threes": 30.0, "player_points_rebounds_assists": 32.0}
_LOP = "(case when coalesce(spread_abs, 0) >= 12 then {a} when coalesce(spread_abs, 0) >= 8 then {b} else 0.0 end)"

CTES["o_adj0"] = """
select l.snapshot_id, l.event_id, l.market, l.player, l.point, p.* exclude (snapshot_id, event_id, player),
  abs(e.home_spread) as spread_abs, e.total, coalesce(e.home_team, '') as home_team, coalesce(e.away_team, '') as away_team, e.commence_time,
  c.event_id is not null as event_mapped
from (select distinct snapshot_id, event_id, market, player, point from o_bk) l
join o_pctx p on p.snapshot_id = l.snapshot_id and p.event_id = l.event_id and p.player = l.player
left join o_events e on e.snapshot_id = l.snapshot_id and e.event_id = l.event_id
left join fx_context c on c.snapshot_id = l.snapshot_id and c.event_id = l.event_id"""
CTES["o_adj1"] = f"""
select *, case when roster_status in ('inactive', 'not_on_roster') or injury_status in ('out', 'out_for_season') then -0.49
    else -{weight_case('injury_status', _CUT_P, 0.0)} + least(t_out * 0.015 + t_doubtful * 0.01 + t_questionable * 0.005, 0.05)
      + least(o_out * 0.008 + o_doubtful * 0.005, 0.03) - {_LOP.format(a=0.025, b=0.015)} end as adjustment,
  {weight_case('market', _BASE_M, 30.0)} as base_min,
  round(greatest(10.0, least(40.0, {weight_case('market', _BASE_M, 30.0)} + least(4.0, t_out * 1.1 + t_doubtful * 0.5)
    - {weight_case('injury_status', _CUT_M, 0.0)}
    - case when roster_status in ('unknown_roster', 'unknown_event') then 1.5 else 0.0 end - {_LOP.format(a=2.0, b=1.0)})), 2) as proj_min,
  round(greatest(-0.08, least(0.09, t_out * 0.012 + t_doubtful * 0.006))
    - case when injury_status in ('questionable', 'doubtful') then 0.01 else 0.0 end, 4) as usage_delta
from o_adj0"""
CTES["o_adj2"] = f"""
select *, round(proj_min - base_min, 2) as min_delta,
  greatest(-0.12, least(0.12, round(proj_min - base_min, 2) * {weight_case('market', _MIN_W, 0.007)}
    + usage_delta * {weight_case('market', _USE_W, 0.4)} + o_out * {weight_case('market', _OPP_W, 0.003)})) as market_delta
from o_adj1"""
CTES["o_min_rank"] = f"""
select *, {person_key('player')} as player_key,
  row_number() over (partition by snapshot_id, event_id, {person_key('player')}, market order by row_order desc) as rn_exact,
  row_number() over (partition by snapshot_id, {person_key('player')} order by row_order desc) as rn_player
from fx_minutes"""
CTES["o_adj"] = f"""
select a.*, coalesce(x.minutes_p10, y.minutes_p10) as mp10, coalesce(x.minutes_p50, y.minutes_p50) as mp50,
  coalesce(x.minutes_p90, y.minutes_p90) as mp90, coalesce(x.p_active, y.p_active) as p_active,
  coalesce(x.confidence_score, y.confidence_score) as confidence_score,
  round(coalesce(x.minutes_p90, y.minutes_p90) - coalesce(x.minutes_p10, y.minutes_p10), 6) as minutes_band,
  case when coalesce(x.minutes_p50, y.minutes_p50) is null then 0.0 else greatest(-0.08, least(0.08, ((coalesce(x.minutes_p50, y.minutes_p50) - a.proj_min) * {weight_case('a.market', _MIN_W, 0.007)} * 0.75
    + (coalesce(x.p_active, y.p_active, 1.0) - 1.0) * 0.2)
    * greatest(0.1, least(1.0, greatest(0.0, coalesce(x.confidence_score, y.confidence_score, 0.0)))))) end as min_shift_raw,
  coalesce(x.minutes_p50, y.minutes_p50) is not null as has_minutes
from o_adj2 a
left join (select * from o_min_rank where rn_exact = 1) x on x.snapshot_id = a.snapshot_id and x.event_id = a.event_id
  and x.player_key = a.player_key and x.market = a.market
left join (select * from o_min_rank where rn_player = 1) y on y.snapshot_id = a.snapshot_id and y.player_key = a.player_key"""

# --- rolling priors --------------------------------------------------------------------

CTES["o_asof"] = "select distinct snapshot_id, cast(right(snapshot_id, 10) as date) as as_of from fx_context"
CTES["o_wl"] = """
select strategy_id, modeled_day, market, recommended_side as side, case when result = 'W' then 1 else 0 end as hit,
  greatest(0.01, least(0.99, model_p_hit)) as p
from fx_tickets where result in ('W', 'loss')"""
CTES["o_wl_asof"] = """
select a.as_of, w.*, cast(least(10, floor(w.p / 0.1)) as integer) as bin
from (select distinct as_of from o_asof) a join o_wl w on w.modeled_day < a.as_of and w.modeled_day >= a.as_of - 21"""
CTES["o_padj"] = """
select as_of, strategy_id, market, side, count(*) as sample_size, cast(sum(hit) as bigint) as wins,
  cast(count(*) - sum(hit) as bigint) as losses, round(sum(hit) / count(*), 6) as hit_rate,
  round((sum(hit) + 1.0) / (count(*) + 2), 6) as posterior_hit_rate,
  round(greatest(-0.02, least(0.02, ((sum(hit) + 1.0) / (count(*) + 2) - 0.5) * least(1.0, count(*) / 25.0))), 6) as delta
from o_wl_asof group by 1, 2, 3, 4"""
_BINS = """bin as bucket_index, round(bin * 0.1, 6) as bucket_low, round(least(1.0, bin * 0.1 + 0.1), 6) as bucket_high,
  count(*) as count, round(sum(p) / count(*), 6) as avg_model_p, round(sum(hit) / count(*), 6) as hit_rate,
  round(sum(hit) / count(*) - sum(p) / count(*), 6) as delta"""
CTES["o_pbins"] = f"""
select as_of, strategy_id, 'market_side' as scope, market, side, {_BINS} from o_wl_asof group by as_of, strategy_id, market, side, bin
union all
select as_of, strategy_id, 'global' as scope, '' as market, '' as side, {_BINS} from o_wl_asof group by as_of, strategy_id, bin"""


def feedback_ctes(prefix: str, source: str, p: str, key: str) -> None:
    """Calibration feedback of column ``p`` of ``source`` as CTE ``prefix``."""
    CTES[f"{prefix}_a"] = f"""
select s.{key}, s.as_of, s.prior_source, s.market, s.side, s.p,
  greatest(0.01, least(0.99, s.p)) as c, cast(least(10, floor(greatest(0.01, least(0.99, s.p)) / 0.1)) as integer) as bin,
  coalesce(a.delta, 0.0) as adj, coalesce(a.sample_size, 0) as adj_n
from (select *, {p} as p from {source}) s left join o_padj a on a.as_of = s.as_of and a.strategy_id = s.prior_source
  and a.market = s.market and a.side = s.side"""
    CTES[f"{prefix}_b"] = f"""
select f.*, m.count as m_n, m.delta as m_d, g.count as g_n, g.delta as g_d,
  coalesce(m.bucket_low, g.bucket_low) as b_low, coalesce(m.bucket_high, g.bucket_high) as b_high
from {prefix}_a f
left join o_pbins m on m.scope = 'market_side' and m.as_of = f.as_of and m.strategy_id = f.prior_source
  and m.market = f.market and m.side = f.side and m.bucket_index = f.bin and m.count >= 10
left join o_pbins g on g.scope = 'global' and g.as_of = f.as_of and g.strategy_id = f.prior_source
  and g.bucket_index = f.bin and g.count >= 10"""
    CTES[f"{prefix}_c"] = f"""
select *, case when p is null then 'unavailable' when m_n is not null then 'market_side' when g_n is not null then 'global'
    when adj_n > 0 then 'adjustment' else 'none' end as source,
  case when m_n is not null then 1.0 when g_n is not null then 0.85 else 0.7 end as sw, coalesce(m_n, g_n, adj_n) as n,
  case when coalesce(m_n, g_n) is null then adj else adj * 0.7 + coalesce(m_d, g_d) * 0.3 end as raw
from {prefix}_b"""
    CTES[prefix] = f"""
select {key}, source, case when source = 'unavailable' then 0 else n end as sample_size,
  case when source in ('unavailable', 'none') then 0.0 else round(least(1.0, n / 10.0) * sw, 6) end as confidence,
  case when source = 'unavailable' then null when source = 'none' then 0.0
    else round(greatest(-0.02, least(0.02, raw * (n / (n + 100.0)) * sw)), 6) end as delta,
  case when source = 'unavailable' then null when source = 'none' then round(c, 6)
    else round(greatest(0.01, least(0.99, c + greatest(-0.02, least(0.02, raw * (n / (n + 100.0)) * sw)))), 6) end as p_calibrated,
  case when source = 'unavailable' then null else bin end as bucket_index,
  case when source = 'none' then round(bin * 0.1, 6) else b_low end as bucket_low,
  case when source = 'none' then round(least(1.0, bin * 0.1 + 0.1), 6) else b_high end as bucket_high
from {prefix}_c"""


# --- candidates ------------------------------------------------------------------------

CTES["o_recipes"] = recipe_values_sql(RECIPES)


def _side_cte(side: str) -> str:
    other_method = "r.baseline_method = 'median_book'"
    exact = f"{other_method} and s.p_med is not null and s.hold_med is not null"
    curve = f"{other_method} and s.ref_p is not null"
    return f"""
select b.{LINE.replace(', ', ', b.')}, r.strategy_id, s.xb,
  case when {exact} then s.p_med when {curve} then s.ref_p
    when {other_method} and r.baseline_fallback <> 'best_sides' then null else s.p_best end as fair,
  case when {exact} then s.hold_med when {curve} then s.ref_hold
    when {other_method} and r.baseline_fallback <> 'best_sides' then null else s.hold_best end as hold,
  case when {exact} then 'median_book' when {curve} then 'median_book_interpolated'
    when {other_method} and r.baseline_fallback <> 'best_sides' then 'missing'
    when {other_method} then 'best_sides_fallback' else 'best_sides' end as used0,
  case when {exact} then 'exact' else s.ref_method end as ref_method, s.n_points, s.curve_books, s.n_curve_books,
  s.books_used, s.n_pairs, s.p_med, s.hold_med, s.iqr, s.rng, s.hold_best, s.age, s.depth, s.hold_sc, s.disp_sc,
  s.fresh_sc, s.quality, s.band, s.over_book as sc_over_book, s.under_book as sc_under_book,
  case when r.probabilistic_profile = 'minutes_v1' then a.min_shift_raw else 0.0 end as shift, a.adjustment, a.market_delta
from (select * from o_scn where xb = '') b cross join o_recipes r
join o_adj a using ({LINE})
join o_scn s on {" and ".join(f"s.{c} = b.{c}" for c in LINE.split(", "))}
  and s.xb = case when r.exclude_selected_book then coalesce(b.{side}_book, '') else '' end"""


for _side in ("over", "under"):
    CTES[f"o_{_side}0"] = _side_cte(_side)
    CTES[f"o_{_side}1"] = f"""
select *, {clamp("fair + adjustment + market_delta", 0.01, 0.99)} as p0 from o_{_side}0"""
    CTES[f"o_{_side}2"] = f"""
select *, case when shift <> 0 then {clamp("p0 + shift", 0.01, 0.99)} else p0 end as p_model from o_{_side}1"""
    CTES[f"o_{_side}3"] = f"""
select *, round({clamp("p_model - band", 0.01, 0.99)}, 6) as p_low, round({clamp("p_model + band", 0.01, 0.99)}, 6) as p_high
from o_{_side}2"""
CTES["o_pick0"] = f"""
select b.*, r.*, o.strategy_id as sid_over,
  round({ev("o.p_model", "b.over_price")}, 6) as ev_over,
  round({ev("(1.0 - u.p_model)", "b.under_price")}, 6) as ev_under
from (select {LINE}, over_price, under_price, over_book, under_book, over_time, under_time, over_link, under_link, book_count,
    over_delta, under_delta from o_scn where xb = '') b
join o_over3 o using ({LINE}) join o_under3 u on {" and ".join(f"u.{c} = b.{c}" for c in LINE.split(", "))} and u.strategy_id = o.strategy_id
join o_recipes r on r.strategy_id = o.strategy_id"""
CTES["o_pick1"] = """
select *, case when ev_over is null and ev_under is null then 'none'
  when coalesce(ev_over, -999.0) >= coalesce(ev_under, -999.0) then 'over' else 'under' end as side from o_pick0"""
CTES["o_pick2"] = f"""
select p.*, m.fair, m.hold, m.used0, m.ref_method, m.n_points, m.curve_books, m.n_curve_books, m.books_used, m.n_pairs,
  m.p_med, m.hold_med, m.iqr, m.hold_best, m.age, m.depth, m.hold_sc, m.disp_sc, m.fresh_sc, m.quality, m.band,
  m.p_model, m.p_low, m.p_high, m.sc_over_book, m.sc_under_book,
  case when p.side <> 'none' or p.exclude_selected_book then true else false end as is_real
from o_pick1 p join (select 'over' as ms, * from o_over3 union all select 'under' as ms, * from o_under3) m
  on {" and ".join(f"m.{c} = p.{c}" for c in LINE.split(", "))} and m.strategy_id = p.strategy_id
  and m.ms = case when p.side = 'under' then 'under' else 'over' end"""
CTES["o_pick3"] = f"""
select *, case when is_real then case when side = 'under' then under_price else over_price end end as price,
  coalesce(case when is_real then case when side = 'under' then under_book else over_book end end, '') as book,
  coalesce(case when is_real then case when side = 'under' then under_link else over_link end end, '') as link,
  case when is_real then case when side = 'under' then under_time else over_time end end as quote_time,
  case when is_real then case when side = 'under' then 1.0 - p_model else p_model end end as p_hit,
  case when is_real then case when side = 'under' then 1.0 - fair else fair end end as p_fair,
  case when is_real then case when side = 'under' then round({clamp("1.0 - p_high", 0.01, 0.99)}, 6) else p_low end end as p_hit_low,
  case when is_real then case when side = 'under' then round({clamp("1.0 - p_low", 0.01, 0.99)}, 6) else p_high end end as p_hit_high,
  case when exclude_selected_book and fair is null then 'missing' else used0 end as used
from o_pick2"""
CTES["o_pick4"] = f"""
select *, case when side = 'under' then ev_under when side = 'over' then ev_over end as best_ev,
  round({ev("p_hit", "price")} / ({decimal("price")} - 1.0), 6) as best_kelly,
  round({ev("p_hit_low", "price")}, 6) as ev_low, round({ev("p_hit_high", "price")}, 6) as ev_high,
  case when used in ('best_sides', 'best_sides_fallback') then
      (case when sc_over_book is not null then 1 else 0 end)
      + (case when sc_under_book is not null and sc_under_book is distinct from sc_over_book then 1 else 0 end)
    when used = 'median_book_interpolated' then n_curve_books else n_pairs end as n_base_books
from o_pick3"""
CTES["o_cal_in"] = """
select p.snapshot_id || '|' || p.event_id || '|' || p.market || '|' || p.player || '|' || p.point || '|' || p.strategy_id as k,
  a.as_of, case when use_rolling_priors then rolling_priors_source end as prior_source, p.market, p.side, p.p_hit, p.p_hit_low
from o_pick4 p join o_asof a on a.snapshot_id = p.snapshot_id"""
feedback_ctes("o_fb_hit", "o_cal_in", "p_hit", "k")
feedback_ctes("o_fb_low", "o_cal_in", "p_hit_low", "k")
CTES["o_cand0"] = f"""
select p.*, a.* exclude ({LINE}, p_active), c.prior_source, h.p_calibrated as p_cal, coalesce(l.p_calibrated, h.p_calibrated) as p_low_cal,
  h.source as cal_source, h.sample_size as cal_n, h.confidence as cal_conf, h.delta as cal_delta,
  coalesce(pa.delta, 0.0) as prior_delta, coalesce(pa.sample_size, 0) as prior_n, pa.hit_rate as prior_hit_rate,
  case when p.book_count >= 2 then 'A' else 'B' end as tier
from o_pick4 p join o_adj a using ({LINE})
join o_cal_in c on c.k = p.snapshot_id || '|' || p.event_id || '|' || p.market || '|' || p.player || '|' || p.point || '|' || p.strategy_id
left join o_fb_hit h on h.k = c.k left join o_fb_low l on l.k = c.k
left join o_padj pa on pa.as_of = c.as_of and pa.strategy_id = c.prior_source and pa.market = c.market and pa.side = c.side"""
CTES["o_cand1"] = """
select *, case
  when not event_mapped then 'event_mapping_missing'
  when injury_status in ('out', 'out_for_season') then 'injury_gate'
  when roster_status in ('inactive', 'not_on_roster', 'unknown_roster', 'unknown_event') then 'roster_gate'
  when tier = 'B' and not force_allow_tier_b then 'tier_b_blocked'
  when used = 'missing' and exclude_selected_book and book <> '' then 'baseline_insufficient_coverage_after_exclusion'
  when used = 'missing' then 'baseline_missing'
  when tier = 'B' and n_base_books < tier_b_min_other_books then 'tier_b_baseline_not_independent'
  when n_pairs < min_book_pairs then 'book_pairs_gate'
  when hold_cap is not null and hold_med is null then 'hold_missing'
  when hold_med > hold_cap then 'hold_cap'
  when p_over_iqr_cap is not null and iqr is null then 'dispersion_missing'
  when iqr > p_over_iqr_cap then 'dispersion_iqr'
  when quality < min_quality_score then 'quality_score_gate'
  when band > max_uncertainty_band then 'uncertainty_band_gate'
  when best_ev is null or best_ev < case when tier = 'A' then 0.03 else 0.05 end then 'ev_below_threshold'
  when min_ev_low is not null and ev_low is null then 'ev_low_missing'
  when ev_low < min_ev_low then 'ev_low_below_threshold'
  when probabilistic_profile = 'minutes_v1' and min_prob_confidence is not null and confidence_score is null then 'prob_confidence_missing'
  when probabilistic_profile = 'minutes_v1' and confidence_score < min_prob_confidence then 'prob_confidence_gate'
  when probabilistic_profile = 'minutes_v1' and max_minutes_band is not null and minutes_band is null then 'minutes_band_missing'
  when probabilistic_profile = 'minutes_v1' and minutes_band > max_minutes_band then 'minutes_band_gate'
  else '' end as reason,
  case when tier = 'A' then 0.03 else 0.05 end as target_roi,
  coalesce(nullif(best_ev, 0.0), -0.5) * 1000.0 + book_count * 5.0 + (over_delta + under_delta) / 10.0
    - coalesce(hold * 100.0, 20.0) as score_base
from o_cand0"""
CTES["o_odds_health"] = """
select *, case when latest is null then 'missing_last_update' when odds_stale then 'stale' else 'ok' end as status from (
  select *, coalesce(age_latest > 20, true) as odds_stale from (
    select h.*, (epoch(now_utc) - epoch(latest)) / 60.0 as age_latest, (epoch(now_utc) - epoch(oldest)) / 60.0 as age_oldest from (
      select snapshot_id, strategy_id, max(quote_time) as latest, min(quote_time) as oldest from o_cand1 group by 1, 2) h
    left join o_clock using (snapshot_id)))"""
CTES["o_gates"] = """
select h.snapshot_id, h.strategy_id, concat_ws(',',
  case when coalesce(not s.ready, true) then 'official_injury_missing' end, case when odds_stale then 'odds_snapshot_stale' end,
  case when s.ready is null then 'injuries_context_stale' end, case when s.ready is null then 'roster_context_stale' end) as gates
from o_odds_health h left join (select snapshot_id, count(*) filter (source = 'official') > 0 as ready from fx_injuries group by 1) s
  on s.snapshot_id = h.snapshot_id"""
CTES["o_cand2"] = """
select c.* replace (case when c.reason = '' and g.gates <> '' then 'health_gate:' || g.gates else c.reason end as reason)
from o_cand1 c join o_gates g on g.snapshot_id = c.snapshot_id and g.strategy_id = c.strategy_id"""
CTES["o_cand"] = f"""
select * exclude (side), side as recommended_side, reason = '' as eligible, score_base + prior_delta * 250.0 as score,
  injury_status in ('available', 'available_unlisted') and roster_status in ('active', 'rostered') as pre_bet_ready,
  round((1.0 + target_roi) / p_hit, 6) as play_to_decimal, {american("((1.0 + target_roi) / p_hit)")} as play_to_american,
  round(1.0 / p_hit, 6) as breakeven_decimal, {american("(1.0 / p_hit)")} as breakeven_american,
  round({ev("p_cal", "price")}, 6) as ev_calibrated, round({ev("p_low_cal", "price")}, 6) as ev_low_calibrated,
  case when used = 'median_book' then 'exact_point_pairs' when used = 'median_book_interpolated' then 'reference_curve'
    when used in ('best_sides', 'best_sides_fallback') then 'best_sides' when used = 'missing' then 'missing' else 'unknown' end as line_source,
  away_team || ' @ ' || home_team as game
from o_cand2"""

# Greedy portfolio replayed row by row over the full ranking.
CTES["o_rank"] = """
select snapshot_id, strategy_id, event_id, player_key, market, player, point, recommended_side,
  row_number() over (partition by snapshot_id, strategy_id order by
    -(case portfolio_ranking when 'best_ev' then coalesce(best_ev, -1.0)
      when 'calibrated_ev_low' then coalesce(ev_low, -1.0) * (1.0 - 0.3 * cal_conf) + coalesce(ev_low_calibrated, ev_low, -1.0) * (0.3 * cal_conf)
      when 'ev_low_quality_weighted' then coalesce(ev_low, -1.0) * (0.5 + 0.5 * quality)
      else coalesce(ev_low, -1.0) end + prior_delta * 0.25),
    -quality, -coalesce(best_ev, -1.0), age, event_id, player_key, market, point, recommended_side) as pos
from o_cand where eligible"""
CTES["o_greedy"] = """
select snapshot_id, strategy_id, 0 as pos, cast([] as varchar[]) as players, cast([] as varchar[]) as events, '' as reason
from (select distinct snapshot_id, strategy_id from o_rank)
union all
select g.snapshot_id, g.strategy_id, r.pos,
  case when len(g.players) < 5 and not list_contains(g.players, r.player_key) and len(list_filter(g.events, lambda e: e = r.event_id)) < 2
    then list_append(g.players, r.player_key) else g.players end,
  case when len(g.players) < 5 and not list_contains(g.players, r.player_key) and len(list_filter(g.events, lambda e: e = r.event_id)) < 2
    then list_append(g.events, r.event_id) else g.events end,
  case when len(g.players) >= 5 then 'portfolio_cap_daily' when list_contains(g.players, r.player_key) then 'portfolio_cap_player'
    when len(list_filter(g.events, lambda e: e = r.event_id)) >= 2 then 'portfolio_cap_game' else '' end
from o_greedy g join o_rank r on r.snapshot_id = g.snapshot_id and r.strategy_id = g.strategy_id and r.pos = g.pos + 1"""
CTES["o_port"] = """
select r.*, g.reason as portfolio_reason, g.reason = '' as portfolio_selected,
  case when g.reason = '' then cast(len(g.players) as integer) end as portfolio_rank
from o_rank r join o_greedy g using (snapshot_id, strategy_id, pos)"""

_NAME = re.compile(r"\b(?:o|fx)_\w+\b")


def query(final: str) -> str:
    """``final`` with every CTE it needs in front."""
    order: list[str] = []

    def visit(text: str, stack: tuple[str, ...]) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in CTES and name not in order and name not in stack:
                visit(CTES[name], (*stack, name))
                order.append(name)

    visit(final, ())
    if not order:
        return _doubles(final)
    # A CTE used by several others is computed once.
    body = ",\n".join(f"{name} as materialized ({CTES[name]})" for name in order)
    word = "with recursive" if "o_greedy" in order else "with"
    body = body.replace("o_greedy as materialized", "o_greedy as")
    return _doubles(f"{word} {body}\n{final}")


def _doubles(sql: str) -> str:
    """Decimal literals as doubles, and the same rounding of halves as the Spark side."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql).replace(", 6)", " + 1e-12, 6)")
