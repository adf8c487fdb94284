"""Queries over the running of reports: plans and their contract, selections, health, rosters, datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.operators import completeness, execution_plan, readiness, rosters
from oddsloom.plans import bindings as b
from oddsloom.plans.catalog import candidates_stage, portfolio_stage, r6, raw_candidates_stage, register, selected_stage
from oddsloom.plans.oracles import CTES
from oddsloom.plans.queries_reports import CAND, CAND_SQL, ORDER
from oddsloom.sources import resources

# --- selections and plans ---------------------------------------------------------------

_TOP = (
    "select {mode} as selection, snapshot_id, strategy_id, event_id, market, player, point, cast(rn as integer) as position from "
    "(select *, row_number() over (partition by snapshot_id, strategy_id order by {order}) as rn from {rows}) where rn <= {n}"
)
CTES["o_modes"] = " union all ".join(
    [
        _TOP.format(mode="'eligible'", order=ORDER, rows="o_cand where eligible", n=3),
        _TOP.format(mode="'all'", order=f"not eligible, {ORDER}", rows="o_cand", n=3),
        _TOP.format(mode="'ranked'", order="portfolio_rank", rows="o_sel where portfolio_selected", n=3),
        _TOP.format(mode="'top_ev'", order="portfolio_rank", rows="o_sel where portfolio_selected and tier = 'A'", n=3),
        _TOP.format(mode="'one_source'", order="portfolio_rank", rows="o_sel where portfolio_selected and tier = 'B'", n=3),
    ]
)


@register("ticket_selections", f"selection {CAND} position", f"select selection, {CAND_SQL}, position from o_modes")
def ticket_selections(spark, sf):
    out = None
    for mode in execution_plan.SELECTIONS:
        rows = candidates_stage(spark, sf) if mode in ("eligible", "all") else selected_stage(spark, sf)
        part = execution_plan.select_rows(rows, mode, 3).select(
            F.lit(mode).alias("selection"), *CAND.split(), "position"
        )
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "portfolio_watchlist", f"{CAND} position portfolio_reason",
    f"select {CAND_SQL}, cast(rn as integer) as position, portfolio_reason from (select *, row_number() over (partition by snapshot_id, strategy_id "
    "order by pos) as rn from o_port where not portfolio_selected) where rn <= 25",
)
def portfolio_watchlist(spark, sf):
    return execution_plan.portfolio_watchlist(portfolio_stage(spark, sf))


_PLAN_ORDER = "coalesce(portfolio_rank, 0), event_id, market, player, recommended_side, point, book, coalesce(price, 0)"


@register(
    "execution_plan",
    "snapshot_id strategy_id part position event_id game player market side point tier selected_book selected_price_american "
    "play_to_american best_ev ev_low quality_score historical_prior_delta historical_prior_sample_size portfolio_reason portfolio_rank",
    "select snapshot_id, strategy_id, case when portfolio_selected then 'selected' else 'excluded' end as part, cast(row_number() over (partition by "
    f"snapshot_id, strategy_id, portfolio_selected order by {_PLAN_ORDER}) as integer) as position, event_id, game, player, market, recommended_side as side, "
    "point, tier, book as selected_book, cast(price as integer) as selected_price_american, play_to_american, best_ev, ev_low, "
    f"{r6('quality_score=quality historical_prior_delta=prior_delta')}, prior_n as historical_prior_sample_size, portfolio_reason, "
    "coalesce(portfolio_rank, 0) as portfolio_rank from o_sel",
)
def plan(spark, sf):
    return execution_plan.plan_rows(portfolio_stage(spark, sf))


# Some plans are spoilt, each in a way that one rule of the contract finds.
CTES["o_spoilt"] = """
select snapshot_id, strategy_id, portfolio_selected as sel, player_key, event_id,
  case when strategy_id = 's003' and portfolio_selected then 1 when strategy_id = 's004' and portfolio_selected then 0
    when portfolio_selected then portfolio_rank else 0 end as rank,
  case when strategy_id = 's005' and portfolio_selected then 'why' when strategy_id = 's006' and not portfolio_selected then '' else portfolio_reason end as reason
from o_sel"""
CTES["o_plan_facts"] = """
select snapshot_id, strategy_id, count(*) filter (sel) as n_sel, count(*) filter (not sel) as n_exc,
  count(*) filter (sel and rank > 0) as ranked, count(distinct case when sel and rank > 0 then rank end) as ranks,
  coalesce(bool_or(sel and trim(reason) <> ''), false) as reasoned, coalesce(bool_or(not sel and trim(reason) = ''), false) as unreasoned
from o_spoilt group by 1, 2"""
CTES["o_plan_most"] = """
select p.snapshot_id, p.strategy_id, max(p.n) as of_player, max(g.n) as of_game from
  (select snapshot_id, strategy_id, player_key, count(*) as n from o_spoilt where sel group by 1, 2, 3) p
  join (select snapshot_id, strategy_id, event_id, count(*) as n from o_spoilt where sel group by 1, 2, 3) g
    on g.snapshot_id = p.snapshot_id and g.strategy_id = p.strategy_id group by 1, 2"""


@register(
    "execution_plan_contract", "snapshot_id strategy_id errors",
    "select f.snapshot_id, f.strategy_id, array_to_string(list_sort(list_filter(["
    "case when n_sel > (case when f.strategy_id = 's007' then 1 else 5 end) then 'selected_exceeds_max_picks' end, "
    "case when f.strategy_id = 's008' then 'selected_count_mismatch' end, case when f.strategy_id = 's009' then 'excluded_count_mismatch' end, "
    "case when ranked < n_sel then 'selected_rank_missing' end, case when ranks < ranked then 'selected_rank_duplicate' end, "
    "case when reasoned then 'selected_has_portfolio_reason' end, case when unreasoned then 'excluded_missing_portfolio_reason' end, "
    "case when coalesce(of_player, 0) > 1 then 'selected_exceeds_player_cap' end, "
    "case when coalesce(of_game, 0) > (case when f.strategy_id = 's010' then 1 else 2 end) then 'selected_exceeds_game_cap' end], lambda x: x is not null)), ',') as errors "
    "from o_plan_facts f left join o_plan_most m on m.snapshot_id = f.snapshot_id and m.strategy_id = f.strategy_id",
)
def plan_contract(spark, sf):
    chosen = portfolio_stage(spark, sf)
    strategy, selected = F.col("strategy_id"), F.col("part") == "selected"
    rows = execution_plan.plan_rows(chosen).withColumns(
        {
            "portfolio_rank": F.when(selected & (strategy == "s003"), 1)
            .when(selected & (strategy == "s004"), 0)
            .otherwise(F.col("portfolio_rank")),
            "portfolio_reason": F.when(selected & (strategy == "s005"), "why")
            .when(~selected & (strategy == "s006"), "")
            .otherwise(F.col("portfolio_reason")),
        }
    )
    headers = chosen.groupBy("snapshot_id", "strategy_id").agg(
        (F.count_if("portfolio_selected") + F.max(F.when(strategy == "s008", 1).otherwise(0))).alias("selected_lines"),
        (F.count_if(~F.col("portfolio_selected")) + F.max(F.when(strategy == "s009", 1).otherwise(0))).alias("excluded_lines"),
    ).withColumns(
        {
            "max_picks": F.when(strategy == "s007", 1).otherwise(5),
            "max_per_player": F.lit(1),
            "max_per_game": F.when(strategy == "s010", 1).otherwise(2),
        }
    )
    return execution_plan.plan_errors(rows, headers)


# --- health -----------------------------------------------------------------------------

_DAY = "cast(right(snapshot_id, 2) as integer)"
_HDAY = "cast(right(h.snapshot_id, 2) as integer)"
CTES["o_facts"] = f"""
select h.snapshot_id, official_rows > 0 and {_HDAY} % 4 <> 0 as official_ready, secondary_rows > 0 and {_HDAY} % 3 <> 0 as secondary_ready,
  {_HDAY} % 7 = 1 as injuries_stale, {_HDAY} % 9 = 2 as roster_stale, {_HDAY} % 10 as roster_teams, {_HDAY} % 5 = 0 as lacking, {_HDAY} % 10 = 0 as covered,
  coalesce(unknown_rosters, 0) as unknown_rosters, coalesce(unknown_events, 0) as unknown_events, coalesce(missing_injuries, 0) as missing_injuries
from o_health h left join (select snapshot_id, count(*) filter (roster_status = 'unknown_roster') as unknown_rosters,
  count(*) filter (roster_status = 'unknown_event') as unknown_events, count(*) filter (injury_status = 'unknown') as missing_injuries
  from o_cand1 where strategy_id = 's001' group by 1) c on c.snapshot_id = h.snapshot_id"""
CTES["o_gated"] = """
select *, list_filter([case when not official_ready and not (secondary_ready and not official_ready) then 'injury_source_failed' end,
    case when not (roster_teams > 0 and (not lacking or covered)) then 'roster_source_failed' end,
    case when unknown_events > 0 then 'event_mapping_failed' end], lambda x: x is not null) as broken,
  list_filter([case when injuries_stale or roster_stale then 'stale_inputs' end, case when unknown_rosters > 0 then 'unknown_roster_detected' end,
    case when lacking then 'roster_fallback_used' end, case when secondary_ready and not official_ready then 'official_injury_secondary_override' end,
    case when roster_stale then 'roster_context_stale' end], lambda x: x is not null) as degraded
from o_facts"""
CTES["o_checked"] = """
select snapshot_id, case when len(broken) > 0 then 'broken' when len(degraded) > 0 then 'degraded' else 'healthy' end as status,
  list_concat(broken, degraded) as gates, injuries_stale::integer + roster_stale::integer as stale_inputs, missing_injuries from o_gated"""


def _facts(spark, sf):
    day = F.expr("int(right(snapshot_id, 2))")
    rows = raw_candidates_stage(spark, sf).where(F.col("strategy_id") == "s001").groupBy("snapshot_id").agg(
        F.count_if(F.col("roster_status") == "unknown_roster").alias("unknown_rosters"),
        F.count_if(F.col("roster_status") == "unknown_event").alias("unknown_events"),
        F.count_if(F.col("injury_status") == "unknown").alias("missing_injuries"),
    )
    sources = b.injuries(spark, sf).groupBy("snapshot_id").agg(
        F.count_if(F.col("source") == "official").alias("o"), F.count_if(F.col("source") == "secondary").alias("s")
    )
    lacking = day % 5 == 0
    return sources.join(rows, "snapshot_id", "left").na.fill(0).withColumns(
        {
            "official_ready": (F.col("o") > 0) & (day % 4 != 0),
            "secondary_ready": (F.col("s") > 0) & (day % 3 != 0),
            "injuries_stale": day % 7 == 1,
            "roster_stale": day % 9 == 2,
            "odds_stale": F.lit(False),
            "roster_status": F.lit("ok"),
            "roster_teams": day % 10,
            "missing_roster_teams": F.when(lacking, 2).otherwise(0),
            "fallback_status": F.when(lacking, "ok"),
            "fallback_teams": F.when(day % 10 == 0, 2).otherwise(1),
            "missing_mappings": F.lit(0),
            "invalid_rows": F.lit(0),
            "report_gates": F.when(day % 9 == 2, F.array(F.lit("roster_context_stale"))),
        }
    )


@register(
    "health_checks", "snapshot_id status exit_code gates stale_inputs missing_injuries",
    "select snapshot_id, status, case status when 'broken' then 2 when 'degraded' then 1 else 0 end as exit_code, array_to_string(gates, ',') as gates, "
    "stale_inputs, missing_injuries from o_checked",
)
def health_checks(spark, sf):
    return readiness.health_checks(_facts(spark, sf), allow_secondary=True)


@register(
    "health_recommendations", "snapshot_id advice",
    "select snapshot_id, array_to_string(list_concat(case status when 'broken' then ['hold_picks', 'rebuild_context'] "
    "when 'degraded' then ['watchlist_only', 'check_source_freshness'] else ['proceed'] end, "
    "list_filter([case when stale_inputs > 0 then 'refresh_stale_inputs' end, case when list_contains(gates, 'roster_fallback_used') then 'watch_roster_source' end, "
    "case when list_contains(gates, 'official_injury_secondary_override') then 'watch_injury_source' end, case when missing_injuries > 0 then 'review_missing_injuries' end], "
    "lambda x: x is not null)), ' ') as advice from o_checked",
)
def health_recommendations(spark, sf):
    checked = readiness.health_checks(_facts(spark, sf), allow_secondary=True)
    advice = readiness.recommendations(
        F.col("status"), F.col("gates"), F.col("missing_injuries"), F.col("stale_inputs")
    )
    return checked.select("snapshot_id", F.array_join(advice, " ").alias("advice"))


@register(
    "preflight_gates", "snapshot_id gates",
    "select snapshot_id, array_to_string(list_filter([case when not official_ready then 'official_injury_missing' end, "
    "case when injuries_stale then 'injuries_context_stale' end, case when roster_stale then 'roster_context_stale' end], lambda x: x is not null), ',') as gates from o_facts",
)
def preflight_gates(spark, sf):
    return readiness.preflight_gates(_facts(spark, sf))


# --- requests, artefacts, datasets, days ------------------------------------------------

_REQ_STATUS = "case o_orderkey % 5 when 0 then 'ok' when 1 then 'cached' when 2 then 'error' when 3 then ' ' end"
_SNAP = b.EVENT_CONTEXT["snapshot_id"]


def _requests(spark, sf):
    return b.table(spark, sf, "orders").selectExpr(
        f"{_SNAP} as snapshot_id", "concat('r', o_orderkey) as request_key", f"{_REQ_STATUS} as status", "o_orderkey"
    )


@register(
    "request_histogram", "snapshot_id status requests",
    f"select {_SNAP} as snapshot_id, coalesce(nullif(trim({_REQ_STATUS}), ''), 'unknown') as status, count(*) as requests from orders group by 1, 2",
)
def request_histogram(spark, sf):
    return readiness.request_histogram(_requests(spark, sf))


@register(
    "missing_artefacts", "snapshot_id request_key missing",
    f"select {_SNAP} as snapshot_id, 'r' || o_orderkey as request_key, array_to_string(list_filter([case when o_orderkey % 3 = 0 then 'request' end, "
    "case when o_orderkey % 4 = 0 then 'response' end, case when o_orderkey % 6 = 0 then 'meta' end], lambda x: x is not null), ',') as missing from orders "
    "where o_orderkey % 3 = 0 or o_orderkey % 4 = 0",
)
def missing_artefacts(spark, sf):
    requests = _requests(spark, sf)
    kinds = F.array_compact(
        F.array(*[F.when(F.col("o_orderkey") % n != 0, k) for k, n in (("request", 3), ("response", 4), ("meta", 6))])
    )
    return readiness.missing_artefacts(
        requests, requests.select("snapshot_id", "request_key", F.explode(kinds).alias("kind"))
    )


CTES["o_days"] = "select day, 'd' || cast(extract(month from day) % 3 as varchar) as dataset_id, missing_count = 0 and error = '' and note = '' as complete from fx_day_status"


def _days(spark, sf):
    return b.day_status(spark, sf).select(
        "day",
        F.concat(F.lit("d"), (F.month("day") % 3).cast("string")).alias("dataset_id"),
        ((F.col("missing_count") == 0) & (F.col("error") == "") & (F.col("note") == "")).alias("complete"),
    )


@register(
    "dataset_list", "dataset_id day_count complete_count from_day to_day",
    "select dataset_id, count(*) as day_count, count(*) filter (complete) as complete_count, cast(min(day) as varchar) as from_day, cast(max(day) as varchar) as to_day from o_days group by 1",
)
def dataset_list(spark, sf):
    return readiness.dataset_list(_days(spark, sf))


# Days of the season are those with quotes or orders; the stored snapshot id of a day comes from its orders, blank or
# beyond the known ones on some days. Quotes of one discount and quantity lost their player.
_ISSUE_PLAYER = f"case when l_quantity = 50 and l_discount = 0.1 and l_linenumber < 3 then ' ' else {b.QUOTES['player']} end"
_ISSUE_QUOTES = {c: b.QUOTES[c] for c in "snapshot_id event_id market point side book price".split()} | {"player": _ISSUE_PLAYER}
_STORED_SNAPSHOT = (
    "case when count(*) % 7 = 3 then ' ' else concat('day-main-', "
    f"cast(date '2024-01-01' + cast(floor(max(o_orderkey) / {b.ORDERS_PER_SNAPSHOT}.0) + 20 * (count(*) % 2) as int) as string)) end"
)
CTES["o_issue_quotes"] = f"select {b._select_list(_ISSUE_QUOTES)} from lineitem"
CTES["o_issue_codes"] = """
select snapshot_id, 'invalid_rows' as code from o_issue_quotes where trim(player) = '' group by 1 union all
select snapshot_id, 'repeated_rows' from (select snapshot_id, event_id, market, player, point, side, book, price from o_issue_quotes group by all having count(*) > 1) group by 1"""
CTES["o_issue_days"] = f"""
select d.day, s.day is null as absent, coalesce(s.missing_count = 0 and s.error = '' and s.note = '', false) as complete, trim(i.snapshot_id) as snapshot_id,
  case when s.day is null then 'missing_day_status' else r.reason end as reason
from (select l_shipdate::date as day from lineitem union select o_orderdate::date from orders) d left join fx_day_status s on s.day = d.day
left join (select o_orderdate::date as day, {_STORED_SNAPSHOT} as snapshot_id from orders group by 1) i on i.day = d.day
left join o_ds0 r on r.day = d.day"""


@register(
    "contract_issues", "day complete reason codes issue_count ok",
    "select day::varchar as day, complete, case when not complete then reason end as reason, array_to_string(codes, ',') as codes, len(codes)::integer as issue_count, len(codes) = 0 as ok from (select d.*, list_concat(list_filter(["
    "case when absent then 'missing_day_status' end, case when not complete and reason <> 'missing_event_odds' and day <> date '1995-03-15' then 'incomplete_day' end, "
    "case when complete and d.snapshot_id = '' then 'missing_snapshot_id' end, case when complete and d.snapshot_id <> '' and d.snapshot_id not in (select snapshot_id from o_issue_quotes) then 'missing_snapshot' end], lambda x: x is not null), "
    "case when complete then coalesce(c.codes, []) else [] end) as codes from o_issue_days d left join (select snapshot_id, list(code order by code) as codes from o_issue_codes group by 1) c on c.snapshot_id = d.snapshot_id)",
)
def contract_issues(spark, sf):
    orders = b.table(spark, sf, "orders")
    quotes = b.table(spark, sf, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _ISSUE_QUOTES.items()])
    stored = orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.expr(_STORED_SNAPSHOT).alias("snapshot_id"))
    status = completeness.canonical_status(b.day_status(spark, sf)).join(stored, "day")
    days = b.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).union(
        orders.select(F.col("o_orderdate").cast("date"))
    )
    return readiness.day_issues(
        days, status, quotes.select("snapshot_id"), readiness.table_issues(quotes),
        allowed_days=("1995-03-15",), allowed_reasons=("missing_event_odds",),
    )


@register(
    "stored_else_computed", "day total_events missing_count status_source",
    "select cast(day as varchar) as day, case when day_of_month % 2 = 0 then total_events + 1 else total_events end as total_events, missing_count, "
    "case when day_of_month % 2 = 0 then 'stored' else 'computed' end as status_source from (select *, extract(day from day) as day_of_month from fx_day_status)",
)
def stored_else_computed(spark, sf):
    computed = b.day_status(spark, sf).select("day", "total_events", "missing_count")
    stored = computed.where(F.dayofmonth("day") % 2 == 0).withColumn("total_events", F.col("total_events") + 1)
    return readiness.stored_else_computed(stored, computed.where(F.dayofmonth("day") % 3 != 0).unionByName(
        computed.where((F.dayofmonth("day") % 3 == 0) & (F.dayofmonth("day") % 2 != 0))
    ))


@register(
    "complete_days", "day snapshot_id latest",
    "select day::varchar as day, snapshot_id, (select max(snapshot_id) from o_issue_quotes) as latest from o_issue_days where complete and snapshot_id <> ''",
)
def complete_days(spark, sf):
    orders = b.table(spark, sf, "orders")
    stored = orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.expr(_STORED_SNAPSHOT).alias("snapshot_id"))
    done = readiness.complete_days(completeness.canonical_status(b.day_status(spark, sf)).join(stored, "day"))
    latest = readiness.latest_snapshot(b.quotes(spark, sf)).withColumnRenamed("snapshot_id", "latest")
    return done.crossJoin(F.broadcast(latest))  # one row


@register(
    "backtest_readiness", "snapshot_id props_rows seed_rows featured_rows injuries_status roster_status results_status missing ready",
    f"select *, missing = '' as ready from (select snapshot_id, props_rows, seed_rows, featured_rows, injuries_status, roster_status, 'missing' as results_status, "
    "array_to_string(list_filter([case when seed_rows = 0 then 'seed_rows' end, case when props_rows = 0 then 'props_rows' end, case when injuries_status <> 'ok' then 'injuries_status' end, "
    "case when roster_status <> 'ok' then 'roster_status' end, 'results_status'], lambda x: x is not null), ',') as missing from (select q.snapshot_id, q.n as props_rows, coalesce(p.n, 0) as seed_rows, "
    "coalesce(s.n, 0) as featured_rows, coalesce(i.status, 'missing') as injuries_status, coalesce(r.status, 'missing') as roster_status from (select snapshot_id, count(*) as n from fx_quotes group by 1) q "
    "left join (select snapshot_id, count(*) as n from o_sel where portfolio_selected group by 1) p on p.snapshot_id = q.snapshot_id left join (select snapshot_id, count(*) as n from fx_slate group by 1) s "
    f"on s.snapshot_id = q.snapshot_id left join (select snapshot_id, case when {_DAY} % 4 = 0 then 'error' else 'ok' end as status from fx_injuries group by 1) i on i.snapshot_id = q.snapshot_id "
    "left join (select snapshot_id, 'ok' as status from fx_roster group by 1) r on r.snapshot_id = q.snapshot_id))",
)
def backtest_readiness(spark, sf):
    day = F.expr("int(right(snapshot_id, 2))")
    contexts = b.injuries(spark, sf).select("snapshot_id").distinct().select(
        "snapshot_id", F.lit("injuries").alias("kind"), F.when(day % 4 == 0, "error").otherwise("ok").alias("status")
    ).unionByName(
        b.roster(spark, sf).select("snapshot_id").distinct().select(
            "snapshot_id", F.lit("roster").alias("kind"), F.lit("ok").alias("status")
        )
    )
    props = b.quotes(spark, sf)
    seeds = selected_stage(spark, sf)
    # Snapshots that have quotes; contexts of others have nothing to test.
    known = props.select("snapshot_id").distinct()
    return readiness.backtest_readiness(seeds, props, b.slate(spark, sf), contexts).join(known, "snapshot_id", "left_semi")


# --- rosters, injuries, results, event context ------------------------------------------

_STATUS_OF = "case when player_number % 4 = 0 then 'Inactive' when player_number % 4 = 1 then 'ACTIVE' else '' end"
CTES["o_rp"] = """
select snapshot_id, event_id, player, replace(replace(lower(player), ' ', ''), '.', '') as member, 'team ' || cast(length(player) % 5 as varchar) as team,
  (cast(right(event_id, 1) as integer) + length(player)) % 3 = 0 as inactive from fx_results"""


def _result_players(spark, sf):
    rows = b.results(spark, sf)
    inactive = (F.right("event_id", F.lit(1)).cast("int") + F.length("player")) % 3 == 0
    return rows.select(
        "snapshot_id", "event_id", "player",
        F.concat(F.lit("Team "), (F.length("player") % 5).cast("string")).alias("team"),
        F.when(inactive, " Inactive ").otherwise("ACTIVE").alias("status"),
    )


@register(
    "rosters_from_results", "snapshot_id team active inactive members games",
    "select coalesce(g.snapshot_id, m.snapshot_id) as snapshot_id, coalesce(g.team, m.team) as team, coalesce(active, '') as active, coalesce(inactive, '') as inactive, "
    "coalesce(members, '') as members, coalesce(games, 0) as games from (select snapshot_id, team, cast(count(distinct event_id) as integer) as games from (select snapshot_id, event_id, home_team as team from fx_context "
    "union all select snapshot_id, event_id, away_team from fx_context) group by 1, 2) g full join (select snapshot_id, team, array_to_string(list_sort(list(distinct member) filter (not inactive)), ',') as active, "
    "array_to_string(list_sort(list(distinct member) filter (inactive)), ',') as inactive, array_to_string(list_sort(list(distinct member)), ',') as members from o_rp group by 1, 2) m "
    "on m.snapshot_id = g.snapshot_id and m.team = g.team",
)
def rosters_from_results(spark, sf):
    games = b.event_context(spark, sf).select("snapshot_id", F.col("event_id").alias("game_id"), "home_team", "away_team")
    found = rosters.rosters_from_results(games, _result_players(spark, sf))
    return found.withColumn("games", F.size("game_ids"))


@register(
    "injuries_from_results", "snapshot_id player team_norm status rows",
    "select snapshot_id, player, team as team_norm, case when inactive then 'out' else 'available' end as status, count(*) as rows from o_rp group by all",
)
def injuries_from_results(spark, sf):
    keys = ["snapshot_id", "player", "team_norm", "status"]
    return rosters.injuries_from_results(_result_players(spark, sf)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


CTES["o_unlikely"] = "select distinct snapshot_id, replace(lower(player), ' ', '') as member from fx_injuries where status in ('out', 'out_for_season', 'doubtful')"
CTES["o_feed"] = """
select r.snapshot_id, r.team, array_to_string(list_sort(list(distinct r.member) filter (u.member is null)), ',') as active,
  array_to_string(list_sort(list(distinct r.member) filter (u.member is not null)), ',') as inactive, array_to_string(list_sort(list(distinct r.member)), ',') as members
from (select snapshot_id, team, replace(lower(player), ' ', '') as member from fx_roster) r
left join o_unlikely u on u.snapshot_id = r.snapshot_id and u.member = r.member group by 1, 2"""


@register(
    "roster_fallback", "snapshot_id team active inactive members roster_source",
    "select snapshot_id, team, coalesce(active, '') as active, coalesce(inactive, '') as inactive, members, case when team in ('team 1', 'team 3') then 'fallback' else 'primary' end as roster_source from o_feed",
)
def roster_fallback(spark, sf):
    """Two teams are missing from the primary feed; every team is in the fallback."""
    feed = rosters.feed_rosters(b.roster(spark, sf), b.injuries(spark, sf))
    primary = feed.where(~F.col("team").isin("team 1", "team 3"))
    return rosters.with_fallback(primary, feed, feed.select("snapshot_id", "team"))


@register(
    "secondary_source", "snapshot_id source rows",
    f"select snapshot_id, source, count(*) as rows from fx_injuries where source = case when {_DAY} % 2 = 0 then 'official' when {_DAY} % 3 <> 0 then 'secondary' end group by 1, 2",
)
def secondary_source(spark, sf):
    """Two sources in order; the first fails on odd days, the second on every third."""
    rows = b.injuries(spark, sf)
    day = F.expr("int(right(snapshot_id, 2))")
    snapshots = rows.select("snapshot_id").distinct()
    sources = snapshots.select(
        "snapshot_id", F.lit("official").alias("source"), F.lit(1).alias("priority"), F.when(day % 2 == 0, "ok").otherwise("error").alias("status")
    ).unionByName(
        snapshots.select(
            "snapshot_id", F.lit("secondary").alias("source"), F.lit(2).alias("priority"), F.when(day % 3 != 0, "ok").otherwise("error").alias("status")
        )
    )
    return rosters.first_ready(sources, rows).groupBy("snapshot_id", "source").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "last_event_context", "snapshot_id event_id home_team",
    f"select snapshot_id, event_id, arg_max('h' || o_orderkey, o_orderkey) as home_team from (select o_orderkey, {_SNAP} as snapshot_id, {b.EVENT_CONTEXT['event_id']} as event_id from orders) group by 1, 2",
)
def last_event_context(spark, sf):
    responses = b.table(spark, sf, "orders").selectExpr(
        f"{_SNAP} as snapshot_id", f"{b.EVENT_CONTEXT['event_id']} as event_id", "o_orderkey as request_order", "concat('h', o_orderkey) as home_team"
    )
    return rosters.last_event_context(responses)


# Responses of seven shapes: a list of events, the slate with items that name none, odds of one event, these three in the
# wrong shape or under another label, and an event with a number for an id.
_CONTEXT_LABEL = (
    "case o_orderkey % 7 when 0 then 'events_list' when 1 then 'slate_odds' when 4 then 'events_list' when 5 then 'events' "
    "else concat('event_odds:', o_orderkey % 10) end"
)
_CONTEXT_FIRST = (
    "concat('{\"id\": \"e', o_orderkey % 10, '\", \"home_team\": \"h', o_orderkey, '\", \"away_team\": \"a', o_custkey, "
    "'\", \"commence_time\": \"', cast(cast(o_orderdate as date) as string), '\"}')"
)
_CONTEXT_SECOND = "concat('{\"id\": \"e', (o_orderkey + 3) % 10, '\", \"home_team\": \"second', o_orderkey, '\", \"away_team\": null}')"
_CONTEXT_BODY = (
    f"case o_orderkey % 7 when 0 then concat('[', {_CONTEXT_FIRST}, ', ', {_CONTEXT_SECOND}, ']') when 1 then concat('[', {_CONTEXT_FIRST}, ', 5, {{\"id\": \"\"}}, [], {{}}]') "
    f"when 2 then {_CONTEXT_FIRST} when 3 then concat('[', {_CONTEXT_FIRST}, ']') when 4 then {_CONTEXT_FIRST} when 5 then {_CONTEXT_FIRST} "
    "else concat('{\"id\": ', 100 + o_orderkey % 10, ', \"home_team\": \"n', o_orderkey, '\"}') end"
)
CTES["o_named_events"] = f"""
select {_SNAP} as snapshot_id, o_orderkey * 10 as place, case when o_orderkey % 7 < 3 then 'e' || (o_orderkey % 10) else (100 + o_orderkey % 10)::varchar end as event_id,
  case when o_orderkey % 7 < 3 then 'h' else 'n' end || o_orderkey as home_team, case when o_orderkey % 7 < 3 then 'a' || o_custkey else '' end as away_team,
  case when o_orderkey % 7 < 3 then o_orderdate::date::varchar else '' end as commence_time from orders where o_orderkey % 7 < 3 or o_orderkey % 7 = 6
union all select {_SNAP}, o_orderkey * 10 + 1, 'e' || ((o_orderkey + 3) % 10), 'second' || o_orderkey, '', '' from orders where o_orderkey % 7 = 0"""


@register(
    "event_context_payloads", "snapshot_id event_id home_team away_team commence_time",
    "select snapshot_id, event_id, arg_max(home_team, place) as home_team, arg_max(away_team, place) as away_team, arg_max(commence_time, place) as commence_time "
    "from o_named_events group by 1, 2",
)
def event_context_payloads(spark, sf):
    return resources.event_context(
        b.table(spark, sf, "orders").selectExpr(
            f"{_SNAP} as snapshot_id", "o_orderkey as request_order", f"{_CONTEXT_LABEL} as label", f"{_CONTEXT_BODY} as body"
        )
    )


@register(
    "game_results", "snapshot_id game_id players error",
    "select c.snapshot_id, c.event_id as game_id, coalesce(n, 0) as players, case when n is not null then '' when cast(right(c.event_id, 1) as integer) = 3 then 'timeout' else 'boxscore_missing' end as error "
    "from (select distinct snapshot_id, event_id from fx_context) c left join (select snapshot_id, event_id, count(*) as n from fx_results where cast(right(event_id, 1) as integer) % 3 <> 0 group by 1, 2) r "
    "on r.snapshot_id = c.snapshot_id and r.event_id = c.event_id",
)
def game_results(spark, sf):
    games = b.event_context(spark, sf).select("snapshot_id", F.col("event_id").alias("game_id")).distinct()
    digit = F.right("event_id", F.lit(1)).cast("int")
    players = b.results(spark, sf).where(digit % 3 != 0).withColumnRenamed("event_id", "game_id")
    failed = games.where(F.right("game_id", F.lit(1)) == "3").withColumn("error", F.lit("timeout"))
    return rosters.game_results(games, players, failed)


# --- resources --------------------------------------------------------------------------


def _resource_bodies(spark, sf):
    """Events as payloads of nine shapes: lists under each key, empty ones, a list of the other resource's key, one object,
    own ids, a list at the top, and no JSON."""
    item = "concat('{{\"eventnum\": \"', event_id{n}, '\", \"teamId\": \"t', user_id % 5, '\"{game}}}')"
    one, two = item.format(n="", game=""), item.format(n=" + 1", game=", \"game_id\": \"own\"")
    blank = item.format(n=" + 2", game=", \"game_id\": null")
    body = (
        f"case event_id % 9 when 0 then concat('[', {one}, ',', {two}, ', 3, [1]]') when 1 then concat('{{\"events\": [', {one}, ', 7]}}') "
        f"when 2 then concat('{{\"events\": [], \"data\": [', {one}, ',', {two}, ']}}') when 3 then concat('{{\"possessions\": [', {two}, ']}}') "
        f"when 4 then concat('{{\"data\": [', {blank}, ']}}') when 5 then concat('{{\"events\": \"none\", \"data\": [', {one}, ']}}') "
        f"when 6 then concat(' ', {two}) when 7 then '7' else '{{broken' end"
    )
    return b.table(spark, sf, "events").selectExpr(
        "concat('g', event_id) as game_id", f"{_RESOURCE_OF} as resource", f"{body} as body"
    )


_RESOURCE_OF = "case user_id % 3 when 0 then 'enhanced_pbp' when 1 then 'possessions' else 'boxscore' end"
# Which items a body gives (0: plain, 1: own id, 2: null id); 9: the whole object, whose fields are not those of an event.
_KINDS = """case event_id % 9 when 0 then [0, 1] when 1 then case r when 'enhanced_pbp' then [0] else [9] end
  when 2 then case r when 'enhanced_pbp' then [] else [0, 1] end when 3 then case r when 'possessions' then [1] else [9] end
  when 4 then [2] when 5 then [0] when 6 then [1] else [] end"""


@register(
    "resource_rows", "game_id event_num team_id",
    "select case k when 1 then 'own' when 2 then '' else 'g' || e end as game_id, case when k < 9 then cast(e + k as varchar) else '' end as event_num, "
    f"case when k < 9 then t else '' end as team_id from (select event_id as e, 't' || (user_id % 5) as t, unnest({_KINDS}) as k from (select *, {_RESOURCE_OF} as r from events))",
)
def resource_rows(spark, sf):
    rows = resources.resource_rows(_resource_bodies(spark, sf))
    filled = resources.aliased(rows, resources.EVENT_ALIASES, ("game_id",))
    return filled.na.fill("", ["event_num", "team_id"])


@register(
    "day_range", "o_orderpriority day",
    "select o_orderpriority, cast(cast(unnest(generate_series(f, t, interval 1 day)) as date) as varchar) as day from "
    "(select o_orderpriority, cast(min(o_orderdate) as date) as f, cast(min(o_orderdate) as date) + cast(count(*) % 40 as integer) as t from orders group by 1)",
)
def day_range(spark, sf):
    first = F.min(F.col("o_orderdate").cast("date"))
    ranges = b.table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        first.alias("from_day"), F.date_add(first, (F.count(F.lit(1)) % 40).cast("int")).alias("to_day")
    )
    return resources.day_range(ranges)


_OLD = resources.RequestSpec(
    "basketball_nba", ("b", "a", "b"), "y,x", include_links=True, historical=True, anchor_hour=30
)
_NEW = resources.RequestSpec("basketball_nba", ("b", "a"), None, "us,eu", include_sids=True)


@register(
    "expected_requests", "event_id path markets odds_format date_format bookmakers regions include_links include_sids date",
    "select event_id, '/historical/sports/basketball_nba/events/' || event_id || '/odds' as path, 'a,b' as markets, 'american' as odds_format, 'iso' as date_format, "
    "'y,x' as bookmakers, cast(null as varchar) as regions, 'true' as include_links, cast(null as varchar) as include_sids, "
    "strftime(commence_time, '%Y-%m-%dT%H:%M:%SZ') as date from fx_context union all "
    "select event_id, '/sports/basketball_nba/events/' || event_id || '/odds', 'a,b', 'american', 'iso', null, 'us,eu', null, 'true', null from fx_context",
)
def expected_requests(spark, sf):
    events = b.event_context(spark, sf).withColumn("day", F.col("commence_time").cast("date"))
    return resources.expected_requests(events, _OLD).unionByName(resources.expected_requests(events, _NEW))


# Hours between New York and UTC up to 2006: daylight time from the first Sunday of April to the last one of October, at two.
_EASTERN = (
    "case when {t} >= date_trunc('year', {t}) + interval 3 month + interval 1 day * ((7 - dayofweek(date_trunc('year', {t}) + interval 3 month)) % 7) + interval 2 hour "
    "and {t} < date_trunc('year', {t}) + interval 10 month - interval 1 day * ((dayofweek(date_trunc('year', {t}) + interval 10 month) + 6) % 7 + 1) + interval 2 hour then 4 else 5 end"
)


def _utc(local: str) -> str:
    return f"strftime({local} + interval 1 hour * ({_EASTERN.format(t=local)}), '%Y-%m-%dT%H:%M:%SZ')"


@register(
    "events_requests", "day path date_format date commence_from commence_to",
    f"select day::varchar as day, '/historical/sports/basketball_nba/events' as path, 'iso' as date_format, {_utc('(day::timestamp + interval 23 hour)')} as date, "
    "cast(null as varchar) as commence_from, cast(null as varchar) as commence_to from (select distinct o_orderdate::date as day from orders) union all "
    f"select day::varchar, '/sports/basketball_nba/events', 'iso', null, {_utc('day::timestamp')}, strftime(strptime({_utc('(day::timestamp + interval 1 day)')}, "
    "'%Y-%m-%dT%H:%M:%SZ') - interval 1 second, '%Y-%m-%dT%H:%M:%SZ') from (select distinct o_orderdate::date as day from orders)",
)
def events_requests(spark, sf):
    days = b.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return resources.events_requests(days, _OLD).unionByName(resources.events_requests(days, _NEW))


# Whole objects over several lines, lines of objects, blank lines among the first three and after, other values.
_MIRRORS = """case event_id % 8 when 0 then '{"a": 1}' when 1 then '{"a": 1}\n\n{"b": "x"}\n' when 2 then ' \n' when 3 then '{"a": 1}\n[2]'
  when 4 then '{\n "a": [\n 1]\n}\n' when 5 then '{"a": 1}\n{"a": 2}\n{"a": 3}\n\nbroken' when 6 then '' else '{"a": 1}\n{"b": 2}\n' end"""


@register(
    "valid_mirrors", "path valid",
    f"select 'f' || event_id as path, case when {_RESOURCE_OF} = 'boxscore' then event_id % 8 in (0, 4) else event_id % 8 in (0, 5, 7) end as valid from events",
)
def valid_mirrors(spark, sf):
    return resources.valid_mirrors(
        b.table(spark, sf, "events").select(
            F.expr("concat('f', event_id)").alias("path"), F.expr(_RESOURCE_OF).alias("resource"), F.expr(_MIRRORS).alias("content")
        )
    )
