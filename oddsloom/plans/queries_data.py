"""Queries over payloads, contracts, day status, exports, usage, names and report texts.

Payload bodies, pages and report texts are rebuilt by Spark from the given tables, so that
their number grows with them, and are then read back by the sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.functions import clocks, hashing, names
from oddsloom.operators import canonical_order, completeness, contracts, exports
from oddsloom.plans import bindings as b
from oddsloom.plans.catalog import register
from oddsloom.plans.oracles import CTES
from oddsloom.sources import files, payloads

QUOTE = "snapshot_id event_id market player side price point book last_update link"
_LAST_UPDATE = "strftime(last_update, '%Y-%m-%dT%H:%M:%SZ')"


def _event_payloads(spark, sf):
    """One event-odds payload per order: its line items as nested bookmakers."""
    rows = b.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", *[f"{e} as {n}" for n, e in b.QUOTES.items()]
    )
    outcome = F.struct(
        F.col("side").alias("name"), F.col("player").alias("description"), "price", "point", "link"
    )
    market = F.struct(
        F.col("market").alias("key"), F.lit("").alias("last_update"), F.array(outcome).alias("outcomes")
    )
    book = F.struct(
        F.col("book").alias("key"),
        F.date_format("last_update", clocks.ISO_Z).alias("last_update"),
        F.array(market).alias("markets"),
    )
    grouped = rows.groupBy("provider", "snapshot_id", "event_id", "l_orderkey").agg(
        F.collect_list(book).alias("bookmakers")
    )
    event = F.struct(F.col("event_id").alias("id"), "bookmakers")
    return grouped.select("provider", "snapshot_id", F.to_json(event).alias("body"))


@register(
    "quote_unnest", QUOTE,
    f"select snapshot_id, event_id, market, player, side, price, point, book, {_LAST_UPDATE} as last_update, link from fx_quotes",
)
def quote_unnest(spark, sf):
    return contracts.canonical(payloads.event_odds(_event_payloads(spark, sf)), "event_props")


@register(
    "featured_unnest", "snapshot_id game_id market book price point side last_update",
    "select snapshot_id, event_id as game_id, market, book, price, point, side, strftime(last_update, '%Y-%m-%dT%H:%M:%SZ') as last_update from fx_slate",
)
def featured_unnest(spark, sf):
    outcome = F.struct(F.col("side").alias("name"), "price", "point")
    stamp = F.date_format("last_update", clocks.ISO_Z)
    market = F.struct(F.col("market").alias("key"), stamp.alias("last_update"), F.array(outcome).alias("outcomes"))
    book = F.struct(F.col("book").alias("key"), F.lit("").alias("last_update"), F.array(market).alias("markets"))
    game = F.struct(F.col("event_id").alias("id"), F.array(book).alias("bookmakers"))
    bodies = b.slate(spark, sf).select(F.lit("feed").alias("provider"), "snapshot_id", F.to_json(F.array(game)).alias("body"))
    return contracts.canonical(payloads.featured_odds(bodies), "featured_odds")


@register(
    "canonical_quotes", f"provider schema_version {QUOTE}",
    "select 'feed' as provider, cast(1 as bigint) as schema_version, snapshot_id, event_id, market, player, side, price, point, book, "
    "strftime(last_update, '%Y-%m-%d %H:%M:%S') as last_update, link from fx_quotes",
)
def canonical_quotes(spark, sf):
    raw = b.quotes(spark, sf).withColumns(
        {
            "player": F.concat(F.lit("  "), F.col("player"), F.lit(" \t")),
            "price": F.concat(F.lit(" "), F.col("price").cast("string")),
            "schema_version": F.lit("0"),
        }
    )
    out = contracts.canonical(raw, "event_props")
    contracts.require_columns(out, "event_props")
    return out


@register(
    "row_contract", "snapshot_id row_count invalid_count status",
    "select snapshot_id, count(*) as row_count, count(*) filter (bad) as invalid_count, case when count(*) filter (bad) = 0 then 'ok' else 'invalid_rows' end as status "
    "from (select snapshot_id, book = 'book_4' and market = 'player_steals' as bad from fx_quotes) group by 1",
)
def row_contract(spark, sf):
    dirty = (F.col("book") == "book_4") & (F.col("market") == "player_steals")
    return contracts.row_contract(
        b.quotes(spark, sf).withColumn("book", F.when(dirty, "  ").otherwise(F.col("book")))
    )


def _revised(spark, sf):
    moved = F.col("book") == "book_2"
    return b.quotes(spark, sf).withColumn("price", F.when(moved, F.col("price") + 1).otherwise(F.col("price")))


_DIFF = "snapshot_id event_id market player side price point book"
_DIFF_SQL = "snapshot_id, event_id, market, player, side, price, point, book"
CTES["o_rev"] = (
    "select snapshot_id, event_id, market, player, side, case when book = 'book_2' then price + 1 else price end as price, point, book from fx_quotes"
)


@register(
    "snapshot_diff", f"{_DIFF} change",
    f"(select {_DIFF_SQL}, 'added' as change from (select * from o_rev except select {_DIFF_SQL} from fx_quotes)) union all "
    f"(select {_DIFF_SQL}, 'removed' as change from (select {_DIFF_SQL} from fx_quotes except select * from o_rev))",
)
def snapshot_diff(spark, sf):
    keys = _DIFF.split()
    return contracts.table_diff(b.quotes(spark, sf).select(*keys), _revised(spark, sf).select(*keys))


@register(
    "derived_parity", f"{_DIFF} surplus",
    f"select {_DIFF_SQL}, cast(sum(d) as bigint) as surplus from (select {_DIFF_SQL}, 1 as d from fx_quotes union all select {_DIFF_SQL}, -1 from o_rev) "
    "group by all having sum(d) <> 0",
)
def derived_parity(spark, sf):
    keys = _DIFF.split()
    return contracts.parity(b.quotes(spark, sf).select(*keys), _revised(spark, sf).select(*keys), keys)


# --- box-score and play-by-play payloads ------------------------------------------------


@register(
    "boxscore_unnest", "game_id team_id player_id minutes points",
    f"select concat('g', cast(event_id as varchar)) as game_id, cast(user_id % 30 as varchar) as team_id, cast(user_id as varchar) as player_id, "
    f"round(event_id % 48 + (event_id % 60) / 60.0, 6) as minutes, cast(event_id % 40 as double) as points from events",
)
def boxscore_unnest(spark, sf):
    stats = F.struct(
        F.expr("concat('PT', cast(event_id % 48 as string), 'M', lpad(cast(event_id % 60 as string), 2, '0'), '.00S')").alias("minutes"),
        F.expr("cast(event_id % 40 as string)").alias("points"),
    )
    player = F.struct(F.col("user_id").cast("string").alias("personId"), stats.alias("statistics"))
    team = F.struct(F.expr("cast(user_id % 30 as string)").alias("teamId"), F.array(player).alias("players"))
    game = F.struct(F.expr("concat('g', event_id)").alias("gameId"), team.alias("homeTeam"))
    bodies = b.table(spark, sf, "events").select(F.to_json(F.struct(game.alias("game"))).alias("body"))
    return payloads.boxscore_rows(bodies)


@register(
    "play_by_play_unnest", "game_id event_num event_type team_id player_id",
    "select concat('g', cast(event_id as varchar)) as game_id, case when event_id % 5 = 0 then 1 else event_id end as event_num, event_type, "
    "case when user_id % 7 = 0 then '' else cast(user_id % 7 as varchar) end as team_id, case when user_id = 0 then '' else cast(user_id as varchar) end as player_id from events",
)
def play_by_play_unnest(spark, sf):
    action = F.struct(
        F.expr("if(event_id % 5 = 0, 0, event_id)").alias("actionNumber"),
        F.col("event_type").alias("actionType"),
        F.expr("user_id % 7").alias("teamId"), F.col("user_id").alias("personId"),
    )
    game = F.struct(F.expr("concat('g', event_id)").alias("gameId"), F.array(action).alias("actions"))
    bodies = b.table(spark, sf, "events").select(F.to_json(F.struct(game.alias("game"))).alias("body"))
    return payloads.play_by_play(bodies)


@register(
    "injury_feed_unnest", "snapshot_id player team status note",
    "select snapshot_id, player, team, status, case status when 'out_for_season' then 'Out for season' when 'day_to_day' then 'Day-To-Day' else "
    "upper(substr(status, 1, 1)) || substr(status, 2) end as note from fx_injuries",
)
def injury_feed_unnest(spark, sf):
    spoken = F.replace(F.initcap(F.replace("status", F.lit("_"), F.lit(" "))), F.lit("Day To Day"), F.lit("Day-To-Day"))
    spoken = F.replace(spoken, F.lit("Out For Season"), F.lit("Out for season"))
    item = F.struct(
        F.struct(F.col("player").alias("displayName")).alias("athlete"), spoken.alias("status"),
        F.col("date_update").alias("date"), F.lit("").alias("shortComment"),
    )
    group = F.struct(F.col("team").alias("displayName"), F.array(item).alias("injuries"))
    bodies = b.injuries(spark, sf).select("snapshot_id", F.to_json(F.struct(F.array(group).alias("injuries"))).alias("body"))
    return payloads.injury_feed(bodies)


@register(
    "html_injury_rows", "page_id player player_key team date_update status note",
    "select row_order as page_id, player || ' Dončić' as player, replace(lower(player), ' ', '') || 'doncic' as player_key, team, date_update, status, "
    "case status when 'out_for_season' then 'Out for season' when 'day_to_day' then 'Day to day' else upper(substr(status, 1, 1)) || substr(status, 2) end "
    "|| ' (knee & foot — “é” &x)' as note from fx_injuries",
)
def html_injury_rows(spark, sf):
    spoken = F.replace(F.initcap(F.replace("status", F.lit("_"), F.lit(" "))), F.lit("Day To Day"), F.lit("Day to day"))
    spoken = F.replace(spoken, F.lit("Out For Season"), F.lit("Out for season"))
    html = F.concat(
        F.lit("<table><tr><th data-stat='player'>no such row</th></tr><tr class=\"r\"><td csk='"), "date_update",
        F.lit("' data-stat=\"date_update\">x</td><th data-stat=\"player\"><a href=\"/p\">"), "player",
        F.lit(' Don&ccaron;i&cacute;</a></th><TD data-stat="team_name"><a href="/t">'), "team",
        F.lit('</a></TD><td data-stat="note"><b>'), spoken,
        F.lit("</b> (knee &amp; foot &#8212; &#147;&#xE9;&rdquo; &x)</td></tr></table>"),
    )
    # The table is small in bytes and its pages are made here: dealt out by row, so that all cores read pages.
    dealt = b.injuries(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism)
    return payloads.html_injuries(dealt.select(F.col("row_order").alias("page_id"), html.alias("html")))


_PAGE_ROW = '<tr><th data-stat="player">A B</th><td data-stat="team_name">Utah Jazz</td><td data-stat="date_update" csk="2024-01-01">x</td><td data-stat="note">Out</td></tr>'


@register(
    "html_pages_scanned", "page_id injury_rows report_links",
    "select page_id, cast(page_id % 3 as integer) as injury_rows, cast(case when page_id % 2 = 0 then 1 when page_id % 5 = 0 then 2 else 0 end as integer) as report_links from pages",
)
def html_pages_scanned(spark, sf):
    """Whole pages, each with a few rows and links added that tell it from the others."""
    added = F.concat(
        F.expr(f"repeat('{_PAGE_ROW}', int(page_id % 3))"),
        F.when(F.col("page_id") % 2 == 0, F.lit('<a class=x href="a/report.pdf">Injury</a><a href="injury.pdf">List</a>'))
        .when(F.col("page_id") % 5 == 0, F.lit("<a href='/injury-a.PDF'>One</a><a href='/injury-b.pdf'>Two</a><a href='/menu.pdf'>Menu</a>"))
        .otherwise(F.lit("<a href='/menu.pdf'>Menu</a>")),
    )
    pages = b.table(spark, sf, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), added).alias("html"))
    rows = payloads.html_injuries(pages).select("page_id", F.lit(1).alias("a"), F.lit(0).alias("l"))
    links = payloads.report_links(pages).select("page_id", F.lit(0).alias("a"), F.lit(1).alias("l"))
    blank = pages.select("page_id", F.lit(0).alias("a"), F.lit(0).alias("l"))
    return rows.unionByName(links).unionByName(blank).groupBy("page_id").agg(
        F.sum("a").cast("int").alias("injury_rows"), F.sum("l").cast("int").alias("report_links")
    )


@register(
    "newest_report_link", "page_id url",
    "select c_custkey as page_id, 'https://feed.example/reports/injury-report_2024-01-' || lpad(cast(c_custkey % 28 + 1 as varchar), 2, '0') || "
    "case when c_custkey % 2 = 0 then '_01PM.pdf' else '_01_30PM.pdf' end as url from customer",
)
def newest_report_link(spark, sf):
    day = F.expr("lpad(cast(c_custkey % 28 + 1 as string), 2, '0')")

    def link(suffix: str):
        return F.concat(
            F.lit('<a href="injury-report_2024-01-'), day, F.lit(f'_{suffix}.pdf">Injury <i>Report</i></a>')
        )

    late = F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(link("01_30PM"))
    html = F.concat(link("11AM"), link("01PM"), link("12AM"), late, F.lit('<a href="/menu.pdf">Injury menu</a>'))
    pages = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), html.alias("html"))
    return payloads.newest_report(payloads.report_links(pages, "https://feed.example/reports/today.html"))


_REPORT_STATUS = "case c_custkey % 5 when 0 then 'Out' when 1 then 'Doubtful' when 2 then 'Questionable' when 3 then 'Probable' else 'Available' end"


def _reports(spark, sf):
    """One report text per customer: stray statuses, a player without one, and a full entry."""
    text = F.concat(
        F.lit("Injury Report: 01/05/24 05:30 PM\nGame Date\n01/05/2024\n"),
        F.expr("if(c_custkey % 3 = 0, 'Out\n05:30 (ET)\nDoubtful\n', 'BOS@UTA\n')"),
        F.expr("if(c_custkey % 2 = 0, 'Boston Celtics', 'Utah Jazz')"), F.lit("\nBench, Nobody\nStar"),
        F.expr("cast(c_custkey % 50 as string)"), F.lit(", Player\n"), F.expr(_REPORT_STATUS),
        F.lit("\nInjury/Illness -\n\n"), F.col("c_mktsegment"), F.lit("\nPage 1 of 2\nstray note"),
    )
    return b.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


@register(
    "report_injury_rows", "doc_id player team status note",
    "select c_custkey as doc_id, 'Player Star' || cast(c_custkey % 50 as varchar) as player, case when c_custkey % 2 = 0 then 'Boston Celtics' else 'Utah Jazz' end as team, "
    f"lower({_REPORT_STATUS}) as status, 'Injury/Illness - ' || c_mktsegment as note from customer",
)
def report_injury_rows(spark, sf):
    return payloads.report_injuries(_reports(spark, sf))


@register(
    "report_coverage",
    "doc_id generated_at status_tokens orphan_status_tokens skipped_players rows_count parse_coverage parse_status",
    "select c_custkey as doc_id, '2024-01-05 22:30:00' as generated_at, 1 as status_tokens, case when c_custkey % 3 = 0 then 2 else 0 end as orphan_status_tokens, "
    "1 as skipped_players, 1 as rows_count, cast(1 as double) as parse_coverage, 'ok' as parse_status from customer",
)
def report_coverage(spark, sf):
    return payloads.report_coverage(_reports(spark, sf))


@register(
    "document_line_kinds", "doc_id kind lines",
    "select doc_id, case when lower(t) in ('out', 'doubtful', 'questionable', 'probable', 'available') then 'status' "
    "when regexp_matches(t, '^[A-Za-z0-9''.\\- \\t]+,[A-Za-z0-9''.\\- \\t]+$') and trim(split_part(t, ',', 1)) <> '' and trim(split_part(t, ',', 2)) <> '' then 'player' "
    "else 'note' end as kind, count(*) as lines from (select doc_id, trim(line, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as t from "
    "(select doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c]')) as line from documents)) where t <> '' group by 1, 2",
)
def document_line_kinds(spark, sf):
    lines = payloads.report_lines(b.table(spark, sf, "documents"))
    return lines.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("lines"))


# --- manifests and files ------------------------------------------------------------------

_RES = "case p_partkey % {m} when 0 then 'missing' when 1 then 'error' when 2 then 'odd' else 'ok' end"
CTES["o_man"] = f"""
select * from (select '2024-25' as season, 'regular_season' as season_type, 'g' || cast(p_partkey % 400 as varchar) as game_id, {_RES.format(m=7)} as a, {_RES.format(m=11)} as b,
  {_RES.format(m=13)} as c, row_number() over (partition by p_partkey % 400 order by p_partkey desc) as rn from part) where rn = 1"""


def _manifest(spark, sf):
    rows = b.table(spark, sf, "part").selectExpr(
        "'2024-25' as season", "'regular_season' as season_type", "concat('g', p_partkey % 400) as game_id",
        "p_partkey as row_order",
        f"map('boxscore', {_RES.format(m=7)}, 'enhanced_pbp', {_RES.format(m=11)}, 'possessions', {_RES.format(m=13)}) as resources",
    )
    return files.latest_manifest(rows)


@register(
    "manifest_latest", "season season_type game_id boxscore enhanced_pbp possessions",
    "select season, season_type, game_id, case a when 'odd' then 'missing' else a end as boxscore, case b when 'odd' then 'missing' else b end as enhanced_pbp, "
    "case c when 'odd' then 'missing' else c end as possessions from o_man",
)
def manifest_latest(spark, sf):
    return _manifest(spark, sf).select(
        "season", "season_type", "game_id", *[F.col("resources")[r].alias(r) for r in ("boxscore", "enhanced_pbp", "possessions")]
    )


@register(
    "pending_games", "game_id pending complete",
    "select game_id, a in ('missing', 'odd', 'error') or b in ('missing', 'odd', 'error') or c in ('missing', 'odd', 'error') as pending, "
    "a = 'ok' and b = 'ok' and c = 'ok' as complete from o_man",
)
def pending_games(spark, sf):
    manifest = _manifest(spark, sf)
    pending = files.pending_games(manifest, include_errors=True).select("game_id", F.lit(True).alias("pending"))
    done = files.complete_games(manifest).select("game_id", F.lit(True).alias("complete"))
    return manifest.select("game_id").join(pending, "game_id", "left").join(done, "game_id", "left").select(
        "game_id", F.coalesce("pending", F.lit(False)).alias("pending"), F.coalesce("complete", F.lit(False)).alias("complete")
    )


@register(
    "manifest_reconcile", "path status",
    "select 'f' || cast(p_partkey as varchar) as path, case when p_partkey % 3 = 0 then 'error' when s_suppkey is null or s_acctbal <= 0 then 'missing' else 'ok' end as status "
    "from part left join supplier on s_suppkey = p_partkey",
)
def manifest_reconcile(spark, sf):
    resources = b.table(spark, sf, "part").selectExpr("concat('f', p_partkey) as path", "if(p_partkey % 3 = 0, 'error', 'ok') as status")
    found = b.table(spark, sf, "supplier").selectExpr("concat('f', s_suppkey) as path", "s_acctbal as bytes")
    return files.reconcile(resources, found)


# --- day status ---------------------------------------------------------------------------

CTES["o_ds0"] = """
select *, total_events - missing_count as present, missing_count = 0 and error = '' and note = '' as complete,
  case when missing_count = 0 and error = '' and note = '' then 'complete' when error like '%blocked%' then 'spend_blocked' when error like '%404%' then 'upstream_404'
    when note <> '' then 'missing_events_list' when missing_count > 0 then 'missing_event_odds' else 'incomplete_unknown' end as reason from fx_day_status"""


@register(
    "day_completeness", "day complete total_events missing_count present_event_odds reason_codes error_code status_code odds_coverage_ratio",
    "select cast(day as varchar) as day, complete, total_events, missing_count, present as present_event_odds, reason as reason_codes, case when complete then '' else reason end as error_code, "
    "case when complete then 'complete' else 'incomplete_' || reason end as status_code, round(present / total_events, 6) as odds_coverage_ratio from o_ds0",
)
def day_completeness(spark, sf):
    return completeness.canonical_status(b.day_status(spark, sf))


@register(
    "status_summary", "total_days complete_count incomplete_count missing_events_total avg_odds_coverage_ratio minimum_odds_coverage_ratio",
    "select count(*) as total_days, count(*) filter (complete) as complete_count, count(*) filter (not complete) as incomplete_count, cast(sum(missing_count) as bigint) as missing_events_total, "
    "round(avg(present / total_events), 6) as avg_odds_coverage_ratio, round(min(present / total_events), 6) as minimum_odds_coverage_ratio from o_ds0",
)
def status_summary(spark, sf):
    return completeness.status_summary(completeness.canonical_status(b.day_status(spark, sf)))


@register("incomplete_reasons", "error_code days", "select reason as error_code, count(*) as days from o_ds0 where not complete group by 1")
def incomplete_reasons(spark, sf):
    return completeness.reason_counts(completeness.canonical_status(b.day_status(spark, sf)))


@register(
    "preflight_days", "day error_code",
    "select cast(day as varchar) as day, reason as error_code from o_ds0 where not complete and reason <> 'missing_event_odds' and day <> date '1995-01-01'",
)
def preflight_days(spark, sf):
    status = completeness.canonical_status(b.day_status(spark, sf))
    return completeness.preflight(status, ["1995-01-01"], ["missing_event_odds"])


@register(
    "missing_requests", "day missing_requests estimated_credits",
    "select cast(cast(o_orderdate as date) as varchar) as day, count(*) as missing_requests, count(*) * 3 * 2 * 10 as estimated_credits from orders "
    "where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A') group by 1",
)
def missing_requests(spark, sf):
    expected = b.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("request_key")
    )
    cached = b.table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("request_key"))
    return completeness.credit_estimate(completeness.missing_requests(expected, cached), markets=3, bookmakers=12)


@register(
    "computed_day_status", "day total_events missing_count status_code",
    "select cast(cast(o_orderdate as date) as varchar) as day, count(*) as total_events, count(*) filter (l is null) as missing_count, "
    "case when count(*) filter (l is null) = 0 then 'complete' else 'incomplete_missing_event_odds' end as status_code from orders left join "
    "(select distinct l_orderkey as l from lineitem where l_returnflag = 'A') on l = o_orderkey group by 1",
)
def computed_day_status(spark, sf):
    expected = b.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("request_key")
    )
    cached = b.table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("request_key"))
    return completeness.canonical_status(completeness.compute_status(expected, cached))


@register(
    "denorm_export", "dataset_id day snapshot_id event_id request_key market player side point book price link",
    "select 'main' as dataset_id, right(q.snapshot_id, 10) as day, q.snapshot_id, q.event_id, r.request_key, q.market, q.player, q.side, q.point, q.book, q.price, q.link "
    "from fx_quotes q left join (select snapshot_id, event_id, min('k' || event_id || '-' || home_team) as request_key from fx_context group by 1, 2) r using (snapshot_id, event_id)",
)
def denorm_export(spark, sf):
    requests = b.event_context(spark, sf).select(
        "snapshot_id", F.concat(F.lit("event_odds:"), "event_id").alias("label"),
        F.concat(F.lit("k"), "event_id", F.lit("-"), "home_team").alias("request_key"),
    )
    dated = b.quotes(spark, sf).withColumn("day", clocks.snapshot_day(F.col("snapshot_id")).cast("string"))
    return contracts.enforce_schema(completeness.fact_outcomes(dated, requests, "main"), "fact_outcomes")


@register(
    "usage_by_month", "month rows total_credits provider_remaining used_share_reached",
    "select strftime(ts, '%Y-%m') as month, count(*) as rows, cast(sum(credits) as bigint) as total_credits, arg_max(remaining, ts) as provider_remaining, "
    "sum(credits) >= 15000 as used_share_reached from fx_usage group by 1",
)
def usage_by_month(spark, sf):
    monthly = completeness.monthly_usage(b.usage(spark, sf))
    status = completeness.budget_status(monthly, 15000).select("month", F.col("cap_reached").alias("used_share_reached"))
    return monthly.join(status, "month")


@register(
    "usage_by_endpoint", "month endpoint requests credits position",
    "select *, row_number() over (partition by month order by credits desc, endpoint) as position from (select strftime(ts, '%Y-%m') as month, endpoint, count(*) as requests, "
    "cast(sum(credits) as bigint) as credits from fx_usage group by 1, 2)",
)
def usage_by_endpoint(spark, sf):
    return completeness.endpoint_usage(b.usage(spark, sf))


@register(
    "live_window", "snapshot_id event_count first_tip last_tip window_start window_end odds_from odds_to within_window",
    "select snapshot_id, count(*) as event_count, "
    + ", ".join(
        f"strftime({e}, '%Y-%m-%d %H:%M:%S') as {n}"
        for n, e in {
            "first_tip": "min(commence_time)", "last_tip": "max(commence_time)",
            "window_start": "min(commence_time) - interval 3 hour", "window_end": "max(commence_time) + interval 4 hour",
            "odds_from": "date_trunc('hour', min(commence_time)) - interval 4 hour",
            "odds_to": "date_trunc('hour', max(commence_time)) + interval 4 hour",
        }.items()
    )
    + ", timestamp '2024-01-03 02:00:00' between min(commence_time) - interval 3 hour and max(commence_time) + interval 4 hour as within_window from fx_context group by 1",
)
def live_window(spark, sf):
    now = F.lit("2024-01-03 02:00:00").cast("timestamp")
    return completeness.live_window(b.event_context(spark, sf), now, 3, 4)


@register(
    "day_windows", "day start_utc end_utc anchor_utc",
    "select cast(d as varchar) as day, strftime(timezone('UTC', timezone('America/New_York', cast(d as timestamp))), '%Y-%m-%d %H:%M:%S') as start_utc, "
    "strftime(timezone('UTC', timezone('America/New_York', cast(d + 1 as timestamp))), '%Y-%m-%d %H:%M:%S') as end_utc, "
    "strftime(timezone('UTC', timezone('America/New_York', cast(d as timestamp) + interval 12 hour)), '%Y-%m-%d %H:%M:%S') as anchor_utc from "
    "(select distinct cast(o_orderdate as date) as d from orders)",
)
def day_windows(spark, sf):
    days = b.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.withColumns(
        {
            "start_utc": clocks.day_start_utc(F.col("day")),
            "end_utc": clocks.day_end_utc(F.col("day")),
            "anchor_utc": clocks.anchor_utc(F.col("day"), 12),
        }
    )


@register(
    "name_keys", "name person_key aliases last_word first_initial stripped",
    "select c_name || case c_custkey % 4 when 0 then ' Jr.' when 1 then ' III' else '' end as name, regexp_replace(lower(c_name || case c_custkey % 4 when 0 then ' Jr.' when 1 then ' III' else '' end), "
    "'[^a-z0-9]+', '', 'g') as person_key, case when c_custkey % 4 in (0, 1) then regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') || ',' else '' end || "
    "regexp_replace(lower(c_name || case c_custkey % 4 when 0 then ' Jr.' when 1 then ' III' else '' end), '[^a-z0-9]+', '', 'g') as aliases, split_part(c_name, '#', 2) as last_word, 'c' as first_initial, "
    # "ii" is tried before "iii", so a third-generation key keeps one letter.
    "regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') || case c_custkey % 4 when 1 then 'i' else '' end as stripped from customer",
)
def name_keys(spark, sf):
    named = b.table(spark, sf, "customer").selectExpr(
        "concat(c_name, case c_custkey % 4 when 0 then ' Jr.' when 1 then ' III' else '' end) as name"
    )
    name = F.col("name")
    return named.withColumns(
        {
            "person_key": names.person_key(name),
            "aliases": names.name_aliases(name),
            "last_word": names.last_word(name),
            "first_initial": names.first_initial(name),
            "stripped": names.strip_suffix(names.person_key(name)),
        }
    )


@register(
    "identity_map", "player_key aliases odds_api_names last_seen_event_ids teams",
    "select player_key, player_key as aliases, min(player) as odds_api_names, string_agg(distinct event_id, ',' order by event_id) as last_seen_event_ids, "
    "coalesce(string_agg(distinct t, ',' order by t), '') as teams from (select player_key, player, event_id, case when home_known and away_known and in_home and not in_away then home "
    "when home_known and away_known and in_away and not in_home then away end as t from o_pc0) group by 1",
)
def identity_map(spark, sf):
    return completeness.identity_map(b.quotes(spark, sf), b.event_context(spark, sf), b.roster(spark, sf))


@register(
    "request_keys", "o_orderkey request_key",
    "select o_orderkey, sha256('{\"method\":\"GET\",\"params\":{\"date\":\"' || cast(cast(o_orderdate as date) as varchar) || '\",\"markets\":\"player_points\"},\"path\":\"/events/' || "
    "cast(o_orderkey as varchar) || '/odds\"}') as request_key from orders",
)
def request_keys(spark, sf):
    params = F.create_map(
        F.lit("markets"), F.lit("player_points"), F.lit("date"), F.col("o_orderdate").cast("date").cast("string"),
        F.lit("apiKey"), F.lit("secret"),
    )
    path = F.concat(F.lit("/events/"), F.col("o_orderkey").cast("string"), F.lit("/odds"))
    return b.table(spark, sf, "orders").select(
        "o_orderkey", hashing.request_key(F.lit("get"), path, params).alias("request_key")
    )




# --- canonical order ----------------------------------------------------------------------

# Points of all sizes: small fractions, sums with a binary tail, none, and beyond twelve digits.
_ODD_POINT = (
    "case l_linenumber when 1 then cast(l_quantity as double) / 10000000 when 2 then 0.1e0 + 0.2e0 + l_suppkey when 3 then null "
    "when 4 then cast(100000000000 as double) * l_quantity * (l_suppkey % 10 + 1) + l_partkey when 5 then cast(-1 as double) / (3 * l_suppkey + 1) else l_quantity + 10.5 end"
)
_ORDERED_QUOTES = {**{c: b.QUOTES[c] for c in "snapshot_id event_id player market side book price link".split()}, "point": _ODD_POINT}
CTES["o_odd_quotes"] = f"select {b._select_list(_ORDERED_QUOTES)} from lineitem"


@register(
    "canonical_quote_order", "snapshot_id ordinal event_id player market point_text side book price_text link",
    "select snapshot_id, row_number() over (partition by snapshot_id order by event_id, player, market, point_text, side, book, price_text, link) as ordinal, "
    "event_id, player, market, point_text, side, book, price_text, link from (select *, case when point is null then '' else printf('%.12g', point::double) end as point_text, "
    "printf('%.12g', price) as price_text from o_odd_quotes)",
)
def canonical_quote_order(spark, sf):
    rows = b.table(spark, sf, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _ORDERED_QUOTES.items()])
    rows = rows.withColumns({"point": F.col("point").cast("double"), "last_update": F.lit("")})
    texts = {"point": "point_text", "price": "price_text"}
    return canonical_order.with_ordinals(rows, "event_props", last=("link",), texts=texts)


# --- export of days -----------------------------------------------------------------------

# Lines ship on a day of a snapshot; days with orders have a status. By the number of its orders a day names its
# snapshot, none, one that is not there, or one without quotes; days with late orders are incomplete.
_EXPORT_QUOTES = {**b.QUOTES, "snapshot_id": "concat('day-', cast(cast(l_shipdate as date) as string))", "last_update": "''"}
_EXPORT_SNAPSHOT = (
    "case when count(*) % 7 = 3 then ' ' when count(*) % 7 = 4 then concat('lost-', cast(max(cast(o_orderdate as date)) as string)) "
    "when count(*) % 7 = 5 then concat('early-', cast(max(cast(o_orderdate as date)) as string)) "
    "else concat(' day-', cast(max(cast(o_orderdate as date)) as string)) end"
)
_EXPORT_REQUESTS = {
    "snapshot_id": "concat('day-', cast(cast(o_orderdate as date) as string))",
    "label": "concat('event_odds: e', cast(o_orderkey % 10 as string))",
    "request_key": "concat('k', cast(o_orderkey as string))",
    "path": "concat('/events/', o_orderpriority)",
    "status": "concat(o_orderstatus, ' ')",
    "sport": "cast(o_custkey as string)",
}
CTES["o_export_quotes"] = f"select {b._select_list(_EXPORT_QUOTES)} from lineitem"
CTES["o_export_requests"] = f"select {b._select_list(_EXPORT_REQUESTS)} from orders where o_orderpriority not like '5%' and o_orderstatus <> 'P'"
CTES["o_export_named"] = f"select o_orderdate::date as day, trim({_EXPORT_SNAPSHOT}) as snapshot_id from orders group by 1"
CTES["o_export_plan"] = """
select d.day::varchar as day, n.snapshot_id, case when s.day is null then 'missing_day_status' when s.missing_count > 0 or s.error <> '' or s.note <> '' then 'incomplete_day'
  when n.snapshot_id = '' then 'missing_snapshot_id' when n.snapshot_id like 'lost-%' then 'missing_snapshot'
  when n.snapshot_id not in (select snapshot_id from o_export_quotes) then 'missing_event_props' end as skip
from (select o_orderdate::date as day from orders union select l_shipdate::date from lineitem) d left join fx_day_status s using (day) left join o_export_named n using (day)"""


def _export(spark, sf):
    """Days asked for, their status, the snapshots there are, quotes and requests."""
    orders, lines = b.table(spark, sf, "orders"), b.table(spark, sf, "lineitem")
    day = F.col("o_orderdate").cast("date").alias("day")
    named = orders.groupBy(day).agg(F.expr(_EXPORT_SNAPSHOT).alias("snapshot_id"))
    status = completeness.canonical_status(b.day_status(spark, sf)).join(named, "day")
    days = orders.select(day).union(lines.select(F.col("l_shipdate").cast("date"))).distinct()
    there = named.select(F.trim("snapshot_id").alias("snapshot_id")).where("snapshot_id not like 'lost-%'")
    quotes = lines.selectExpr(*[f"{e} as {n}" for n, e in _EXPORT_QUOTES.items()])
    held = orders.where("o_orderpriority not like '5%' and o_orderstatus <> 'P'")
    requests = held.selectExpr(*[f"{e} as {n}" for n, e in _EXPORT_REQUESTS.items()]).withColumns(
        {
            "updated_at_utc": F.lit(None).cast("string"),
            "params": F.create_map(F.lit("regions"), F.lit("us"), F.lit("oddsFormat"), "sport"),
        }
    )
    return days, status, there, quotes, requests


@register(
    "export_plan", "day snapshot_id skip warnings",
    "select day, snapshot_id, skip, case when skip is null then case when snapshot_id in (select snapshot_id from o_export_requests) then '' else 'missing_manifest' end "
    "when skip = 'incomplete_day' then '' else skip end as warnings from o_export_plan",
)
def export_plan(spark, sf):
    return exports.export_plan(*_export(spark, sf))


@register(
    "export_facts", "day snapshot_id event_id request_key market player side point book price link skip",
    "select p.day, q.snapshot_id, q.event_id, r.request_key, q.market, q.player, q.side, q.point, q.book, q.price, q.link, p.skip from o_export_quotes q "
    "join o_export_plan p using (snapshot_id) left join (select snapshot_id, trim(substr(label, 12)) as event_id, min(request_key) as request_key "
    "from o_export_requests group by 1, 2) r using (snapshot_id, event_id)",
)
def export_facts(spark, sf):
    days, status, there, quotes, requests = _export(spark, sf)
    plan = exports.export_plan(days, status, there, quotes, requests)
    return exports.facts(quotes, plan, requests, "main")


@register(
    "export_requests", "day snapshot_id request_key request_label request_path request_status updated_at_utc param_regions param_odds_format param_markets",
    "select p.day, snapshot_id, request_key, label as request_label, path as request_path, trim(status) as request_status, '' as updated_at_utc, 'us' as param_regions, "
    "sport as param_odds_format, '' as param_markets from o_export_requests join o_export_plan p using (snapshot_id) where p.skip is null",
)
def export_requests(spark, sf):
    days, status, there, quotes, requests = _export(spark, sf)
    return exports.request_rows(requests, exports.export_plan(days, status, there, quotes, requests))


@register(
    "export_day_status", "dataset_id day snapshot_id day_complete day_odds_coverage_ratio day_missing_count day_total_events day_reason_code",
    "select 'main' as dataset_id, p.day, p.snapshot_id, true as day_complete, 1.0 as day_odds_coverage_ratio, s.missing_count as day_missing_count, "
    "s.total_events as day_total_events, 'complete' as day_reason_code from o_export_plan p join fx_day_status s on s.day = p.day::date where skip is null",
)
def export_day_status(spark, sf):
    days, status, there, quotes, requests = _export(spark, sf)
    return exports.day_rows(status, exports.export_plan(days, status, there, quotes, requests), "main")
