"""Test-table bindings: each engine table as plain expressions over the given tables.

The expressions are valid in Spark SQL and in DuckDB, so the checking SQL starts from the
same text. Every binding reads its whole source table; snapshots are cut from the key
range, so the number of snapshots, lines, rosters and tickets grows with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS_PER_SNAPSHOT = 5000
CUSTOMERS_PER_SNAPSHOT = 500
PARTS_PER_SNAPSHOT = 600


def _snapshot_number(key: str, per_snapshot: int) -> str:
    return f"cast(floor({key} / {per_snapshot}.0) as int)"


def _snapshot_id(key: str, per_snapshot: int) -> str:
    number = _snapshot_number(key, per_snapshot)
    return f"concat('day-main-', cast(date '2024-01-01' + {number} as string))"


def _market(key: str) -> str:
    return (
        f"case {key} % 6 when 0 then 'player_points' when 1 then 'player_rebounds' "
        "when 2 then 'player_assists' when 3 then 'player_threes' "
        "when 4 then 'player_points_rebounds_assists' else 'player_steals' end"
    )


_MIX = "(l_orderkey * 31 + l_partkey * 17 + l_suppkey * 13 + l_linenumber * 7)"

QUOTES = {
    "provider": "'feed'",
    "snapshot_id": _snapshot_id("l_orderkey", ORDERS_PER_SNAPSHOT),
    "event_id": "concat('e', cast(l_orderkey % 10 as string))",
    "market": _market("l_partkey"),
    "player": "concat('Player ', cast(l_partkey % 15 as string))",
    "point": "cast(floor(sqrt(l_quantity)) as double) + 10.5",
    "side": "case when cast(floor(l_orderkey / 10.0) as bigint) % 2 = 0 then 'Over' else 'Under' end",
    "book": "concat('book_', cast(l_suppkey % 5 as string))",
    "price": (
        f"cast(case when {_MIX} % 81 >= 61 then 39 + {_MIX} % 81 "
        f"else -160 + {_MIX} % 81 end as double)"
    ),
    "last_update": (
        "timestamp '2024-01-01 12:00:00' + interval '1' minute * cast(("
        f"{_snapshot_number('l_orderkey', ORDERS_PER_SNAPSHOT)} * 1440 "
        "+ (l_orderkey * 7 + l_partkey) % 90) as int)"
    ),
    "link": (
        "concat('book_', cast(l_suppkey % 5 as string), '/', cast(l_orderkey as string),"
        " '-', cast(l_linenumber as string))"
    ),
}

_HOME = "concat('team ', cast((o_orderkey % 10) * 2 % 10 as string))"
_AWAY = (
    "concat('team ', cast(case when o_orderkey % 10 = 8 then 99 "
    "else ((o_orderkey % 10) * 2 + 1) % 10 end as string))"
)

# One event id per snapshot is spelled differently in the context, so it stays unmapped.
EVENT_CONTEXT = {
    "snapshot_id": _snapshot_id("o_orderkey", ORDERS_PER_SNAPSHOT),
    "event_id": (
        "concat(case when o_orderkey % 10 = 9 then 'x' else 'e' end, "
        "cast(o_orderkey % 10 as string))"
    ),
    "home_team": _HOME,
    "away_team": _AWAY,
    "commence_time": (
        "timestamp '2024-01-02 00:30:00' + interval '1' minute * cast(("
        f"{_snapshot_number('o_orderkey', ORDERS_PER_SNAPSHOT)} * 1440 "
        "+ (o_orderkey % 10) * 15) as int)"
    ),
}

SLATE = {
    "snapshot_id": _snapshot_id("o_orderkey", ORDERS_PER_SNAPSHOT),
    "event_id": "concat('e', cast(o_orderkey % 10 as string))",
    "market": "case when o_custkey % 2 = 0 then 'totals' else 'spreads' end",
    "side": (
        f"case when o_custkey % 2 = 0 then 'Over' when o_custkey % 4 = 1 then {_HOME} "
        f"else {_AWAY} end"
    ),
    "point": (
        "case when o_custkey % 2 = 0 then cast(210 + o_custkey % 20 as double) + 0.5 "
        "else cast((case when o_custkey % 4 = 1 then 1 else -1 end)"
        " * (o_orderkey % 10 * 3 - 14) + o_custkey % 7 as double) + 0.5 end"
    ),
    "book": "concat('book_', cast(o_custkey % 5 as string))",
    "price": "cast(-110 as double)",
    "last_update": "o_orderdate",
}

ROSTER = {
    "snapshot_id": _snapshot_id("c_custkey", CUSTOMERS_PER_SNAPSHOT),
    "team": "concat('team ', cast(c_custkey % 10 as string))",
    "player": "concat('Player ', cast(c_custkey % 14 as string))",
    "status": (
        "case when (c_custkey % 70) % 11 = 0 then 'INACTIVE' "
        "when (c_custkey % 70) % 13 = 5 then 'TWO-WAY' else 'ACTIVE' end"
    ),
}

_OFFICIAL = "cast(floor(c_custkey / 12.0) as bigint) % 3 = 0"

INJURIES = {
    "snapshot_id": _snapshot_id("c_custkey", CUSTOMERS_PER_SNAPSHOT),
    "source": f"case when {_OFFICIAL} then 'official' else 'secondary' end",
    "player": (
        f"concat('Player ', cast(case when {_OFFICIAL} then c_custkey % 12 "
        "else 3 + c_custkey % 8 end as string))"
    ),
    "team": "concat('team ', cast(c_custkey % 10 as string))",
    "status": (
        "case c_custkey % 9 when 0 then 'out' when 1 then 'doubtful' when 2 then 'questionable' "
        "when 3 then 'probable' when 4 then 'day_to_day' when 5 then 'out_for_season' "
        "else 'available' end"
    ),
    "note": "c_mktsegment",
    "date_update": "cast(date '2024-01-01' + cast(c_custkey % 28 as int) as string)",
    "row_order": "c_custkey",
}

MINUTES_PREDICTIONS = {
    "snapshot_id": _snapshot_id("p_partkey", PARTS_PER_SNAPSHOT),
    "event_id": "concat('e', cast(p_partkey % 10 as string))",
    "player": "concat('Player ', cast(p_partkey % 13 as string))",
    "market": _market("p_partkey"),
    "minutes_p10": "cast(16 + p_size % 16 - p_partkey % 9 as double)",
    "minutes_p50": "cast(20 + p_size % 16 as double)",
    "minutes_p90": "cast(23 + p_size % 16 + p_partkey % 11 as double)",
    "p_active": "cast(70 + p_partkey % 30 as double) / 100.0",
    "confidence_score": "cast(30 + p_partkey % 60 as double) / 100.0",
    "row_order": "p_partkey",
}

_TICKET_P = "cast(40 + (l_orderkey + l_partkey) % 31 as double) / 100.0"

# Over lineitem joined with orders.
TICKETS = {
    "strategy_id": (
        "case l_linenumber % 5 when 0 then 's007' when 1 then 's008' when 2 then 's009' "
        "when 3 then 's010' else 's011' end"
    ),
    "modeled_day": (
        f"date '2024-01-01' + {_snapshot_number('o_orderkey', ORDERS_PER_SNAPSHOT)}"
        " - 1 - cast(o_custkey % 30 as int)"
    ),
    "market": (
        "case l_partkey % 4 when 0 then 'player_points' when 1 then 'player_rebounds' "
        "when 2 then 'player_assists' else 'player_threes' end"
    ),
    "recommended_side": "case when l_suppkey % 2 = 0 then 'over' else 'under' end",
    "result": "case l_returnflag when 'A' then 'W' when 'R' then 'loss' when 'N' then 'Push' else '' end",
    "price_american": (
        "cast(case when l_suppkey % 2 = 0 then 100 + l_partkey % 41 "
        "else -100 - l_partkey % 41 end as int)"
    ),
    "stake_units": "cast(1 + l_linenumber % 2 as double)",
    "model_p_hit": _TICKET_P,
    "p_hit_low": f"{_TICKET_P} - 0.03",
    "best_ev": "cast(l_partkey % 9 as double) / 100.0",
    "ev_low": "cast(l_partkey % 7 - 2 as double) / 100.0",
    "quality_score": "cast(l_suppkey % 11 as double) / 10.0",
    "uncertainty_band": "cast(1 + l_suppkey % 12 as double) / 100.0",
    "candidate_lines": "cast(10 + l_orderkey % 5 as double)",
    "eligible_lines": "cast(l_orderkey % 7 as double)",
}

# Over lineitem, one row per snapshot, event and player.
RESULTS_KEYS = {
    "snapshot_id": _snapshot_id("l_orderkey", ORDERS_PER_SNAPSHOT),
    "event_number": "l_orderkey % 10",
    "player_number": "l_partkey % 15",
}
RESULTS_STATS = {
    "points": "cast(count(*) % 30 as double)",
    "rebounds": "cast(sum(l_linenumber) % 25 as double)",
    "assists": "cast(sum(l_partkey) % 20 as double)",
    "threes": "cast(sum(l_suppkey) % 18 as double)",
}
# Spellings exercise every rung of the name ladder: plain, suffixed, initials, missing.
RESULTS_ROW = {
    "snapshot_id": "snapshot_id",
    "event_id": "concat('e', cast(event_number as string))",
    "game_status": (
        "case event_number % 4 when 0 then 'in_progress' when 1 then 'final' "
        "when 2 then 'final' else 'scheduled' end"
    ),
    "player": (
        "case when player_number = 3 then 'Bench Nobody' "
        "when player_number % 5 = 1 then concat('Player ', cast(player_number as string), ' Jr.') "
        "when player_number % 5 = 2 then concat('P. ', cast(player_number as string)) "
        "else concat('Player ', cast(player_number as string)) end"
    ),
    "points": "points",
    "rebounds": "rebounds",
    "assists": "assists",
    "threes": "threes",
}

BOXSCORE_KEYS = {
    "game_id": (
        "concat(cast(cast(ts as date) as string), '-m', "
        "cast(cast(floor(user_id / 20.0) as bigint) as string))"
    ),
    "game_date": "cast(ts as date)",
    "player_id": "cast(user_id as string)",
    "team_id": (
        "concat('t', cast(cast(floor(user_id / 20.0) as bigint) * 2 + user_id % 2 as string))"
    ),
}
BOXSCORE_STATS = {
    "minutes": "cast(sum(case when event_type = 'error' then 0 else event_id % 12 + 1 end) as double)",
    "points": "cast(sum(case when event_type = 'click' then 2 else 0 end) as double)",
    "rebounds": "cast(sum(case when event_type = 'view' then 1 else 0 end) as double)",
    "assists": "cast(sum(case when event_type = 'purchase' then 1 else 0 end) as double)",
}

ACTIONS = {
    "game_id": BOXSCORE_KEYS["game_id"],
    "action_number": "event_id",
    "team_id": "cast(floor(user_id / 20.0) as bigint) * 2 + user_id % 2 + 1",
    "possession": (
        "case when event_type = 'error' then 0 "
        "else cast(floor(user_id / 20.0) as bigint) * 2 + user_id % 2 + 1 end"
    ),
    "action_type": "event_type",
}

DAY_STATUS = {
    "day": "cast(o_orderdate as date)",
    "total_events": "count(*)",
    "missing_count": "cast(sum(case when o_orderstatus = 'P' then 1 else 0 end) as bigint)",
    "error": (
        "max(case when o_orderkey % 97 = 0 then 'HTTP 404 for event' "
        "when o_orderkey % 89 = 0 then 'paid cache miss blocked' else '' end)"
    ),
    "note": "max(case when o_orderkey % 83 = 0 then 'missing events list response' else '' end)",
}

USAGE = {
    "ts": "ts",
    "endpoint": "event_type",
    "request_key": "event_id",
    "credits": "event_id % 5",
    "remaining": "500 - event_id % 400",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FLOORED = re.compile(r"cast\(floor\((\w+) / (\d+)\.0\) as (int|bigint)\)")


def whole_steps(expr: str) -> str:
    """The expression with floors of whole keys in whole numbers, for Spark.

    ``5000.0`` is a decimal there, and a decimal division of every row takes longer than the rest of a binding.
    """
    return _FLOORED.sub(r"cast(\1 div \2 - case when \1 % \2 < 0 then 1 else 0 end as \3)", expr)


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{whole_steps(expr)} as {name}" for name, expr in columns.items()])


def _select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} as {name}" for name, expr in columns.items())


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "lineitem"), QUOTES)


def event_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "orders"), EVENT_CONTEXT).distinct()


def slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "orders"), SLATE)


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "customer"), ROSTER)


def injuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "customer"), INJURIES)


def minutes_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "part"), MINUTES_PREDICTIONS)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")
    )
    return _project(joined, TICKETS)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "lineitem").groupBy(
        *[F.expr(whole_steps(e)).alias(n) for n, e in RESULTS_KEYS.items()]
    ).agg(*[F.expr(e).alias(n) for n, e in RESULTS_STATS.items()])
    return _project(keyed, RESULTS_ROW)


def boxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(
        *[F.expr(whole_steps(e)).alias(n) for n, e in BOXSCORE_KEYS.items()]
    ).agg(*[F.expr(e).alias(n) for n, e in BOXSCORE_STATS.items()])


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), ACTIONS)


def day_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = dict(DAY_STATUS)
    day = columns.pop("day")
    return table(spark, sf_dir, "orders").groupBy(F.expr(day).alias("day")).agg(
        *[F.expr(e).alias(n) for n, e in columns.items()]
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), USAGE)


# The same tables as DuckDB common table expressions.
SQL = {
    "fx_quotes": f"select {_select_list(QUOTES)} from lineitem",
    "fx_context": f"select distinct {_select_list(EVENT_CONTEXT)} from orders",
    "fx_slate": f"select {_select_list(SLATE)} from orders",
    "fx_roster": f"select {_select_list(ROSTER)} from customer",
    "fx_injuries": f"select {_select_list(INJURIES)} from customer",
    "fx_minutes": f"select {_select_list(MINUTES_PREDICTIONS)} from part",
    "fx_tickets": f"select {_select_list(TICKETS)} from lineitem join orders on l_orderkey = o_orderkey",
    "fx_results": (
        f"select {_select_list(RESULTS_ROW)} from (select {_select_list(RESULTS_KEYS | RESULTS_STATS)} "
        "from lineitem group by 1, 2, 3)"
    ),
    "fx_boxscore": (
        f"select {_select_list(BOXSCORE_KEYS | BOXSCORE_STATS)} from events group by 1, 2, 3, 4"
    ),
    "fx_actions": f"select {_select_list(ACTIONS)} from events",
    "fx_day_status": f"select {_select_list(DAY_STATUS)} from orders group by 1",
    "fx_usage": f"select {_select_list(USAGE)} from events",
}
