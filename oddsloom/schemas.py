"""Table contracts and payload types, always explicit, never inferred."""

from __future__ import annotations

# Ordered columns of each table with their Spark types.
TABLES: dict[str, dict[str, str]] = {
    "event_props": {
        "provider": "string", "snapshot_id": "string", "schema_version": "bigint",
        "event_id": "string", "market": "string", "player": "string", "side": "string",
        "price": "double", "point": "double", "book": "string", "last_update": "string",
        "link": "string",
    },
    "featured_odds": {
        "provider": "string", "snapshot_id": "string", "schema_version": "bigint",
        "game_id": "string", "market": "string", "book": "string", "price": "double",
        "point": "double", "side": "string", "last_update": "string",
    },
    "games": {
        "season": "string", "season_type": "string", "game_id": "string", "date": "string",
        "home_team_id": "string", "away_team_id": "string",
    },
    "boxscore_players": {
        "season": "string", "season_type": "string", "game_id": "string", "team_id": "string",
        "player_id": "string", "minutes": "double", "points": "double", "rebounds": "double",
        "assists": "double",
    },
    "pbp_events": {
        "season": "string", "season_type": "string", "game_id": "string", "event_num": "bigint",
        "clock": "string", "event_type": "string", "team_id": "string", "player_id": "string",
        "description": "string",
    },
    "possessions": {
        "season": "string", "season_type": "string", "game_id": "string",
        "possession_id": "string", "start_event_num": "bigint", "end_event_num": "bigint",
        "offense_team_id": "string", "defense_team_id": "string",
    },
    "fact_outcomes": {
        "dataset_id": "string", "day": "string", "snapshot_id": "string", "event_id": "string",
        "request_key": "string", "market": "string", "player": "string", "side": "string",
        "point": "double", "book": "string", "price": "double", "last_update": "string",
        "link": "string",
    },
    "dim_request": {
        "day": "string", "snapshot_id": "string", "request_key": "string",
        "request_label": "string", "request_path": "string", "request_status": "string",
        "updated_at_utc": "string", "param_bookmakers": "string", "param_regions": "string",
        "param_markets": "string", "param_date": "string", "param_odds_format": "string",
        "param_date_format": "string",
    },
    "dim_day_status": {
        "dataset_id": "string", "day": "string", "snapshot_id": "string",
        "day_complete": "boolean", "day_odds_coverage_ratio": "double",
        "day_missing_count": "bigint", "day_total_events": "bigint", "day_reason_code": "string",
        "events_timestamp": "string", "updated_at_utc": "string",
    },
}

REQUIRED_QUOTE_FIELDS = ("event_id", "market", "player", "side", "book", "price", "point")

_OUTCOME = "struct<name: string, description: string, price: double, point: double, link: string>"
_MARKET = f"struct<key: string, last_update: string, outcomes: array<{_OUTCOME}>>"
_BOOK = f"struct<key: string, last_update: string, markets: array<{_MARKET}>>"
EVENT_PAYLOAD = f"struct<id: string, bookmakers: array<{_BOOK}>>"
FEATURED_PAYLOAD = f"array<{EVENT_PAYLOAD}>"

_STATS = (
    "struct<minutes: string, minutesCalculated: string, points: string, reboundsTotal: string, "
    "rebounds: string, assists: string, threePointersMade: string>"
)
_PLAYER = f"struct<personId: string, name: string, status: string, statistics: {_STATS}>"
_TEAM = f"struct<teamId: string, teamCity: string, teamName: string, players: array<{_PLAYER}>>"
_ACTION = (
    "struct<actionNumber: bigint, actionId: bigint, clock: string, actionType: string, "
    "subType: string, teamId: bigint, personId: bigint, description: string, possession: bigint>"
)
BOXSCORE_PAYLOAD = f"struct<game: struct<gameId: string, homeTeam: {_TEAM}, awayTeam: {_TEAM}>>"
PLAYBYPLAY_PAYLOAD = f"struct<game: struct<gameId: string, actions: array<{_ACTION}>>>"
INJURY_FEED_PAYLOAD = (
    "struct<injuries: array<struct<displayName: string, injuries: array<struct<athlete: "
    "struct<displayName: string>, status: string, date: string, shortComment: string, "
    "longComment: string>>>>>"
)
