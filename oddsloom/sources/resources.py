"""Resource payloads of several shapes to rows; alias columns; expected requests; day ranges; raw mirrors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.operators.rosters import first_filled, last_event_context

#: Under which key a payload of each resource keeps its rows; ``data`` is the other one for all.
LIST_KEYS = {"enhanced_pbp": "events", "possessions": "possessions"}


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _parsed(text: Column) -> Column:
    """The one JSON value that a text holds; null otherwise. The parser stops after a value, so what follows it is
    found by reading the text as the items of a list."""
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def resource_rows(payloads: DataFrame) -> DataFrame:
    """(game_id, resource, body) payloads to (game_id, row), where ``row`` is JSON text of an object.

    A list gives its items. An object gives those of the list under its resource's key, else of the list under
    ``data``, else itself; an empty list is a list. Items that are no objects are dropped, and so are bodies that are no
    JSON. A row that has a ``game_id`` keeps it, even a blank one; others get the payload's.
    """
    body = _parsed(F.col("body"))

    def items(path: str) -> Column:
        return F.try_variant_get(body, path, "array<variant>")

    own = [F.when(F.col("resource") == name, items(f"$.{key}")) for name, key in LIST_KEYS.items()]
    found = F.when(_is(body, "ARRAY"), items("$")).when(
        _is(body, "OBJECT"), F.coalesce(*own, items("$.data"), F.array(body))
    )
    rows = payloads.select("game_id", F.explode(F.filter(found, lambda v: _is(v, "OBJECT"))).alias("item"))
    text = F.to_json("item")
    has_own = F.array_contains(F.json_object_keys(text), "game_id")
    own_id = F.coalesce(F.get_json_object(text, "$.game_id"), F.lit(""))
    return rows.select(F.when(has_own, own_id).otherwise(F.col("game_id")).alias("game_id"), text.alias("row"))


#: Labels of responses that list events; those of one event's odds begin with the other one.
EVENT_LISTS = ("events_list", "slate_odds")
EVENT_ODDS = "event_odds:"


def event_context(responses: DataFrame) -> DataFrame:
    """snapshot_id, event_id, home_team, away_team and commence_time from stored responses of three kinds.

    ``responses`` has snapshot_id, label, request_order and body (JSON text). Lists of events and the slate are lists, odds
    of an event are one object; a body of another shape or label names no event, nor does an item without id. Of an
    event's mentions the last one counts, by request and then by place in its list; absent values are ''.
    """
    body, label = _parsed(F.col("body")), F.col("label")
    listed = F.try_variant_get(body, "$", "array<variant>")
    items = F.when(label.isin(*EVENT_LISTS) & _is(body, "ARRAY"), listed).when(
        label.startswith(EVENT_ODDS) & _is(body, "OBJECT"), F.array(body)
    )
    found = responses.select("snapshot_id", "request_order", F.posexplode(items).alias("place", "item"))

    def field(name: str) -> Column:
        return F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit("")).alias(name)

    rows = found.where(_is(F.col("item"), "OBJECT")).select(
        "snapshot_id",
        field("id").alias("event_id"),
        F.struct("request_order", "place").alias("request_order"),
        *[field(c) for c in ("home_team", "away_team", "commence_time")],
    )
    return last_event_context(rows)


def aliased(rows: DataFrame, columns: dict[str, tuple[str, ...]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns filled from the first of their aliases (fields of the JSON text ``row``) that is not blank."""
    return rows.select(
        *keep,
        *[
            first_filled(*[F.get_json_object("row", f"$.{alias}") for alias in aliases]).alias(name)
            for name, aliases in columns.items()
        ],
    )


# Spellings of the same field in different feeds.
PLAYER_ALIASES = {
    "player_id": ("player_id", "person_id", "personId"),
    "team_id": ("team_id", "teamId", "TEAM_ID"),
    "minutes": ("minutes", "min"),
}
EVENT_ALIASES = {
    "event_num": ("event_num", "eventnum", "actionNumber"),
    "team_id": ("team_id", "teamId", "offense_team_id"),
}


def day_range(ranges: DataFrame) -> DataFrame:
    """A row for each day from ``from_day`` to ``to_day``; a range that runs backwards has none."""
    valid = ranges.where(F.col("from_day") <= F.col("to_day"))
    return valid.withColumn("day", F.explode(F.sequence("from_day", "to_day", F.expr("interval 1 day"))))


@dataclass(frozen=True)
class RequestSpec:
    """What a dataset asks for; books go before regions."""

    sport: str
    markets: tuple[str, ...]
    bookmakers: str | None = None
    regions: str | None = "us"
    odds_format: str = "american"
    date_format: str = "iso"
    include_links: bool = False
    include_sids: bool = False
    historical: bool = False
    anchor_hour: int = 12
    time_zone: str = "America/New_York"


def _text(value: str | None) -> Column:
    return F.lit(value or None).cast("string")


def _iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def expected_requests(events: DataFrame, spec: RequestSpec) -> DataFrame:
    """Odds request of each (day, event_id, commence_time) with its parameters; null: not sent.

    Markets are sorted, books stay in the order given. A historical request has its own path and a date, its start.
    """
    historical = "/historical" if spec.historical else ""
    return events.select(
        "day",
        "event_id",
        F.concat(F.lit(f"{historical}/sports/{spec.sport}/events/"), "event_id", F.lit("/odds")).alias("path"),
        F.lit(",".join(sorted(set(spec.markets)))).alias("markets"),
        _text(spec.odds_format).alias("odds_format"),
        _text(spec.date_format).alias("date_format"),
        _text(spec.bookmakers).alias("bookmakers"),
        _text(None if spec.bookmakers else spec.regions).alias("regions"),
        _text("true" if spec.include_links else None).alias("include_links"),
        _text("true" if spec.include_sids else None).alias("include_sids"),
        (_iso(F.col("commence_time")) if spec.historical else _text(None)).alias("date"),
    )


def events_requests(days: DataFrame, spec: RequestSpec) -> DataFrame:
    """Request for the events of each day: as of an hour of the day where it is historical, else over the day."""
    start = F.to_utc_timestamp(F.col("day").cast("timestamp_ntz").cast("timestamp"), spec.time_zone)
    hour = max(0, min(spec.anchor_hour, 23))
    anchor = F.to_utc_timestamp(
        (F.col("day").cast("timestamp_ntz") + F.expr(f"interval {hour} hour")).cast("timestamp"), spec.time_zone
    )
    end = F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp_ntz").cast("timestamp"), spec.time_zone)
    historical = "/historical" if spec.historical else ""
    return days.select(
        "day",
        F.lit(f"{historical}/sports/{spec.sport}/events").alias("path"),
        _text(spec.date_format).alias("date_format"),
        (_iso(anchor) if spec.historical else _text(None)).alias("date"),
        (_text(None) if spec.historical else _iso(start)).alias("commence_from"),
        (_text(None) if spec.historical else _iso(end - F.expr("interval 1 second"))).alias("commence_to"),
    )


def valid_mirrors(files: DataFrame) -> DataFrame:
    """Whether each mirror file (path, resource, content) is usable.

    A box score is one object, however it is laid out. The others are lines: there must be one, and the first three
    must each be an object; a blank one among them is not.
    """
    lines = F.split("content", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]")
    # A break at the end starts no line.
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    first = F.forall(F.slice(lines, 1, 3), lambda x: _is(_parsed(x), "OBJECT"))
    usable = F.when(F.col("resource") == "boxscore", _is(_parsed(F.col("content")), "OBJECT")).otherwise(
        (F.size(lines) > 0) & first
    )
    return files.select("path", F.coalesce((F.length("content") > 0) & usable, F.lit(False)).alias("valid"))
