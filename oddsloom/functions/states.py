"""Status words: injuries, games, day completeness and their fixed orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsloom.functions.parsing import strip, text

# How grave an injury status is when sources disagree.
INJURY_SEVERITY = {
    "unknown": 0,
    "available": 1,
    "day_to_day": 1,
    "probable": 2,
    "questionable": 3,
    "doubtful": 4,
    "out": 5,
    "out_for_season": 6,
}

# Statuses listed as key injuries, gravest first.
KEY_INJURY_RANK = {"out_for_season": 5, "out": 4, "doubtful": 3, "questionable": 2}

# Reasons for an incomplete day, most decisive first.
INCOMPLETE_REASON_PRIORITY = (
    "budget_exceeded",
    "spend_blocked",
    "offline_cache_miss",
    "upstream_404",
    "upstream_error",
    "missing_events_list",
    "invalid_events_list_payload",
    "missing_event_odds",
    "note",
    "incomplete_unknown",
)


def rank_of(value: Column, table: dict[str, int]) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(0))


def injury_status(note: Column) -> Column:
    """Injury status read from free text; the first matching phrase decides."""
    value = F.replace(F.lower(note), F.lit("-"), F.lit(" "))
    return (
        F.when(value.contains("out for season"), "out_for_season")
        .when(value.contains("available"), "available")
        .when(value.rlike(r"\bout\b"), "out")
        .when(value.contains("doubtful"), "doubtful")
        .when(value.contains("questionable") | value.contains("game time decision"), "questionable")
        .when(value.contains("probable"), "probable")
        .when(value.contains("day to day"), "day_to_day")
        .otherwise("unknown")
    )


def game_status(code: Column, status_text: Column) -> Column:
    number = code.cast("string").try_cast("double").try_cast("int")
    return (
        F.when((number == 3) | F.lower(strip(status_text)).startswith("final"), "final")
        .when(number == 2, "in_progress")
        .when(number == 1, "scheduled")
        .otherwise("unknown")
    )


def roster_detail(status: Column) -> Column:
    return (
        F.when(status == "unknown_event", "event_id_missing_from_event_context")
        .when(status == "unknown_roster", "event_teams_missing_from_roster_snapshot")
        .when(status == "not_on_roster", "player_not_found_on_event_team_rosters")
        .when(status == "inactive", "player_marked_inactive_in_roster_snapshot")
        .otherwise("ok")
    )


def roster_warning(status: Column, player: Column, event_id: Column) -> Column:
    """Warning sentence for a doubtful roster status, else null."""
    ending = (
        F.when(status == "unknown_roster", ") has unknown_roster: active/inactive status not found.")
        .when(status == "unknown_event", ") has unknown_event: missing event team context.")
        .when(status == "inactive", ") is marked inactive in roster feed.")
        .when(status == "not_on_roster", ") is not on either event roster feed.")
    )
    return F.concat(player, F.lit(" ("), event_id, ending)


def clean_injury(status: Column) -> Column:
    return status.isin("available", "available_unlisted")


def clean_roster(status: Column) -> Column:
    return status.isin("active", "rostered")


def pre_bet_ready(injury: Column, roster: Column) -> Column:
    return clean_injury(injury) & clean_roster(roster)


def pre_bet_reason(injury: Column, roster: Column) -> Column:
    return (
        F.when(pre_bet_ready(injury, roster), F.lit("ok"))
        .when(~clean_injury(injury), F.concat(F.lit("injury_status="), injury))
        .otherwise(F.concat(F.lit("roster_status="), roster))
    )


def error_reason(error: Column) -> Column:
    """Reason code of an error message; null when there is no error."""
    value = F.lower(text(error))
    return (
        F.when(value == "", None)
        .when(value.contains("offline cache miss"), "offline_cache_miss")
        .when(value.contains("blocked"), "spend_blocked")
        .when(value.contains("exceed remaining budget"), "budget_exceeded")
        .when(value.contains("404"), "upstream_404")
        .otherwise("upstream_error")
    )


def note_reason(note: Column) -> Column:
    value = F.lower(text(note))
    return (
        F.when(value == "", None)
        .when(value == "missing events list response", "missing_events_list")
        .when(value == "invalid events list payload", "invalid_events_list_payload")
        .otherwise("note")
    )


def day_reason_codes(
    complete: Column, existing: Column, error: Column, note: Column, missing: Column
) -> Column:
    """Reason list of a day: given codes, else from error, note or the missing count."""
    given = F.array_distinct(
        F.filter(
            F.transform(F.coalesce(existing, F.array().cast("array<string>")), strip),
            lambda c: (c != "") & (c != "complete"),
        )
    )
    derived = F.coalesce(
        error_reason(error),
        note_reason(note),
        F.when(missing > 0, F.lit("missing_event_odds")),
        F.lit("incomplete_unknown"),
    )
    return (
        F.when(complete, F.array(F.lit("complete")))
        .when(F.size(given) > 0, given)
        .otherwise(F.array(derived))
    )


def primary_reason(codes: Column) -> Column:
    """Most decisive reason of a list; an unlisted code only if nothing else is there."""
    ranked = F.array(*[F.lit(r) for r in INCOMPLETE_REASON_PRIORITY])
    known = F.filter(ranked, lambda r: F.array_contains(codes, r))
    return F.coalesce(
        F.get(known, 0), F.get(codes, 0), F.lit("incomplete_unknown")
    )


def day_status_code(complete: Column, codes: Column) -> Column:
    return F.when(complete, F.lit("complete")).otherwise(
        F.concat(F.lit("incomplete_"), primary_reason(codes))
    )


def coverage_ratio(present: Column, total: Column, has_events: Column) -> Column:
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), present / total))).otherwise(
        F.when(has_events, F.lit(1.0)).otherwise(F.lit(0.0))
    )
