"""Day completeness, dataset summaries, exports, credits and identity upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import names, parsing, states
from oddsloom.operators import context as ctx
from oddsloom.operators.views import top


def canonical_status(days: DataFrame) -> DataFrame:
    """Reason codes, status code and coverage of stored day rows.

    Needs day, total_events, missing_count, error and note.
    """
    note, error = parsing.text(F.col("note")), parsing.text(F.col("error"))
    total = F.greatest(F.lit(0), F.col("total_events"))
    missing = F.greatest(F.lit(0), F.col("missing_count"))
    complete = (missing == 0) & (error == "") & (note == "")
    present = F.greatest(F.lit(0), total - missing)
    none = F.lit(None).cast("array<string>")
    staged = days.withColumns(
        {
            "complete": complete,
            "present_event_odds": present,
            "reason_codes": states.day_reason_codes(complete, none, error, note, missing),
        }
    )
    return staged.withColumns(
        {
            "status_code": states.day_status_code(F.col("complete"), F.col("reason_codes")),
            "error_code": F.when(F.col("complete"), "").otherwise(
                states.primary_reason(F.col("reason_codes"))
            ),
            "odds_coverage_ratio": states.coverage_ratio(present, total, total > 0),
        }
    )


def compute_status(expected: DataFrame, cached: DataFrame) -> DataFrame:
    """Completeness per day from expected requests and cached keys."""
    found = cached.select("request_key").distinct().withColumn("cached", F.lit(True))
    joined = expected.join(found, "request_key", "left")
    return joined.groupBy("day").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("cached").isNull()).alias("missing_count"),
        F.lit("").alias("error"),
        F.lit("").alias("note"),
    )


def missing_requests(expected: DataFrame, cached: DataFrame) -> DataFrame:
    return expected.join(cached.select("request_key"), "request_key", "left_anti")


def credit_estimate(
    missing: DataFrame, markets: int, bookmakers: int = 0, regions: int = 1, historical: bool = True
) -> DataFrame:
    """Credits to fetch missing requests per day: markets times region equivalents."""
    factor = max(1, -(-bookmakers // 10)) if bookmakers else max(1, regions)
    price = markets * factor * (10 if historical else 1)
    return missing.groupBy("day").agg(F.count(F.lit(1)).alias("missing_requests")).withColumn(
        "estimated_credits", F.col("missing_requests") * price
    )


def status_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("total_days"),
        F.count_if("complete").alias("complete_count"),
        F.count_if(~F.col("complete")).alias("incomplete_count"),
        F.sum("missing_count").alias("missing_events_total"),
        F.avg("odds_coverage_ratio").alias("avg_odds_coverage_ratio"),
        F.min("odds_coverage_ratio").alias("minimum_odds_coverage_ratio"),
    )


def reason_counts(status: DataFrame) -> DataFrame:
    return status.where(~F.col("complete")).groupBy("error_code").agg(F.count(F.lit(1)).alias("days"))


def preflight(status: DataFrame, allowed_days: list[str], allowed_reasons: list[str]) -> DataFrame:
    """Incomplete days that no allowance covers."""
    allowed = F.col("day").cast("string").isin(*allowed_days) | F.col("error_code").isin(*allowed_reasons)
    return status.where(~F.col("complete") & ~allowed)


def fact_outcomes(quotes: DataFrame, requests: DataFrame, dataset_id: str) -> DataFrame:
    """Quotes with day and the first request key of their event."""
    first_key = (
        requests.where(F.col("label").startswith("event_odds:"))
        .select("snapshot_id", F.trim(F.substring_index("label", ":", -1)).alias("event_id"), "request_key")
        .where(F.col("event_id") != "")
        .groupBy("snapshot_id", "event_id")
        .agg(F.min("request_key").alias("request_key"))
    )
    return quotes.join(first_key, ["snapshot_id", "event_id"], "left").select(
        F.lit(dataset_id).alias("dataset_id"), "day", "snapshot_id", "event_id", "request_key",
        "market", "player", "side", "point", "book", "price", "last_update", "link",
    )


def monthly_usage(usage: DataFrame) -> DataFrame:
    """Credits per month with the last remaining figure."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    return usage.groupBy(month).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("credits").alias("total_credits"),
        F.max_by("remaining", F.struct("ts", "request_key")).alias("provider_remaining"),
    )


def endpoint_usage(usage: DataFrame, top_n: int = 10) -> DataFrame:
    month = F.date_format("ts", "yyyy-MM").alias("month")
    summed = usage.groupBy(month, "endpoint").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("credits").alias("credits")
    )
    return top(summed, ["month"], [F.col("credits").desc(), F.col("endpoint").asc()], top_n)


def budget_status(monthly: DataFrame, cap: int) -> DataFrame:
    limit = max(0, cap)
    return monthly.select(
        "month",
        F.col("total_credits").alias("used_credits"),
        F.lit(limit).alias("cap_credits"),
        F.greatest(F.lit(0), F.lit(limit) - F.col("total_credits")).alias("remaining_credits"),
        (F.col("total_credits") >= limit).alias("cap_reached"),
    )


def live_window(events: DataFrame, now: Column, pre_hours: int, post_hours: int) -> DataFrame:
    """First and last tip per snapshot, the playing window around them and if now is inside."""
    tips = events.groupBy("snapshot_id").agg(
        F.count("commence_time").alias("event_count"),
        F.min("commence_time").alias("first_tip"),
        F.max("commence_time").alias("last_tip"),
    )

    def shift(column: str, hours: int) -> Column:
        return F.timestamp_seconds(F.unix_timestamp(column) + 3600 * hours)

    windowed = tips.withColumns(
        {
            "window_start": shift("first_tip", -max(0, pre_hours)),
            "window_end": shift("last_tip", max(0, post_hours)),
            "odds_from": F.timestamp_seconds(F.unix_timestamp(F.date_trunc("hour", "first_tip")) - 14400),
            "odds_to": F.timestamp_seconds(F.unix_timestamp(F.date_trunc("hour", "last_tip")) + 14400),
        }
    )
    return windowed.withColumn(
        "within_window", F.coalesce(now.between(F.col("window_start"), F.col("window_end")), F.lit(False))
    )


def identity_map(quotes: DataFrame, context: DataFrame, roster: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Players with aliases, spellings, events and teams seen, on top of an earlier map.

    Quotes shrink to distinct (snapshot, event, player) first.
    """
    seen = quotes.select("snapshot_id", "event_id", "player").distinct()
    keyed = ctx.with_aliases(seen).where(F.size("aliases") > 0)
    placed = keyed.join(ctx.event_rosters(context, ctx.team_rosters(roster)), ctx.EVENT, "left")
    rows = placed.select(
        F.get("aliases", 0).alias("player_key"), "player", "event_id", "aliases",
        ctx._exclusive_team().alias("team"),
    )
    sets = rows.groupBy("player_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"),
        F.array_sort(F.collect_set("player")).alias("odds_api_names"),
        F.array_sort(F.collect_set("event_id")).alias("last_seen_event_ids"),
        F.array_sort(F.collect_set("team")).alias("teams"),
    )
    if prior is None:
        return sets
    both = sets.unionByName(prior.select(*sets.columns))
    return both.groupBy("player_key").agg(
        *[
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
            for c in ("aliases", "odds_api_names", "last_seen_event_ids", "teams")
        ]
    )
