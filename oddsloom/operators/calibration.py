"""Rolling priors, calibration feedback and walk-forward calibration maps.

Tickets shrink to one row per (strategy, market, side, bin, day) in a single map-side
combined aggregation. Windows and maps are sums over those rows; no history is ever
re-read per day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions import odds, parsing

PRIOR_SIDES = ("over", "under")


@dataclass(frozen=True)
class PriorSettings:
    """How history is windowed, shrunk and bounded."""

    window_days: int = 21
    min_samples: int = 25
    max_abs_delta: float = 0.02
    bin_size: float = 0.1
    min_bin_samples: int = 10
    calibration_max_abs_delta: float = 0.02
    shrink_k: int = 100
    bucket_weight: float = 0.3


def daily_outcomes(tickets: DataFrame, size: float, clamped: bool = True) -> DataFrame:
    """Wins, losses and probability sums per strategy, market, side, bin and day.

    ``bin`` is null for rows without a usable probability.
    """
    result = parsing.result_label(F.col("result"), with_push=False)
    raw = F.col("model_p_hit").cast("double")
    usable = F.when((raw >= 0.0) & (raw <= 1.0), raw)
    p = odds.clamp_probability(usable) if clamped else usable
    prepared = tickets.select(
        F.lower(F.trim("strategy_id")).alias("strategy_id"),
        F.lower(F.trim("market")).alias("market"),
        F.lower(F.trim("recommended_side")).alias("side"),
        F.col("modeled_day").alias("day"),
        result.alias("result"),
        p.alias("p"),
        odds.bin_index(p, size).alias("bin"),
    ).where(F.col("result").isin("win", "loss") & F.col("day").isNotNull())
    return prepared.groupBy("strategy_id", "market", "side", "bin", "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("result") == "win").alias("wins"),
        F.sum("p").alias("p_sum"),
    )


def windowed_outcomes(daily: DataFrame, as_of_days: DataFrame, window_days: int) -> DataFrame:
    """Daily rows summed over the days strictly before each as-of day.

    A day row counts for the next ``window_days`` as-of days, so it is copied forward that
    many times and met with the wanted days by equality.
    """
    ahead = F.explode(F.sequence(F.lit(1), F.lit(max(1, window_days))))
    shifted = daily.where(
        (F.col("market") != "") & F.col("side").isin(*PRIOR_SIDES)
    ).withColumn("ahead", ahead).withColumn("as_of", F.date_add("day", F.col("ahead")))
    wanted = as_of_days.select("as_of").distinct()
    return (
        shifted.join(wanted, "as_of", "left_semi")
        .groupBy("as_of", "strategy_id", "market", "side", "bin")
        .agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum("p_sum").alias("p_sum"))
    )


def prior_adjustments(windowed: DataFrame, settings: PriorSettings = PriorSettings()) -> DataFrame:
    """Market-side priors: hit rate, Laplace posterior and a coverage-scaled bounded delta."""
    summed = windowed.groupBy("as_of", "strategy_id", "market", "side").agg(
        F.sum("n").alias("sample_size"), F.sum("wins").alias("wins")
    )
    posterior = (F.col("wins") + 1.0) / (F.col("sample_size") + 2)
    coverage = F.least(F.lit(1.0), F.col("sample_size") / float(max(1, settings.min_samples)))
    bound = max(0.0, settings.max_abs_delta)
    return summed.select(
        "as_of", "strategy_id", "market", "side", "sample_size", "wins",
        (F.col("sample_size") - F.col("wins")).alias("losses"),
        odds.round6(F.col("wins") / F.col("sample_size")).alias("hit_rate"),
        odds.round6(posterior).alias("posterior_hit_rate"),
        odds.round6(odds.clamp((posterior - 0.5) * coverage, -bound, bound)).alias("delta"),
    )


def _bin_columns(size: float) -> list[Column]:
    avg_p = F.col("p_sum") / F.col("n")
    hit_rate = F.col("wins") / F.col("n")
    return [
        F.col("bin").alias("bucket_index"),
        odds.round6(odds.bin_low(F.col("bin"), size)).alias("bucket_low"),
        odds.round6(odds.bin_high(F.col("bin"), size)).alias("bucket_high"),
        F.col("n").alias("count"),
        odds.round6(avg_p).alias("avg_model_p"),
        odds.round6(hit_rate).alias("hit_rate"),
        odds.round6(hit_rate - avg_p).alias("delta"),
    ]


def prior_bins(windowed: DataFrame, settings: PriorSettings = PriorSettings()) -> DataFrame:
    """Calibration bins per market and side, and over all of them (``scope`` tells which)."""
    size = odds.bin_size(settings.bin_size)
    scored = windowed.where(F.col("bin").isNotNull())
    totals = [F.sum(c).alias(c) for c in ("n", "wins", "p_sum")]
    narrow = scored.select(
        "as_of", "strategy_id", F.lit("market_side").alias("scope"), "market", "side", *_bin_columns(size)
    )
    wide = scored.groupBy("as_of", "strategy_id", "bin").agg(*totals).select(
        "as_of", "strategy_id", F.lit("global").alias("scope"), F.lit("").alias("market"),
        F.lit("").alias("side"), *_bin_columns(size),
    )
    return narrow.unionByName(wide)


def prior_profiles(
    adjustments: DataFrame, bins: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Priors folded for lookup: per market side and per strategy, bins as a small map.

    A map has at most 51 entries, the number of bins at the narrowest width.
    """
    entry = F.struct(
        F.col("bucket_index"), F.struct("count", "delta", "bucket_low", "bucket_high")
    )
    folded = F.map_from_entries(F.collect_list(entry))
    keys = ["as_of", "strategy_id", "market", "side"]
    narrow = (
        bins.where(F.col("scope") == "market_side").groupBy(*keys).agg(folded.alias("side_bins"))
    )
    wide = (
        bins.where(F.col("scope") == "global")
        .groupBy("as_of", "strategy_id")
        .agg(folded.alias("global_bins"))
    )
    side = adjustments.select(
        *keys, F.col("delta").alias("prior_delta"), F.col("sample_size").alias("prior_sample_size"),
        F.col("hit_rate").alias("prior_hit_rate"),
    ).join(narrow, keys, "left")
    return side, wide


def _bucket_of(p: Column, settings: PriorSettings) -> Column:
    """struct(clamped, index, side, wide): a probability with the bins it falls in; null bins are too small."""
    clamped = odds.clamp_probability(F.when((p >= 0.0) & (p <= 1.0), p))
    index = odds.bin_index(clamped, odds.bin_size(settings.bin_size))

    def enough(bins: str) -> Column:
        found = F.try_element_at(F.col(bins), index)
        return F.when(found["count"] >= max(1, settings.min_bin_samples), found)

    return F.struct(
        clamped.alias("clamped"), index.alias("index"), enough("side_bins").alias("side"), enough("global_bins").alias("wide")
    )


def _feedback_of(found: Column, settings: PriorSettings) -> Column:
    size = odds.bin_size(settings.bin_size)
    clamped, index, by_side, overall = (found[c] for c in ("clamped", "index", "side", "wide"))
    valid = clamped.isNotNull()
    bucket = F.coalesce(by_side, overall)
    prior = F.coalesce("prior_delta", F.lit(0.0))
    prior_rows = F.coalesce("prior_sample_size", F.lit(0))
    untouched = bucket.isNull() & (prior_rows <= 0)
    count = F.coalesce(bucket["count"], prior_rows)
    weight = F.when(by_side.isNotNull(), 1.0).when(overall.isNotNull(), 0.85).otherwise(0.7)
    blend = min(1.0, max(0.0, settings.bucket_weight))
    raw = F.coalesce(prior * (1.0 - blend) + bucket["delta"] * blend, prior)
    bound = max(0.0, settings.calibration_max_abs_delta)
    delta = odds.clamp(
        raw * (count / (count + float(max(1, settings.shrink_k)))) * weight, -bound, bound
    )
    coverage = F.least(F.lit(1.0), count / float(max(1, settings.min_bin_samples)))
    source = (
        F.when(~valid, "unavailable")
        .when(by_side.isNotNull(), "market_side")
        .when(overall.isNotNull(), "global")
        .when(prior_rows > 0, "adjustment")
        .otherwise("none")
    )
    return F.struct(
        F.when(
            valid,
            odds.round6(F.when(untouched, clamped).otherwise(odds.clamp_probability(clamped + delta))),
        ).alias("p_calibrated"),
        F.when(valid, F.when(untouched, F.lit(0.0)).otherwise(odds.round6(delta))).alias("delta"),
        source.alias("source"),
        F.when(~valid, F.lit(0)).otherwise(count).cast("long").alias("sample_size"),
        F.when(~valid | untouched, F.lit(0.0))
        .otherwise(odds.round6(coverage * weight))
        .alias("confidence"),
        F.when(valid, index).alias("bucket_index"),
        F.when(untouched, odds.round6(odds.bin_low(index, size)))
        .otherwise(bucket["bucket_low"])
        .alias("bucket_low"),
        F.when(untouched, odds.round6(odds.bin_high(index, size)))
        .otherwise(bucket["bucket_high"])
        .alias("bucket_high"),
    )


def feedback(p: Column, settings: PriorSettings = PriorSettings()) -> Column:
    """Calibrated probability struct; needs the columns joined by :func:`with_profiles`."""
    return _feedback_of(_bucket_of(p, settings), settings)


def with_feedback(df: DataFrame, columns: dict[str, str], settings: PriorSettings = PriorSettings()) -> DataFrame:
    """The :func:`feedback` of probability columns, by name of the struct.

    Bins are looked up in a projection of their own: as one expression, every use would search the maps again.
    """
    found = df.withColumns({f"_of_{name}": _bucket_of(F.col(p), settings) for name, p in columns.items()})
    fed = found.withColumns({name: _feedback_of(F.col(f"_of_{name}"), settings) for name in columns})
    return fed.drop(*[f"_of_{name}" for name in columns])


def with_profiles(df: DataFrame, side: DataFrame, wide: DataFrame) -> DataFrame:
    """Joins prior profiles on (as_of, prior_source, market, side); needs those columns."""
    narrow = side.withColumnsRenamed({"strategy_id": "prior_source", "side": "prior_side", "market": "prior_market"})
    keyed = df.withColumns(
        {"prior_market": F.lower(F.trim("market")), "prior_side": F.lower(F.trim("recommended_side"))}
    )
    return (
        keyed.join(narrow, ["as_of", "prior_source", "prior_market", "prior_side"], "left")
        .join(wide.withColumnRenamed("strategy_id", "prior_source"), ["as_of", "prior_source"], "left")
        .drop("prior_market", "prior_side")
    )


# --- calibration maps -------------------------------------------------------------------


def _map_columns(size: float) -> list[Column]:
    return [
        odds.round6(F.col("bin") * F.lit(size)).alias("low"),
        odds.round6(F.least(F.lit(1.0), F.col("bin") * F.lit(size) + F.lit(size))).alias("high"),
        F.col("n").alias("count"),
        odds.round6(F.col("p_sum") / F.col("n")).alias("avg_p"),
        odds.round6(F.col("wins") / F.col("n")).alias("hit_rate"),
    ]


def calibration_map(tickets: DataFrame, size: float = 0.05) -> DataFrame:
    """Calibration bins per strategy over all its scored tickets."""
    daily = daily_outcomes(tickets, size, clamped=False).where(F.col("bin").isNotNull())
    return (
        daily.groupBy("strategy_id", "bin")
        .agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum("p_sum").alias("p_sum"))
        .select("strategy_id", "bin", *_map_columns(size))
    )


def walk_forward_map(tickets: DataFrame, size: float = 0.05) -> DataFrame:
    """Calibration bins of every ticket day from strictly earlier days.

    Runs on daily sums: days times bins rows per strategy, whatever the ticket volume. Days
    and bins are made dense so that a bin unseen on a day still carries its history; the
    running sums are ordered per (strategy, bin), so one strategy spreads over its bins.
    """
    daily = daily_outcomes(tickets, size, clamped=False).where(F.col("bin").isNotNull())
    sums = daily.groupBy("strategy_id", "day", "bin").agg(
        F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum("p_sum").alias("p_sum")
    )
    days = sums.select("strategy_id", "day").distinct()
    bins = F.explode(F.sequence(F.lit(0), F.lit(int(1.0 / size)))).alias("bin")
    grid = days.select("strategy_id", "day", bins)
    before = (
        Window.partitionBy("strategy_id", "bin")
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = grid.join(sums, ["strategy_id", "day", "bin"], "left").select(
        "strategy_id", "day", "bin", *[F.sum(c).over(before).alias(c) for c in ("n", "wins", "p_sum")]
    )
    return running.where(F.col("n") > 0).select("strategy_id", "day", "bin", *_map_columns(size))


def confidence_tier(p: Column, quality: Column, uncertainty: Column) -> Column:
    q = F.coalesce(odds.clamp(quality, 0.0, 1.0), F.lit(0.0))
    u = F.coalesce(F.greatest(F.lit(0.0), uncertainty), F.lit(1.0))
    return (
        F.when(p.isNull(), "unrated")
        .when((p >= 0.57) & (q >= 0.7) & (u <= 0.05), "high")
        .when((p >= 0.53) & (q >= 0.55) & (u <= 0.08), "medium")
        .otherwise("low")
    )


def conservative_probability(df: DataFrame) -> Column:
    """Lower probability of the picked side, with model values as fallback."""

    def maybe(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("double")

    side = F.lower(F.trim("recommended_side"))
    by_side = F.when(
        side == "over", F.coalesce(maybe("p_over_low"), maybe("p_over_model"))
    ).when(side == "under", F.coalesce(maybe("p_under_low"), maybe("p_under_model")))
    value = F.coalesce(maybe("p_hit_low"), by_side, maybe("model_p_hit"))
    return F.when((value >= 0.0) & (value <= 1.0), value)


def annotate(rows: DataFrame, bins: DataFrame, day_column: str | None = "day", mode: str = "walk_forward") -> DataFrame:
    """Rows with calibrated probability and confidence tier from a calibration map.

    ``bins`` are map rows (with ``day`` for walk-forward). Each map is folded to an array of
    its bins, at most 51, so the range test is a scan of a short array, not a range join.
    """
    keys = ["strategy_id"] if day_column is None else ["strategy_id", day_column]
    folded = bins.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("low", "high", "hit_rate", "count"))).alias("bins")
    )
    p = F.col("p_conservative")
    hit = F.get(
        F.filter(
            "bins",
            lambda b: ((b["low"] <= p) & (p < b["high"])) | ((b["high"] >= 1.0) & (p <= b["high"])),
        ),
        0,
    )
    joined = rows.withColumn("p_conservative", conservative_probability(rows)).join(folded, keys, "left")
    found = joined.withColumn("hit_bin", F.when(p.isNotNull(), hit))
    calibrated = odds.round6(odds.clamp(F.col("hit_bin.hit_rate"), 0.0, 1.0))
    return found.withColumns(
        {
            "p_conservative": odds.round6(p),
            "p_calibrated": calibrated,
            "calibration_bin_low": F.col("hit_bin.low"),
            "calibration_bin_high": F.col("hit_bin.high"),
            "calibration_bin_count": F.col("hit_bin.count"),
            "calibration_map_mode": F.lit(mode),
            "confidence_tier": confidence_tier(
                calibrated, F.col("quality_score"), F.col("uncertainty_band")
            ),
        }
    ).drop("bins", "hit_bin")
