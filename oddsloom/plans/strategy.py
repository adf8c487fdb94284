"""Strategy report: quotes and context to candidates under many recipes in one job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import clocks, labels, odds
from oddsloom.operators import adjustments, calibration, candidates, context, portfolio, pricing
from oddsloom.plans import recipes as recipe_book
from oddsloom.session import discard, materialize, stage_path
from oddsloom.session import settings as session_settings


@dataclass(frozen=True)
class StrategyInputs:
    """Tables of one or many snapshots."""

    quotes: DataFrame
    event_context: DataFrame
    slate: DataFrame
    roster: DataFrame
    injuries: DataFrame
    minutes: DataFrame | None = None
    tickets: DataFrame | None = None
    identity: DataFrame | None = None
    context_flags: DataFrame | None = None


@dataclass(frozen=True)
class StrategySettings:
    """Run settings shared by all recipes."""

    top_n: int = 25
    max_picks: int = 5
    min_ev: float = 0.01
    allow_tier_b: bool = False
    stale_quote_minutes: int = 20
    require_official_injuries: bool = True
    require_fresh_context: bool = True
    caps: portfolio.Caps = field(default_factory=portfolio.Caps)
    priors: calibration.PriorSettings = field(default_factory=calibration.PriorSettings)


def contextual_lines(inputs: StrategyInputs, settings: StrategySettings = StrategySettings()) -> DataFrame:
    """Priced lines with reference reading, event lines, player context and adjustments."""
    lines = candidates.with_reference(
        pricing.priced_lines(inputs.quotes, settings.stale_quote_minutes)
    )
    # Every quote is on a line: the keys need no pricing, which would be worked out a second time for them.
    players = context.player_context(
        pricing.typed_quotes(inputs.quotes).select("snapshot_id", "event_id", "player"),
        inputs.event_context,
        inputs.roster,
        inputs.injuries,
        inputs.identity,
    )
    events = context.event_lines(inputs.slate, inputs.event_context).select(
        *context.EVENT, "home_team", "away_team", "tip_et", "spread_abs", "total",
        "commence_time",
    )
    mapped = inputs.event_context.select(*context.EVENT).distinct().withColumn("event_mapped", F.lit(True))
    joined = (
        lines.join(players, [*context.EVENT, "player"], "left")
        .join(events, context.EVENT, "left")
        .join(mapped, context.EVENT, "left")
        .withColumns(
            {
                "event_mapped": F.coalesce("event_mapped", F.lit(False)),
                "home_team": F.coalesce("home_team", F.lit("")),
                "away_team": F.coalesce("away_team", F.lit("")),
            }
        )
        .withColumn("game", F.trim(F.concat_ws(" @ ", "away_team", "home_team")))
    )
    return adjustments.with_minutes_model(adjustments.with_adjustments(joined), inputs.minutes)


def prior_tables(
    tickets: DataFrame, snapshots: DataFrame, settings: calibration.PriorSettings
) -> tuple[DataFrame, DataFrame]:
    """Prior profiles as of the day of each snapshot."""
    # Written, or the optimizer reads the day off every row that names a snapshot, before it drops repeats.
    named = materialize(snapshots.distinct(), "snapshots")
    days = named.select(clocks.snapshot_day(F.col("snapshot_id")).alias("as_of")).distinct()
    daily = calibration.daily_outcomes(tickets, odds.bin_size(settings.bin_size))
    # Both profiles are sums over these few rows; tickets are read for them once.
    windowed = materialize(
        calibration.windowed_outcomes(daily, days, settings.window_days), "prior-outcomes"
    )
    return calibration.prior_profiles(
        calibration.prior_adjustments(windowed, settings), calibration.prior_bins(windowed, settings)
    )


def _written_priors(inputs: StrategyInputs, settings: StrategySettings) -> tuple[DataFrame, DataFrame] | None:
    if inputs.tickets is None:
        return None
    side, wide = prior_tables(
        inputs.tickets, inputs.event_context.select("snapshot_id").distinct(), settings.priors
    )
    # A few rows for each market and side; as files, their plan stays out of the candidates' one.
    return materialize(side, "prior-sides"), materialize(wide, "prior-bins")


def _with_calibration(
    picked: DataFrame, priors: tuple[DataFrame, DataFrame] | None, settings: StrategySettings
) -> DataFrame:
    """Rolling-prior columns as of the day ``as_of``; recipes without priors keep the neutral values."""
    keyed = picked.withColumn(
        "prior_source",
        F.when(F.col("recipe.use_rolling_priors"), F.col("recipe.rolling_priors_source")),
    )
    if priors is None:
        joined = keyed.withColumns(
            {
                "prior_delta": F.lit(None).cast("double"),
                "prior_sample_size": F.lit(None).cast("long"),
                "prior_hit_rate": F.lit(None).cast("double"),
                "side_bins": F.expr(
                    "cast(null as map<int, struct<count: bigint, delta: double, "
                    "bucket_low: double, bucket_high: double>>)"
                ),
            }
        ).withColumn("global_bins", F.col("side_bins"))
    else:
        joined = calibration.with_profiles(keyed, *priors)
    fed = calibration.with_feedback(
        joined, {"hit_feedback": "model_p_hit", "low_feedback": "p_hit_low"}, settings.priors
    )
    p_hit = F.col("hit_feedback.p_calibrated")
    p_low = F.coalesce("low_feedback.p_calibrated", p_hit)
    return fed.withColumns(
        {
            "p_hit_calibrated": p_hit,
            "p_hit_low_calibrated": p_low,
            "ev_calibrated": odds.rounded_ev(p_hit, F.col("selected_price")),
            "ev_low_calibrated": odds.rounded_ev(p_low, F.col("selected_price")),
            "calibration_source": F.col("hit_feedback.source"),
            "calibration_sample_size": F.col("hit_feedback.sample_size"),
            "calibration_confidence": F.col("hit_feedback.confidence"),
            "calibration_delta": F.col("hit_feedback.delta"),
            "historical_prior_delta": F.coalesce("prior_delta", F.lit(0.0)),
            "historical_prior_sample_size": F.coalesce("prior_sample_size", F.lit(0)),
            "historical_prior_hit_rate": F.col("prior_hit_rate"),
        }
    ).drop(
        "hit_feedback", "low_feedback", "side_bins", "global_bins", "prior_delta",
        "prior_sample_size", "prior_hit_rate", "prior_source", "as_of",
    )


def _modeled(
    inputs: StrategyInputs,
    groups: dict[bool, list[tuple[tuple, dict]]],
    settings: StrategySettings,
    lines: DataFrame | None,
) -> list[DataFrame]:
    """Lines times pricing groups with their sides picked, written; one frame for each kind of group there is."""
    # One stage feeds the plain and the leave-one-out branches.
    lines = materialize(contextual_lines(inputs, settings), "lines") if lines is None else lines
    # A day is read off a line, not off each of its rows of twenty recipes.
    lines = lines.withColumn("as_of", clocks.snapshot_day(F.col("snapshot_id")))
    # Each pricing group is modeled and written once; its recipes differ in priors and gates only.
    parts = []
    if groups[True]:
        # First, for its shuffle takes more disk than all that is kept.
        spark = lines.sparkSession
        path = stage_path(spark, "scenarios")
        with session_settings(spark, candidates.CO_PARTITIONED):
            reduced = materialize(
                candidates.with_scenarios(lines, settings.stale_quote_minutes), "scenarios", path
            )
        parts.append(materialize(candidates.pick_sides(reduced, groups[True], True), "modeled"))
        # Nothing but the sides picked from it read this stage.
        discard(spark, path)
    if groups[False]:
        picked = candidates.pick_sides(lines.drop("panel"), groups[False], False)
        parts.insert(0, materialize(picked, "modeled"))
    return parts


# What names a line in ``only``, besides the report; a rank key has the same fields.
ONLY = ("event_id", "player_key", "market", "point")


def _kept(rows: DataFrame, only: DataFrame, report: tuple[str, ...]) -> DataFrame:
    """Rows whose report and line are named in ``only``."""
    named = only.select(*[F.col(c).alias(f"_{c}") for c in (*report, *ONLY)])
    same = F.lit(True)
    for c in (*report, *ONLY):
        own = F.coalesce("point", F.lit(0.0)) if c == "point" else F.col(c)
        same = same & own.eqNullSafe(F.col(f"_{c}"))
    return rows.join(named, same, "left_semi")


def strategy_candidates(
    inputs: StrategyInputs,
    recipes: dict[str, recipe_book.Recipe] | None = None,
    settings: StrategySettings = StrategySettings(),
    lines: DataFrame | None = None,
    only: DataFrame | None = None,
    written: dict | None = None,
) -> DataFrame:
    """One row per (snapshot, strategy, line) with prices, probabilities, gates and score.

    ``only`` names candidates (snapshot_id, strategy_id and :data:`ONLY`): no others are made. ``written`` keeps
    what a call writes, so that later calls for the same inputs read it.
    """
    groups = candidates.variant_groups(recipes or recipe_book.RECIPES)
    written = {} if written is None else written
    if "modeled" not in written:
        written["modeled"] = _modeled(inputs, groups, settings, lines)
        written["priors"] = _written_priors(inputs, settings)
    parts = written["modeled"]
    if only is not None:
        parts = [_kept(part, only, ("snapshot_id",)) for part in parts]
    fanned = [
        candidates.with_recipes(candidates.with_hits(part, leave_out), found, recipe_book.recipe_struct)
        for part, (leave_out, found) in zip(parts, [(flag, found) for flag, found in groups.items() if found])
    ]
    with_recipes = fanned[0] if len(fanned) == 1 else fanned[0].unionByName(fanned[1])
    if only is not None:
        with_recipes = _kept(with_recipes, only, ("snapshot_id", "strategy_id"))
    with_priors = _with_calibration(with_recipes, written["priors"], settings)
    gated = candidates.gated(with_priors, settings.min_ev, settings.allow_tier_b)
    return gated.withColumn("portfolio_ranking", F.col("recipe.portfolio_ranking"))


def report_gates(
    rows: DataFrame, inputs: StrategyInputs, settings: StrategySettings = StrategySettings()
) -> DataFrame:
    """Report-level health gates: a row per snapshot and recipe."""
    clock = pricing.snapshot_clock(inputs.quotes)
    health = candidates.odds_health(rows, clock, settings.stale_quote_minutes)
    sources = context.source_health(inputs.injuries).select("snapshot_id", "official_ready")
    if inputs.context_flags is not None:
        sources = sources.join(inputs.context_flags, "snapshot_id", "left")
    else:
        sources = sources.withColumns({"injuries_stale": F.lit(False), "roster_stale": F.lit(False)})
    return candidates.health_gates(
        health, sources, settings.require_official_injuries, settings.require_fresh_context
    )


def healthy_candidates(
    rows: DataFrame, inputs: StrategyInputs, settings: StrategySettings = StrategySettings()
) -> DataFrame:
    """Candidates after report-level health gates."""
    return candidates.apply_health_gates(rows, report_gates(rows, inputs, settings))


def described(rows: DataFrame) -> DataFrame:
    """Candidates with rationale, risk notes and labels."""
    return rows.withColumns(
        {
            "rationale": labels.rationale(
                F.col("player"), F.col("market"), F.col("recommended_side"), F.col("model_p_hit"),
                F.col("fair_p_hit"), F.col("injury_status"), F.col("teammate_out_count"),
                F.col("spread_abs"), F.col("total"), F.col("projected_minutes"), F.col("usage_delta"),
            ),
            "risk_notes": labels.risk_notes(
                F.col("injury_status"), F.col("roster_status"), F.col("spread_abs"), F.col("tier")
            ),
            "prop_label": labels.prop_label(
                F.col("player"), F.col("recommended_side"), F.col("point"), F.col("market")
            ),
            "book_price": F.trim(
                F.concat_ws(" ", "selected_book", labels.american_text(F.col("selected_price")))
            ),
        }
    )
