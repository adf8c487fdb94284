"""Priced lines to gated, scored candidates, for any number of recipes in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import odds, states
from oddsloom.operators import pricing, reference_curve
from oddsloom.operators.pricing import IDENTITY, LINE

SCORE_PRIOR_WEIGHT = 250.0

# Setting: sides that lie by some of their join keys are joined where they lie.
CO_PARTITIONED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}

_SCENARIO_FIELDS = [
    "over_best", "under_best", "p_over_best", "hold_best", "p_over_median", "hold_median",
    "p_over_iqr", "p_over_range", "book_pair_count", "books_used", "quote_age_minutes",
    "depth_score", "hold_score", "dispersion_score", "freshness_score", "quality_score",
    "uncertainty_band", "reference", "curve_books",
]


def line_source(baseline_used: Column) -> Column:
    return (
        F.when(baseline_used == "median_book", "exact_point_pairs")
        .when(baseline_used == "median_book_interpolated", "reference_curve")
        .when(baseline_used.isin("best_sides", "best_sides_fallback"), "best_sides")
        .when(baseline_used == "missing", "missing")
        .otherwise("unknown")
    )


def baseline(scenario, method: Column, fallback: Column) -> Column:
    """struct(p_over, hold, used, reference_method) of the fair-probability policy.

    ``scenario`` maps a pricing field name to its column.
    """
    reference = scenario("reference")
    median = method == "median_book"
    exact = median & scenario("p_over_median").isNotNull() & scenario("hold_median").isNotNull()
    curve = median & reference["p_over"].isNotNull()
    none_left = median & (fallback != "best_sides")
    used = (
        F.when(exact, "median_book")
        .when(curve, "median_book_interpolated")
        .when(none_left, "missing")
        .when(median, "best_sides_fallback")
        .otherwise("best_sides")
    )

    def choose(first: Column, second: Column, third: Column) -> Column:
        return F.when(exact, first).when(curve, second).when(none_left, None).otherwise(third)

    return F.struct(
        choose(scenario("p_over_median"), reference["p_over"], scenario("p_over_best")).alias("p_over"),
        choose(scenario("hold_median"), reference["hold"], scenario("hold_best")).alias("hold"),
        used.alias("used"),
        F.when(exact, "exact").otherwise(reference["method"]).alias("reference_method"),
    )


def with_reference(lines: DataFrame) -> DataFrame:
    """Lines with the reading of their identity's reference curve."""
    return reference_curve.with_reference(lines)


def leave_one_out(lines: DataFrame, stale_minutes: int = 20) -> DataFrame:
    """Pricing of each line without the book that offers the best over, and best under.

    One row per (line, ``excluded_book``). Lines of an identity are gathered once; the books to leave out are
    those that are best anywhere on it, and the curve without a book is fitted once per (identity, book).
    """
    return _without_books(lines, stale_minutes).drop("own_books")


def _without_books(lines: DataFrame, stale_minutes: int) -> DataFrame:
    """:func:`leave_one_out` with the best books of the line itself, ``own_books``."""
    rest = ["point", "panel", "freshest_quote", "now_utc", "over_best", "under_best"]
    gathered = lines.groupBy(*IDENTITY).agg(F.collect_list(F.struct(*rest)).alias("rows"))
    best = F.flatten(F.transform("rows", lambda r: F.array(r["over_best"]["book"], r["under_best"]["book"])))
    excluded = F.array_distinct(F.filter(best, lambda book: book != ""))
    spread = gathered.withColumn("excluded_book", F.explode(excluded)).withColumn("row", F.explode("rows"))
    reduced = spread.select(
        *IDENTITY,
        "excluded_book",
        *[F.col(f"row.{c}").alias(c) for c in ("point", "freshest_quote", "now_utc")],
        pricing.without_book(F.col("row.panel"), F.col("excluded_book")).alias("panel"),
        F.array("row.over_best.book", "row.under_best.book").alias("own_books"),
    )
    priced = pricing.quality_columns(
        pricing.best_pair_columns(reduced), stale_minutes=stale_minutes
    ).drop("panel", "freshest_quote", "now_utc")
    return reference_curve.with_reference(priced, [*IDENTITY, "excluded_book"])


def with_scenarios(lines: DataFrame, stale_minutes: int = 20) -> DataFrame:
    """Lines with leave-one-out pricing structs ``less_over`` and ``less_under``.

    Lines are dealt out by identity once. Run it under :data:`CO_PARTITIONED`, or the join back to lines deals
    both its sides out again.
    """
    full = F.struct(*_SCENARIO_FIELDS)
    together = lines.repartition(*IDENTITY)
    # Only the two books that a line itself is left with matter to it; the others served the curves.
    reduced = _without_books(together, stale_minutes).where(F.array_contains("own_books", F.col("excluded_book")))
    less = reduced.groupBy(*LINE).agg(
        F.map_from_entries(F.collect_list(F.struct("excluded_book", full))).alias("less")
    )

    def without(side: str) -> Column:
        # Without a book to leave out, the scenario is the full one.
        return F.coalesce(F.try_element_at(F.col("less"), F.col(f"{side}_best.book")), full)

    return (
        together.drop("panel")
        .join(less, LINE, "left")
        .withColumns({"less_over": without("over"), "less_under": without("under")})
        .drop("less")
    )


def _with_model(df: DataFrame, scenario, prefix: str) -> DataFrame:
    """Fair and model probabilities of a pricing scenario, as ``prefix``-ed columns."""
    variant = F.col("variant")
    step = df.withColumn(
        f"{prefix}base", baseline(scenario, variant["baseline_method"], variant["baseline_fallback"])
    )
    fair = F.col(f"{prefix}base.p_over")
    shifted = odds.clamp_probability(fair + F.col("context_adjustment") + F.col("market_delta"))
    minutes = F.when(
        variant["probabilistic_profile"] == "minutes_v1", F.col("minutes_prob_delta_over")
    ).otherwise(F.lit(0.0))
    step = step.withColumns({f"{prefix}shifted": shifted, f"{prefix}minutes": minutes})
    moved = odds.clamp_probability(F.col(f"{prefix}shifted") + F.col(f"{prefix}minutes"))
    step = step.withColumn(f"{prefix}p_over_model", moved).drop(
        f"{prefix}shifted", f"{prefix}minutes"
    )
    p, band = F.col(f"{prefix}p_over_model"), scenario("uncertainty_band")
    return step.withColumns(
        {
            f"{prefix}p_over_low": odds.round6(odds.clamp_probability(p - band)),
            f"{prefix}p_over_high": odds.round6(odds.clamp_probability(p + band)),
        }
    )


def _under_bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """Low and high probability of the under by those of the over."""
    return odds.round6(odds.clamp_probability(1.0 - high)), odds.round6(odds.clamp_probability(1.0 - low))


def variant_groups(recipes: dict) -> dict[bool, list[tuple[tuple, dict]]]:
    """Recipes grouped by what changes their prices: baseline policy and minutes profile.

    Twenty recipes need only a handful of pricings; gates alone differ inside a group. The
    outer key tells whether the group leaves the selected book out.
    """
    groups: dict[bool, dict[tuple, dict]] = {False: {}, True: {}}
    for strategy_id, recipe in recipes.items():
        key = (
            recipe.baseline_method or "best_sides",
            recipe.baseline_fallback or "best_sides",
            recipe.probabilistic_profile or "off",
        )
        groups[bool(recipe.exclude_selected_book)].setdefault(key, {})[strategy_id] = recipe
    return {flag: list(found.items()) for flag, found in groups.items()}


def _variant_array(groups: list[tuple[tuple, dict]]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(method).alias("baseline_method"),
                F.lit(fallback).alias("baseline_fallback"),
                F.lit(profile).alias("probabilistic_profile"),
                F.lit(number).alias("number"),
            )
            for number, ((method, fallback, profile), _) in enumerate(groups)
        ]
    )


# Report column -> pricing field it shows.
_REPORTED = {
    "book_pair_count": "book_pair_count",
    "books_used": "books_used",
    "p_over_book_median": "p_over_median",
    "hold_book_median": "hold_median",
    "p_over_book_iqr": "p_over_iqr",
    "p_over_book_range": "p_over_range",
    "hold_best_sides": "hold_best",
    "quote_age_minutes": "quote_age_minutes",
    "depth_score": "depth_score",
    "hold_score": "hold_score",
    "dispersion_score": "dispersion_score",
    "freshness_score": "freshness_score",
    "quality_score": "quality_score",
    "uncertainty_band": "uncertainty_band",
}


# Columns of a line that sides are picked from, and those that a candidate does not keep.
_WORKED_ON = (
    "over_best", "under_best", "less_over", "less_under", "context_adjustment", "market_delta",
    "minutes_prob_delta_over",
)
_DROPPED = (
    "panel", "less_over", "less_under", "p_over_median", "p_over_iqr", "p_over_range", "hold_median", "p_over_best",
    "hold_best", "reference", "curve_books", "over_best", "under_best",
)


def pick_sides(lines: DataFrame, groups: list[tuple[tuple, dict]], leave_out: bool) -> DataFrame:
    """Lines times pricing groups with the better side picked; ties go to the over.

    ``pricing_group`` is the number of the group, for :func:`with_recipes`. What no step changes goes as one
    struct: each of the many projections would copy some sixty fields of a row one by one. What follows from a
    row by plain arithmetic is added by :func:`with_hits` when rows are read; stored, it would take as much again.
    """
    outer = [c for c in _WORKED_ON if c in lines.columns]
    unchanged = [c for c in lines.columns if c not in _DROPPED and c not in _REPORTED]
    packed = lines.select(
        F.struct(*unchanged).alias("line"),
        *([] if leave_out else [F.struct(*_SCENARIO_FIELDS).alias("scenario")]),
        *outer,
    )
    expanded = packed.withColumn("variant", F.explode(_variant_array(groups))).withColumns(
        {"over_price": -F.col("over_best.cost"), "under_price": -F.col("under_best.cost")}
    )
    if leave_out:
        scenario = {s: (lambda name, s=s: F.col(f"less_{s}.{name}")) for s in ("over", "under")}
        prefix = {"over": "o_", "under": "u_"}
        modeled = _with_model(
            _with_model(expanded, scenario["over"], "o_"), scenario["under"], "u_"
        )
    else:
        scenario = {s: (lambda name: F.col(f"scenario.{name}")) for s in ("over", "under")}
        prefix = {"over": "m_", "under": "m_"}
        modeled = _with_model(expanded, scenario["over"], "m_")

    def m(side: str, name: str) -> Column:
        return F.col(f"{prefix[side]}{name}")

    over_p, under_p = m("over", "p_over_model"), 1.0 - m("under", "p_over_model")
    priced = modeled.withColumns(
        {
            "ev_over": odds.rounded_ev(over_p, F.col("over_price")),
            "ev_under": odds.rounded_ev(under_p, F.col("under_price")),
        }
    )
    missing = F.lit(-999.0)
    over_ev, under_ev = F.col("ev_over"), F.col("ev_under")
    priced = priced.withColumn(
        "recommended_side",
        F.when(over_ev.isNull() & under_ev.isNull(), "none")
        .when(F.coalesce(over_ev, missing) >= F.coalesce(under_ev, missing), "over")
        .otherwise("under"),
    )
    side = F.col("recommended_side")

    def by_side(over: Column, under: Column) -> Column:
        return F.when(side == "under", under).otherwise(over)

    def of_model(name: str) -> Column:
        over, under = m("over", name), m("under", name)
        return by_side(over, under) if leave_out else over

    def of_scenario(name: str) -> Column:
        over, under = scenario["over"](name), scenario["under"](name)
        return by_side(over, under) if leave_out else over

    # With no priced side only the leave-one-out flow still reports the over scenario.
    real = F.lit(True) if leave_out else side != "none"

    def if_real(value: Column) -> Column:
        return value if leave_out else F.when(real, value)

    offer = by_side(F.col("over_best"), F.col("under_best"))
    flat = priced.withColumns(
        {
            "offer": if_real(offer),
            "p_over_fair": of_model("base.p_over"),
            "hold": of_model("base.hold"),
            "used": of_model("base.used"),
            "reference_line_method": of_model("base.reference_method"),
            "p_over_model": of_model("p_over_model"),
            "p_over_low": of_model("p_over_low"),
            "p_over_high": of_model("p_over_high"),
            "baseline_over_book": of_scenario("over_best.book"),
            "baseline_under_book": of_scenario("under_best.book"),
            "baseline_curve_books": of_scenario("curve_books"),
            "reference_points_count": of_scenario("reference.points"),
            **{name: of_scenario(field) for name, field in _REPORTED.items()},
        }
    )
    used = (
        F.when(F.col("p_over_fair").isNull(), "missing").otherwise(F.col("used"))
        if leave_out
        else F.col("used")
    )
    sided = F.array_distinct(
        F.array_remove(F.array_compact(F.array("baseline_over_book", "baseline_under_book")), "")
    )
    flat = flat.withColumns(
        {
            "baseline_used": used,
            "selected_price": -F.col("offer.cost"),
            "selected_book": F.coalesce("offer.book", F.lit("")),
            "selected_link": F.coalesce("offer.link", F.lit("")),
            "selected_last_update": F.col("offer.last_update"),
        }
    )
    flat = flat.withColumns(
        {
            "line_source": line_source(F.col("baseline_used")),
            "baseline_books_used": F.when(
                F.col("baseline_used").isin("best_sides", "best_sides_fallback"), F.sort_array(sided)
            )
            .when(F.col("baseline_used") == "median_book_interpolated", F.col("baseline_curve_books"))
            .otherwise(F.col("books_used")),
        }
    )
    excluded = F.lit(leave_out) & (F.col("selected_book") != "")
    flat = flat.withColumns(
        {
            "baseline_books_used_count": F.size("baseline_books_used"),
            "baseline_excluded_books": F.when(excluded, F.array("selected_book")).otherwise(
                F.array().cast("array<string>")
            ),
            "baseline_is_independent": F.when(
                F.col("selected_book") != "",
                ~F.array_contains("baseline_books_used", F.col("selected_book")),
            ).otherwise(F.lit(leave_out)),
        }
    )
    made = [
        "over_price", "under_price", "ev_over", "ev_under", "recommended_side", "p_over_fair", "hold",
        "reference_line_method", "p_over_model", "p_over_low", "p_over_high", "reference_points_count", *_REPORTED,
        "baseline_used", "selected_price", "selected_book", "selected_link", "selected_last_update", "line_source",
        "baseline_books_used", "baseline_books_used_count", "baseline_excluded_books", "baseline_is_independent",
    ]
    return flat.select("line.*", *made, F.col("variant.number").alias("pricing_group"))


def with_hits(picked: DataFrame, leave_out: bool) -> DataFrame:
    """Rows of :func:`pick_sides` with probability, value and stake of the side they recommend."""
    side = F.col("recommended_side")

    def of_side(over: Column, under: Column) -> Column:
        # With no priced side only the leave-one-out flow still reports the over scenario.
        value = F.when(side == "under", under).otherwise(over)
        return value if leave_out else F.when(side != "none", value)

    p, fair = F.col("p_over_model"), F.col("p_over_fair")
    under_low, under_high = _under_bounds(F.col("p_over_low"), F.col("p_over_high"))
    rows = picked.withColumns(
        {
            "p_under_low": under_low,
            "p_under_high": under_high,
            "model_p_hit": of_side(p, 1.0 - p),
            "fair_p_hit": of_side(fair, 1.0 - fair),
            "best_ev": of_side(F.col("ev_over"), F.col("ev_under")),
        }
    ).withColumns(
        {
            "p_hit_low": of_side(F.col("p_over_low"), F.col("p_under_low")),
            "p_hit_high": of_side(F.col("p_over_high"), F.col("p_under_high")),
        }
    )
    price = F.col("selected_price")
    return rows.withColumns(
        {
            "best_kelly": odds.kelly_fraction(F.col("model_p_hit"), price),
            "ev_low": odds.rounded_ev(F.col("p_hit_low"), price),
            "ev_high": odds.rounded_ev(F.col("p_hit_high"), price),
        }
    )


def with_recipes(picked: DataFrame, groups: list[tuple[tuple, dict]], to_struct) -> DataFrame:
    """Rows of pricing groups to rows of recipes.

    Only numbers go with the rows; ``to_struct`` looks a recipe's settings up where a step needs them.
    """
    names = [strategy_id for _, recipes in groups for strategy_id in recipes]
    members = F.array(*[F.array(*[F.lit(names.index(s)) for s in recipes]) for _, recipes in groups])
    every = {s: recipe for _, recipes in groups for s, recipe in recipes.items()}
    recipe = to_struct(every, F.col("recipe_number"))
    return (
        picked.withColumn("recipe_number", F.explode(F.get(members, F.col("pricing_group"))))
        .withColumns({"recipe": recipe, "strategy_id": recipe["strategy_id"]})
        .drop("pricing_group", "recipe_number")
    )


def gate_reason(min_ev: float = 0.01, allow_tier_b: bool = False) -> Column:
    """First gate a candidate fails, in fixed order; null when it passes all."""
    tier_b = F.col("tier") == "B"
    r = F.col("recipe")
    minutes_on = r["probabilistic_profile"] == "minutes_v1"
    threshold = F.when(tier_b, max(min_ev, 0.05)).otherwise(max(min_ev, 0.03))
    insufficient = r["exclude_selected_book"] & (F.size("baseline_excluded_books") > 0)
    tier_b_open = r["force_allow_tier_b"] | F.lit(allow_tier_b)
    return (
        F.when(F.col("injury_status").isin("out", "out_for_season"), "injury_gate")
        .when(
            F.col("roster_status").isin("inactive", "not_on_roster", "unknown_roster", "unknown_event"),
            "roster_gate",
        )
        .when(tier_b & ~tier_b_open, "tier_b_blocked")
        .when(
            F.col("baseline_used") == "missing",
            F.when(insufficient, "baseline_insufficient_coverage_after_exclusion").otherwise(
                "baseline_missing"
            ),
        )
        .when(
            tier_b & (F.col("baseline_books_used_count") < r["tier_b_min_other_books"]),
            "tier_b_baseline_not_independent",
        )
        .when(F.col("book_pair_count") < r["min_book_pairs"], "book_pairs_gate")
        .when(r["hold_cap"].isNotNull() & F.col("hold_book_median").isNull(), "hold_missing")
        .when(F.col("hold_book_median") > r["hold_cap"], "hold_cap")
        .when(r["p_over_iqr_cap"].isNotNull() & F.col("p_over_book_iqr").isNull(), "dispersion_missing")
        .when(F.col("p_over_book_iqr") > r["p_over_iqr_cap"], "dispersion_iqr")
        .when(F.col("quality_score") < r["min_quality_score"], "quality_score_gate")
        .when(F.col("uncertainty_band") > r["max_uncertainty_band"], "uncertainty_band_gate")
        .when(F.col("best_ev").isNull() | (F.col("best_ev") < threshold), "ev_below_threshold")
        .when(r["min_ev_low"].isNotNull() & F.col("ev_low").isNull(), "ev_low_missing")
        .when(F.col("ev_low") < r["min_ev_low"], "ev_low_below_threshold")
        .when(
            minutes_on & r["min_prob_confidence"].isNotNull() & F.col("confidence_score").isNull(),
            "prob_confidence_missing",
        )
        .when(minutes_on & (F.col("confidence_score") < r["min_prob_confidence"]), "prob_confidence_gate")
        .when(
            minutes_on & r["max_minutes_band"].isNotNull() & F.col("minutes_band").isNull(),
            "minutes_band_missing",
        )
        .when(minutes_on & (F.col("minutes_band") > r["max_minutes_band"]), "minutes_band_gate")
    )


def gated(df: DataFrame, min_ev: float = 0.01, allow_tier_b: bool = False) -> DataFrame:
    """Eligibility, reason, readiness, targets and score of picked candidates.

    A named event without context fails whatever else holds; needs ``event_mapped``.
    """
    unmapped = ~F.col("event_mapped") & (F.trim("event_id") != "")
    reason = F.when(unmapped, "event_mapping_missing").otherwise(
        F.coalesce(gate_reason(min_ev, allow_tier_b), F.lit(""))
    )
    target = F.when(F.col("tier") == "A", 0.03).otherwise(0.05)
    p = F.when(F.col("model_p_hit") > 0, F.col("model_p_hit"))
    injury, roster = F.col("injury_status"), F.col("roster_status")
    staged = df.withColumn("reason", reason).withColumns(
        {
            "eligible": F.col("reason") == "",
            "pre_bet_ready": states.pre_bet_ready(injury, roster),
            "pre_bet_reason": states.pre_bet_reason(injury, roster),
            "target_roi": target,
            "play_to_decimal": odds.round6(odds.play_to_decimal(p, target)),
            "play_to_american": odds.american_odds(odds.play_to_decimal(p, target)),
            "breakeven_decimal": odds.round6(odds.play_to_decimal(p, 0.0)),
            "breakeven_american": odds.american_odds(odds.play_to_decimal(p, 0.0)),
            "fair_american": odds.american_odds(odds.round6(F.lit(1.0) / p)),
            "edge_pct": F.round(F.col("best_ev") * 100.0 + 1e-9, 3),
            "quarter_kelly": odds.round6(F.col("best_kelly") / 4.0),
        }
    )
    score = (
        odds.zero_as_missing(F.col("best_ev"), -0.5) * 1000.0
        + F.col("book_count") * 5.0
        + (F.col("over_shop_delta") + F.col("under_shop_delta")) / 10.0
        - F.coalesce(F.col("hold") * 100.0, F.lit(20.0))
    )
    prior = F.coalesce("historical_prior_delta", F.lit(0.0)) if (
        "historical_prior_delta" in df.columns
    ) else F.lit(0.0)
    return staged.withColumns(
        {
            "score_base": odds.round6(score),
            "score": odds.round6(score + prior * SCORE_PRIOR_WEIGHT),
        }
    )


def candidate_order() -> list[Column]:
    """Report order: eligible first, best value and score first, then keys."""
    return [
        (~F.col("eligible")).asc(),
        odds.zero_as_missing(F.col("best_ev"), -999.0).desc(),
        odds.zero_as_missing(F.col("score"), -9999.0).desc(),
        F.col("event_id").asc(),
        F.col("player").asc(),
        F.col("point").asc(),
        F.col("market").asc(),
    ]


def odds_health(candidates: DataFrame, clock: DataFrame, stale_minutes: int = 20) -> DataFrame:
    """Newest and oldest selected quote per report, their ages and staleness."""
    keys = ["snapshot_id", "strategy_id"]
    seen = candidates.groupBy(*keys).agg(
        F.max("selected_last_update").alias("latest_quote"),
        F.min("selected_last_update").alias("oldest_quote"),
    )
    aged = seen.join(clock, "snapshot_id", "left")

    def age(column: str) -> Column:
        micros = F.unix_micros("now_utc") - F.unix_micros(column)
        return micros / F.lit(60_000_000.0)

    stale = F.coalesce(age("latest_quote") > max(0, stale_minutes), F.lit(True))
    return aged.select(
        *keys,
        F.when(F.col("latest_quote").isNull(), "missing_last_update")
        .when(stale, "stale")
        .otherwise("ok")
        .alias("status"),
        stale.alias("odds_stale"),
        "latest_quote",
        "oldest_quote",
        F.round(age("latest_quote"), 2).alias("age_latest_min"),
        F.round(age("oldest_quote"), 2).alias("age_oldest_min"),
    )


def health_gates(
    health: DataFrame, sources: DataFrame, require_official: bool = True, require_fresh: bool = True
) -> DataFrame:
    """Report-level gates joined as text; empty when a report is healthy.

    ``sources`` has per snapshot ``official_ready``, ``injuries_stale`` and ``roster_stale``.
    """
    joined = health.join(sources, "snapshot_id", "left")

    def flag(condition: Column, name: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(True)), F.lit(name))

    return joined.select(
        "snapshot_id",
        "strategy_id",
        F.concat_ws(
            ",",
            F.when(F.lit(require_official), flag(~F.col("official_ready"), "official_injury_missing")),
            F.when(F.col("odds_stale"), F.lit("odds_snapshot_stale")),
            F.when(F.lit(require_fresh), flag(F.col("injuries_stale"), "injuries_context_stale")),
            F.when(F.lit(require_fresh), flag(F.col("roster_stale"), "roster_context_stale")),
        ).alias("health_gates"),
    )


def apply_health_gates(candidates: DataFrame, gates: DataFrame) -> DataFrame:
    """Blocks still eligible rows of unhealthy reports."""
    joined = candidates.join(gates, ["snapshot_id", "strategy_id"], "left")
    blocked = F.col("eligible") & (F.coalesce("health_gates", F.lit("")) != "")
    return joined.withColumns(
        {
            "reason": F.when(
                blocked, F.concat(F.lit("health_gate:"), F.col("health_gates"))
            ).otherwise(F.col("reason")),
            "eligible": F.col("eligible") & ~blocked,
        }
    )
