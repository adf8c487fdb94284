"""Strategy recipes: twenty settings rows composed from smaller ones, used as literal data."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Recipe:
    """Settings of one strategy; ``None`` means not set."""

    force_allow_tier_b: bool = False
    use_rolling_priors: bool = False
    exclude_selected_book: bool = False
    rolling_priors_source: str | None = None
    portfolio_ranking: str | None = None
    baseline_method: str | None = None
    baseline_fallback: str | None = None
    tier_b_min_other_books: int | None = None
    min_book_pairs: int | None = None
    hold_cap: float | None = None
    p_over_iqr_cap: float | None = None
    min_quality_score: float | None = None
    min_ev_low: float | None = None
    max_uncertainty_band: float | None = None
    probabilistic_profile: str | None = None
    min_prob_confidence: float | None = None
    max_minutes_band: float | None = None


_TYPES = {
    "force_allow_tier_b": "boolean",
    "use_rolling_priors": "boolean",
    "exclude_selected_book": "boolean",
    "tier_b_min_other_books": "int",
    "min_book_pairs": "int",
    "hold_cap": "double",
    "p_over_iqr_cap": "double",
    "min_quality_score": "double",
    "min_ev_low": "double",
    "max_uncertainty_band": "double",
    "min_prob_confidence": "double",
    "max_minutes_band": "double",
}


def compose(*parts: Recipe) -> Recipe:
    """Later parts override set values; flags add up."""
    merged: dict[str, object] = {}
    for field in fields(Recipe):
        values = [getattr(part, field.name) for part in parts]
        if isinstance(field.default, bool):
            merged[field.name] = any(values)
        else:
            merged[field.name] = next((v for v in reversed(values) if v is not None), None)
    return Recipe(**merged)


MEDIAN = Recipe(baseline_method="median_book", baseline_fallback="best_sides")
TIER_B = Recipe(force_allow_tier_b=True)
TWO_PAIRS = Recipe(min_book_pairs=2)
HOLD_CAP = Recipe(hold_cap=0.08)
IQR_CAP = Recipe(p_over_iqr_cap=0.08)
FLOOR = Recipe(min_quality_score=0.55, min_ev_low=0.01, max_uncertainty_band=0.08)
PRIORS = Recipe(use_rolling_priors=True)
LEAVE_OUT = Recipe(exclude_selected_book=True, tier_b_min_other_books=2)
MINUTES = Recipe(probabilistic_profile="minutes_v1", min_prob_confidence=0.5, max_minutes_band=22.0)
BY_QUALITY = Recipe(portfolio_ranking="ev_low_quality_weighted")

_COMPOSITE = compose(MEDIAN, TWO_PAIRS, HOLD_CAP)
_CONSERVATIVE = compose(_COMPOSITE, IQR_CAP, FLOOR)
_TIER_B_FLOOR = compose(TIER_B, HOLD_CAP, IQR_CAP, FLOOR)

# The recipe of each strategy id.
RECIPES: dict[str, Recipe] = {
    "s001": Recipe(),
    "s002": TIER_B,
    "s003": MEDIAN,
    "s004": TWO_PAIRS,
    "s005": HOLD_CAP,
    "s006": IQR_CAP,
    "s007": _COMPOSITE,
    "s008": _CONSERVATIVE,
    "s009": compose(_CONSERVATIVE, PRIORS),
    "s010": _TIER_B_FLOOR,
    "s011": compose(_TIER_B_FLOOR, PRIORS),
    "s012": compose(TIER_B, Recipe(portfolio_ranking="best_ev")),
    "s013": compose(TIER_B, BY_QUALITY),
    "s014": compose(MEDIAN, TIER_B),
    "s015": compose(
        _TIER_B_FLOOR,
        PRIORS,
        Recipe(rolling_priors_source="s010", portfolio_ranking="calibrated_ev_low"),
    ),
    "s016": compose(_TIER_B_FLOOR, LEAVE_OUT, BY_QUALITY),
    "s017": compose(_TIER_B_FLOOR, MEDIAN, LEAVE_OUT),
    "s018": compose(_CONSERVATIVE, MINUTES),
    "s019": compose(TWO_PAIRS, HOLD_CAP, IQR_CAP, FLOOR),
    "s020": compose(_TIER_B_FLOOR, MINUTES, BY_QUALITY),
}


def normalize_id(value: str) -> str:
    """Strategy ids are lower-case words joined by underscores."""
    return value.strip().lower().replace("-", "_")


def registry(extra: dict[str, Recipe] | None = None) -> dict[str, Recipe]:
    """All recipes by id; an extra recipe may not reuse an id."""
    merged = dict(RECIPES)
    for raw, recipe in (extra or {}).items():
        key = normalize_id(raw)
        if key in merged:
            raise ValueError(f"duplicate strategy id: {key}")
        merged[key] = recipe
    return merged


def resolved(strategy_id: str, recipe: Recipe) -> dict[str, object]:
    """A recipe row with defaults filled in."""
    row = {field.name: getattr(recipe, field.name) for field in fields(Recipe)}
    row["strategy_id"] = strategy_id
    row["rolling_priors_source"] = recipe.rolling_priors_source or strategy_id
    row["portfolio_ranking"] = recipe.portfolio_ranking or "default"
    row["baseline_method"] = recipe.baseline_method or "best_sides"
    row["baseline_fallback"] = recipe.baseline_fallback or "best_sides"
    row["min_book_pairs"] = recipe.min_book_pairs or 0
    row["probabilistic_profile"] = recipe.probabilistic_profile or "off"
    return row


def recipe_struct(recipes: dict[str, Recipe], number: Column) -> Column:
    """The settings of the recipe with a number, each looked up in an array literal of its own."""
    rows = [resolved(strategy_id, recipe) for strategy_id, recipe in recipes.items()]
    return F.struct(
        *[
            F.get(F.array(*[F.lit(row[name]).cast(_TYPES.get(name, "string")) for row in rows]), number).alias(name)
            for name in sorted(rows[0])
        ]
    )


def recipe_values_sql(recipes: dict[str, Recipe]) -> str:
    """The recipes as a SQL VALUES table, for checking queries."""

    def literal(name: str, value: object) -> str:
        kind = {"string": "varchar", "int": "integer"}.get(_TYPES.get(name, "string"), _TYPES.get(name, "string"))
        if value is None:
            return f"cast(null as {kind})"
        if isinstance(value, bool):
            return str(value).lower()
        return f"'{value}'" if isinstance(value, str) else f"cast({value} as {kind})"

    rows = [dict(sorted(resolved(s, r).items())) for s, r in recipes.items()]
    body = ", ".join("(" + ", ".join(literal(n, v) for n, v in row.items()) + ")" for row in rows)
    return f"select * from (values {body}) as t({', '.join(rows[0])})"
