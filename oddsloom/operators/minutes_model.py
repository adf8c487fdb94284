"""Probabilistic minutes model: an MLlib availability classifier and boosted quantiles of the minutes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import names, odds
from oddsloom.operators import exact_quantiles, quantile_boost
from oddsloom.operators.minutes import FEATURES, confidence, quality_flags
from oddsloom.session import discard, stage_path

QUANTILES = (0.1, 0.5, 0.9)


@dataclass(frozen=True)
class ModelSettings:
    classifier_rounds: int = 250
    classifier_depth: int = 4
    learning_rate: float = 0.05
    min_leaf: int = 20
    boost: quantile_boost.BoostSettings = quantile_boost.BoostSettings()
    seed: int = 7
    min_classifier_rows: int = 10
    min_quantile_rows: int = 25
    min_conformal_rows: int = 40
    conformal_quantile: float = 0.9


@dataclass(frozen=True)
class MinutesModel:
    """Fitted parts; constants stand in where the training data were too few."""

    fills: dict[str, float]
    classifier: GBTClassificationModel | None
    active_rate: float
    boosted: quantile_boost.QuantileTrees | None
    constants: tuple[float, float, float]
    halfwidth: float


FILLED = tuple(f"f_{c}" for c in FEATURES)


def _filled(rows: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Adds each feature as a number, missing ones at their training median."""
    return rows.withColumns(
        {f: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(fills[c])) for f, c in zip(FILLED, FEATURES)}
    )


def _vectors(filled: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FILLED), outputCol="features").transform(filled)


def train(rows: DataFrame, settings: ModelSettings = ModelSettings()) -> MinutesModel:
    """Fits on feature rows with ``active_target`` and ``actual_minutes``."""
    spark = rows.sparkSession
    fills = {r["column"]: r["median"] or 0.0 for r in exact_quantiles.medians(rows, FEATURES).collect()}
    # Boosting reads the rows once per level: they are written without what it does not need.
    path = stage_path(spark, "training-rows")
    prepared = _filled(rows, fills).select(*FILLED, "active_target", "actual_minutes")
    prepared.write.parquet(path)
    data = spark.read.schema(prepared.schema).parquet(path)
    active = data.where("active_target = 1")
    # Quantiles over counts per minute value: minutes are few, rows are many.
    counts = active.groupBy("actual_minutes").agg(F.count(F.lit(1)).alias("n"))
    facts = data.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("active_target") == 1).alias("n_active"),
    ).first()
    quantiles = counts.agg(F.percentile("actual_minutes", list(QUANTILES), F.col("n")).alias("q")).first()["q"]
    n, n_active = facts["n"], facts["n_active"]
    classifier = None
    if n >= settings.min_classifier_rows and 0 < n_active < n:
        vectors = _vectors(data).select("features", "active_target").persist()
        classifier = GBTClassifier(
            featuresCol="features", labelCol="active_target", maxDepth=settings.classifier_depth,
            maxIter=settings.classifier_rounds, stepSize=settings.learning_rate,
            minInstancesPerNode=settings.min_leaf, seed=settings.seed,
        ).fit(vectors)
        vectors.unpersist()
    boosted, halfwidth = None, 4.0
    if n_active >= settings.min_quantile_rows:
        boosted = quantile_boost.fit(active, FILLED, "actual_minutes", QUANTILES, settings.boost)
    constants = tuple(quantiles) if quantiles else (24.0, 24.0, 24.0)
    model = MinutesModel(fills, classifier, (n_active / n) if n else 0.95, boosted, constants, halfwidth)
    if n_active >= settings.min_conformal_rows:
        # Thousandths of a minute up to 48: the number of distinct residuals is bounded.
        residual = F.round(F.abs(F.col("actual_minutes") - F.col("q")[1]), 3)
        level = max(0.5, min(0.995, settings.conformal_quantile))
        counts = (
            _quantiles(model, active).groupBy(residual.alias("residual")).agg(F.count(F.lit(1)).alias("n"))
        )
        width = counts.agg(F.percentile("residual", level, F.col("n"))).first()[0]
        halfwidth = max(1.0, min(20.0, width)) if width is not None else 4.0
    discard(spark, path)
    return MinutesModel(fills, classifier, model.active_rate, boosted, constants, round(halfwidth, 6))


def _quantiles(model: MinutesModel, filled: DataFrame) -> DataFrame:
    """Rows with the sorted array ``q`` of raw quantiles."""
    if model.boosted is None:
        return filled.withColumn("q", F.array(*[F.lit(float(c)) for c in sorted(model.constants)]))
    return quantile_boost.predict(model.boosted, filled)


def predict(
    model: MinutesModel, rows: DataFrame, markets: tuple[str, ...] = ("player_points",),
    snapshot_id: str = "", players: DataFrame | None = None,
) -> DataFrame:
    """Predictions per (game, player, market): quantiles, availability and confidence.

    The interval is at least the conformal half-width around the median, inside 0..48.
    ``players`` maps player_id to player_name.
    """
    scored = _quantiles(model, _filled(rows, model.fills))
    if model.classifier is None:
        active = scored.withColumn("p_active", F.lit(float(model.active_rate)))
    else:
        vector = model.classifier.transform(_vectors(scored))
        active = vector.withColumn("p_active", vector_to_array("probability")[1])
    low, mid, high = F.col("q")[0], F.col("q")[1], F.col("q")[2]
    half = F.greatest(mid - low, high - mid, F.lit(float(model.halfwidth)))
    bounds = F.array_sort(
        F.array(
            odds.clamp(mid - half, 0.0, 48.0), odds.clamp(mid, 0.0, 48.0), odds.clamp(mid + half, 0.0, 48.0)
        )
    )
    named = active.join(players, "player_id", "left") if players is not None else active.withColumn(
        "player_name", F.lit("")
    )
    out = named.withColumn("b", bounds).withColumns(
        {
            "minutes_p10": odds.round6(F.col("b")[0]),
            "minutes_p50": odds.round6(F.col("b")[1]),
            "minutes_p90": odds.round6(F.col("b")[2]),
            "p_active": odds.round6(F.col("p_active")),
            "player_name": F.coalesce("player_name", F.lit("")),
        }
    )
    band = F.col("minutes_p90") - F.col("minutes_p10")
    label = F.coalesce(F.nullif("player_name", F.lit("")), F.col("player_id"))
    return out.select(
        F.lit(snapshot_id).alias("snapshot_id"),
        F.col("game_date").cast("string").alias("snapshot_date"),
        F.col("game_id").alias("event_id"),
        "player_id", "player_name", names.person_key(label).alias("player_norm"), "team_id",
        F.explode(F.array(*[F.lit(m) for m in markets])).alias("market"),
        "minutes_p10", "minutes_p50", "minutes_p90", F.col("minutes_p50").alias("minutes_mu"),
        odds.round6(band / 2.5632).alias("minutes_sigma_proxy"),
        "p_active", "games_on_team", "days_on_team", "new_team_phase",
        confidence(F.col("games_played"), F.col("games_on_team"), band, F.col("p_active")).alias("confidence_score"),
        quality_flags(F.col("games_on_team"), F.col("games_played"), F.col("p_active")).alias("data_quality_flags"),
        "actual_minutes",
    )
