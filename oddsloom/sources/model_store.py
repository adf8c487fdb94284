"""Stored minutes models and day predictions.

A model is a folder under ``{root}/models/{model_id}`` with its classifier, trees and one row of facts. The facts
are written last, so a folder with facts is whole. Predictions of a day lie under
``{root}/predictions/snapshot_date={day}`` and are built once, by the newest model.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import minutes_model, quantile_boost
from oddsloom.sources.files import exists

FACTS = (
    "model_id string, created_at timestamp, fills map<string, double>, has_classifier boolean, active_rate double, "
    "has_trees boolean, constants array<double>, halfwidth double"
)


def save_model(spark: SparkSession, model: minutes_model.MinutesModel, root: str, model_id: str, created_at: dt.datetime | None = None) -> str:
    """Stores all parts under one id and returns the folder; an id that is taken by a whole model is an error."""
    folder = f"{root}/models/{model_id}"
    if exists(spark, f"{folder}/facts/_SUCCESS"):
        raise FileExistsError(folder)
    if model.classifier is not None:
        model.classifier.write().overwrite().save(f"{folder}/classifier")
    if model.boosted is not None:
        quantile_boost.save(model.boosted, f"{folder}/boosted")
    facts = (
        model_id, created_at or dt.datetime.now(dt.timezone.utc), model.fills, model.classifier is not None,
        float(model.active_rate), model.boosted is not None, [float(c) for c in model.constants], float(model.halfwidth),
    )
    spark.createDataFrame([facts], FACTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/facts")
    return folder


def load_model(spark: SparkSession, root: str, model_id: str) -> minutes_model.MinutesModel:
    folder = f"{root}/models/{model_id}"
    if not exists(spark, f"{folder}/facts/_SUCCESS"):
        raise FileNotFoundError(folder)
    facts = spark.read.schema(FACTS).parquet(f"{folder}/facts").first()
    return minutes_model.MinutesModel(
        dict(facts["fills"]),
        GBTClassificationModel.load(f"{folder}/classifier") if facts["has_classifier"] else None,
        facts["active_rate"],
        quantile_boost.load(spark, f"{folder}/boosted") if facts["has_trees"] else None,
        tuple(facts["constants"]),
        facts["halfwidth"],
    )


def latest_model(spark: SparkSession, root: str) -> str | None:
    """Id of the newest whole model: the latest time, then the last id; None if there is none."""
    if not exists(spark, f"{root}/models/*/facts/_SUCCESS"):
        return None
    newest = F.max(F.struct("created_at", "model_id")).alias("newest")
    return spark.read.schema(FACTS).parquet(f"{root}/models/*/facts").agg(newest).first()["newest"]["model_id"]


def day_predictions(
    spark: SparkSession,
    root: str,
    day: str,
    features: DataFrame,
    markets: tuple[str, ...] = ("player_points",),
    snapshot_id: str = "",
    players: DataFrame | None = None,
) -> DataFrame | None:
    """Predictions of a day: as stored, else made by the newest model and stored; None without model or rows.

    ``features`` is the feature frame of all days. It is read only where the day has to be built. A folder that a
    broken run left without its success mark is written again.
    """
    day = dt.date.fromisoformat(day).isoformat()
    path = f"{root}/predictions/snapshot_date={day}"
    if not exists(spark, f"{path}/_SUCCESS"):
        model_id = latest_model(spark, root)
        if model_id is None:
            return None
        rows = features.where(F.col("game_date") == F.lit(day).cast("date"))
        if rows.isEmpty():
            return None
        made = minutes_model.predict(
            load_model(spark, root, model_id), rows, markets, snapshot_id.strip() or f"day-{day}", players
        )
        made.withColumn("model_id", F.lit(model_id)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
