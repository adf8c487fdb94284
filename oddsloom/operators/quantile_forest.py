"""Quantile forecasts from the leaves of a regression forest: a baseline for boosted quantiles.

The quantiles of the training target in each leaf, averaged over the trees, are the forecast. The leaf table has
trees times leaves rows (settings, not the data, set their number), folded to one row of maps for every task.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.session import materialize


def fit(
    rows: DataFrame, target: str, quantiles: tuple[float, ...], trees: int = 20, depth: int = 5, min_leaf: int = 20, seed: int = 7
) -> tuple[RandomForestRegressionModel, DataFrame]:
    """The forest on the vector column ``features`` and its leaf table."""
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
        seed=seed, leafCol="leaf",
    ).fit(rows)
    by_leaf = (
        forest.transform(rows)
        .select(target, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf_id"))
        .withColumn("leaf_id", F.col("leaf_id").cast("int"))
        .groupBy("tree", "leaf_id", target)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("tree", "leaf_id")
        .agg(F.percentile(target, list(quantiles), F.col("n")).alias("q"))
    )
    by_tree = by_leaf.groupBy("tree").agg(
        F.map_from_entries(F.collect_list(F.struct("leaf_id", "q"))).alias("leaves")
    )
    one = by_tree.agg(F.map_from_entries(F.collect_list(F.struct("tree", "leaves"))).alias("by_tree"))
    return forest, materialize(one, "forest-leaves")


def predict(
    model: tuple[RandomForestRegressionModel, DataFrame], rows: DataFrame, n_quantiles: int, into: str = "q"
) -> DataFrame:
    """Adds the sorted array of quantile forecasts."""
    forest, leaves = model
    read = F.transform(
        vector_to_array("leaf"),
        lambda leaf, tree: F.try_element_at(F.try_element_at(F.col("by_tree"), tree), leaf.cast("int")),
    )
    scored = forest.transform(rows).crossJoin(F.broadcast(leaves))  # one row
    found = scored.withColumn("found", F.filter(read, lambda q: q.isNotNull()))

    def mean(i: int):
        total = F.aggregate(F.transform("found", lambda q: q[i]), F.lit(0.0), lambda a, x: a + x)
        return total / F.size("found")

    return found.withColumn(into, F.array_sort(F.array(*[mean(i) for i in range(n_quantiles)]))).select(
        *rows.columns, into
    )
