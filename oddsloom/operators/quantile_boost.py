"""Boosted trees under the pinball loss, grown on value counts.

MLlib has no quantile loss. Features are cut once into bins (positions among at most 255 edges, found by MLlib's
bucketizer). The negative gradient of the pinball loss at quantile ``a`` is ``a`` above the forecast and ``a - 1``
below it, so two whole numbers for each (quantile, node, feature, bin) - rows, and rows below the forecast - tell the gain of
every split. One aggregation a level gives them for all quantiles at once, added up in arrays in the tasks; its result has as
many rows as quantiles, nodes, features and bins, whatever the data, and the splits are taken on it. A leaf's value is
the quantile of its rows' residuals, from counts per thousandth.

The rows and their current forecasts are written anew every ``rounds_per_write`` rounds, so plans stay short and a lost
executor costs little. A round reads the rows once a level, and the tasks walk a batch of rows down the trees at once; by
Spark's functions on arrays, which are interpreted, that would take most of the time. The trees do not depend on the writes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.session import discard, stage_path

#: A cut that no bin exceeds: the node is not split and all its rows go left.
UNSPLIT = 32767


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 300
    rate: float = 0.05
    depth: int = 3
    min_leaf: int = 20
    bins: int = 255
    rounds_per_write: int = 1


@dataclass(frozen=True)
class QuantileTrees:
    """Fitted trees: edges of each feature, the constants they start from, and the tree table."""

    features: tuple[str, ...]
    quantiles: tuple[float, ...]
    edges: dict[str, list[float]]
    start: tuple[float, ...]
    rate: float
    depth: int
    trees: DataFrame  # quantile (position), round, features, cuts, leaves


TREE = "quantile int, round int, features array<int>, cuts array<int>, leaves array<double>"


def bin_edges(rows: DataFrame, features: tuple[str, ...], bins: int) -> dict[str, list[float]]:
    """At most ``bins`` - 1 edges per feature, at its approximate quantiles (a sketch of bounded size)."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(c, F.lit(shares), 10000).alias(c) for c in features]).first()
    return {c: sorted(set(found[c] or [])) for c in features}


def with_bins(rows: DataFrame, edges: dict[str, list[float]], features: tuple[str, ...]) -> DataFrame:
    """Adds the array ``bins``: how many edges each feature reaches."""
    outputs = [f"bin_{i}" for i in range(len(features))]
    infinite = float("inf")
    splits = [[-infinite, *edges[c], infinite] for c in features]
    # A feature without edges has one bin, which the bucketizer cannot say.
    wide = [s if len(s) > 2 else [-infinite, 0.0, infinite] for s in splits]
    cut = Bucketizer(splitsArray=wide, inputCols=list(features), outputCols=outputs, handleInvalid="keep").transform(rows)
    held = [
        (F.col(o) if len(s) > 2 else F.lit(0)).cast("smallint") for o, s in zip(outputs, splits)
    ]
    return cut.withColumn("bins", F.array(*held)).drop(*outputs)


def _node(tree: Column, levels: int) -> Column:
    """Number of the node of a tree that a row reaches after so many levels."""

    def step(node: Column) -> Column:
        goes = F.get("bins", F.get(tree["features"], node)) > F.get(tree["cuts"], node)
        return 2 * node + F.when(goes, 2).otherwise(1)

    if levels == 0:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), lambda node, _: step(node))


def _total(trees: Column, depth: int) -> Column:
    """Sum of the leaf values that a row gets from an array of trees."""
    first = 2**depth - 1
    return F.aggregate(trees, F.lit(0.0), lambda a, t: a + F.get(t["leaves"], _node(t, depth) - first))


def _best_split(counts: np.ndarray, below: np.ndarray, min_leaf: int) -> tuple[int, int]:
    """Feature and cut of the largest gain from counts by (feature, bin); (0, UNSPLIT) if none gains."""
    n, low = counts.sum(axis=1)[:1], below.sum(axis=1)[:1]
    left_n, left_low = counts.cumsum(axis=1)[:, :-1], below.cumsum(axis=1)[:, :-1]
    right_n, right_low = n - left_n, low - left_low
    fits = (left_n >= min_leaf) & (right_n >= min_leaf)
    if not fits.any():
        return 0, UNSPLIT
    with np.errstate(all="ignore"):
        # Mean gradients: quantile less the share below.
        apart = left_low / left_n - right_low / right_n
        gain = np.where(fits, apart * apart * left_n * right_n / n, -1.0)
    # Equal gains: the first feature, then the lowest cut, whatever the noise of the division.
    gain = gain.round(9)
    at = int(gain.argmax())
    if gain.flat[at] <= 0:
        return 0, UNSPLIT
    return int(at // gain.shape[1]), int(at % gain.shape[1])


def _standing(since: list[list[dict]], trees: list[dict], rate: float, depth: int) -> tuple[Callable, Callable, Callable]:
    """residuals(batch, levels), written(batches) and leaves(batches), over columns bins, y and f.

    ``since`` are the trees since the forecasts f were written, ``trees`` those that grow. All is nested here, so that
    tasks get it by value and executors need no copy of this package.
    """

    def matrix(column: pa.Array, rows: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)

    def reached(bins: np.ndarray, tree: dict, levels: int) -> np.ndarray:
        """Number of the node that each row reaches after so many levels, as :func:`_node` has it."""
        features, cuts = np.array(tree["features"]), np.array(tree["cuts"])
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            node = 2 * node + 1 + (bins[rows, features[node]] > cuts[node])
        return node

    def thousandths(gap: np.ndarray) -> np.ndarray:
        """Whole thousandths, so that a row which a forecast meets counts as met; billionths first, so that the noise
        of sums does not decide halves. Halves go away from zero."""
        billionths = np.floor(np.abs(gap) * 1e9 + 0.5)
        return np.copysign(np.floor((billionths + 5e5) / 1e6), gap)

    def forecasts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bins, held = matrix(batch.column(0), batch.num_rows), matrix(batch.column(2), batch.num_rows)
        first, total = 2**depth - 1, np.zeros(held.shape)
        for grown in since:
            for q, tree in enumerate(grown):
                total[:, q] += np.array(tree["leaves"])[reached(bins, tree, depth) - first]
        return bins, held + rate * total

    def residuals(batch: pa.RecordBatch, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins, and for each quantile the row's node and its residual in thousandths."""
        bins, forecast = forecasts(batch)
        node = np.stack([reached(bins, tree, levels) for tree in trees], axis=1)
        return bins, node, thousandths(batch.column(1).to_numpy(zero_copy_only=False)[:, None] - forecast)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, forecast = forecasts(batch)
                ends = np.arange(0, forecast.size + 1, forecast.shape[1], dtype=np.int32)
                f = pa.ListArray.from_arrays(pa.array(ends), pa.array(forecast.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), f], ["bins", "y", "f"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """cell, r, n: rows by (quantile, leaf) and residual."""
        count, size = len(trees), 2**depth

        def together(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(place, np.concatenate(n)).astype(np.int64)

        keys, n, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            _, node, gap = residuals(batch, depth)
            cell = node - (size - 1) + np.arange(count) * size
            # A row without a target moves no leaf.
            own = np.isfinite(gap)
            keys.append(gap[own].astype(np.int64) * (count * size) + cell[own])
            n.append(np.ones(len(keys[-1]), np.int64))
            waiting += len(keys[-1])
            if waiting > 1_000_000:
                key, sums = together(keys, n)
                keys, n, waiting = [key], [sums], 0
        key, sums = together(keys, n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key % (count * size)), pa.array(key // (count * size)), pa.array(sums)], ["cell", "r", "n"]
        )

    return residuals, written, leaves


def _histogram(rows: DataFrame, shape: tuple[int, int, int, int], residuals: Callable | None = None) -> DataFrame:
    """cell, n, below: rows, and rows below the forecast, by (quantile, node of the level, feature, bin).

    ``rows`` has ``bins`` and, per quantile, ``at``: twice the node, plus one below the forecast. With ``residuals``
    (of :func:`_standing`) it has ``bins``, ``y`` and ``f``, and the tasks find ``at`` for a batch at a time. A task adds its
    rows up in one array of counts; rows of quantiles times features for each row would take most of the time.
    """
    count, nodes, width, size = shape
    cells = nodes * width * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lows = np.zeros((count, cells), np.int64), np.zeros((count, cells), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if residuals is None:
                bins, at = (
                    batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
                    for i in range(2)
                )
            else:
                bins, node, gap = residuals(batch, nodes.bit_length() - 1)
                bins, at = bins.astype(np.int64), 2 * node + (gap < 0)
            if bins.shape[1] != width or bins.max() >= size:
                raise ValueError("rows to learn from have no missing features")
            place = bins + np.arange(width) * size
            for q in range(count):
                cell = place + ((at[:, q] // 2 - (nodes - 1)) * (width * size))[:, None]
                counts[q] += np.bincount(cell.ravel(), minlength=cells)
                lows[q] += np.bincount(cell[at[:, q] % 2 == 1].ravel(), minlength=cells)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell), pa.array(counts.flat[cell]), pa.array(lows.flat[cell])], ["cell", "n", "below"]
        )

    parts = rows.mapInArrow(run, "cell long, n long, below long")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))


def fit(
    rows: DataFrame,
    features: tuple[str, ...],
    target: str,
    quantiles: tuple[float, ...],
    settings: BoostSettings = BoostSettings(),
) -> QuantileTrees:
    """Trees for all quantiles from rows without missing features."""
    spark = rows.sparkSession
    edges = bin_edges(rows, features, settings.bins)
    binned = with_bins(rows, edges, features).select("bins", F.col(target).cast("double").alias("y"))
    start = binned.groupBy("y").count().agg(F.percentile("y", list(quantiles), F.col("count"))).first()[0]
    written = [stage_path(spark, "boost-rows")]
    begun = binned.withColumn("f", F.array(*[F.lit(float(s)) for s in start]))
    begun.write.parquet(written[0])
    state = spark.read.schema(begun.schema).parquet(written[0])
    width, size, count = len(features), settings.bins, len(quantiles)
    first_leaf = 2**settings.depth - 1
    forest: list[dict] = []
    since: list[list[dict]] = []

    def standing(trees: list[dict]) -> tuple[Callable, Callable, Callable]:
        return _standing(since, trees, settings.rate, settings.depth)

    for number in range(settings.rounds):
        trees = [{"features": [0] * first_leaf, "cuts": [UNSPLIT] * first_leaf, "leaves": []} for _ in quantiles]
        if len(since) >= settings.rounds_per_write:
            path = stage_path(spark, "boost-rows")
            state.mapInArrow(standing(trees)[1], state.schema).write.parquet(path)
            state = spark.read.schema(state.schema).parquet(path)
            for old in written:
                discard(spark, old)
            written, since = [path], []
        for level in range(settings.depth):
            shape = (count, 2**level, width, size)
            counts, lows = np.zeros(shape), np.zeros(shape)
            hist = _histogram(state, shape, standing(trees)[0]).toArrow()
            cell, n, below = (hist.column(i).to_numpy() for i in range(3))
            counts.flat[cell], lows.flat[cell] = n, below
            for i in range(count):
                for j in range(2**level):
                    at_node = 2**level - 1 + j
                    trees[i]["features"][at_node], trees[i]["cuts"][at_node] = _best_split(
                        counts[i, j], lows[i, j], settings.min_leaf
                    )
        cells = 2**settings.depth
        leaves = (
            state.mapInArrow(standing(trees)[2], "cell long, r long, n long")
            .groupBy("cell", "r")
            .agg(F.sum("n").alias("n"))
            .groupBy("cell")
            .agg(F.percentile(F.col("r") / 1000.0, list(quantiles), F.col("n")).alias("v"))
            .collect()
        )
        for tree in trees:
            tree["leaves"] = [0.0] * (first_leaf + 1)
        for row in leaves:
            q, leaf = divmod(row["cell"], cells)
            trees[q]["leaves"][leaf] = float(row["v"][q])
        since.append(trees)
        forest += [{"quantile": q, "round": number, **t} for q, t in enumerate(trees)]
    for old in written:
        discard(spark, old)
    table = spark.createDataFrame([tuple(t[k] for k in ("quantile", "round", "features", "cuts", "leaves")) for t in forest], TREE)
    return QuantileTrees(features, tuple(quantiles), edges, tuple(map(float, start)), settings.rate, settings.depth, table)


def predict(model: QuantileTrees, rows: DataFrame, into: str = "q") -> DataFrame:
    """Adds the sorted array of quantile forecasts; the trees go to all tasks as one row (their number is a setting)."""
    packed = model.trees.groupBy("quantile").agg(
        F.array_sort(F.collect_list(F.struct("round", "features", "cuts", "leaves"))).alias("trees")
    )
    one = packed.agg(F.map_from_entries(F.collect_list(F.struct("quantile", "trees"))).alias("forest"))

    def total(q: int) -> Column:
        summed = _total(F.try_element_at("forest", F.lit(q)), model.depth)
        return F.lit(model.start[q]) + model.rate * F.coalesce(summed, F.lit(0.0))

    binned = with_bins(rows, model.edges, model.features).crossJoin(F.broadcast(one))  # one row
    return binned.withColumn(into, F.array_sort(F.array(*[total(q) for q in range(len(model.quantiles))]))).drop(
        "bins", "forest"
    )


def pinball(actual: Column, forecast: Column, quantile: float) -> Column:
    gap = actual - forecast
    return F.greatest(quantile * gap, (quantile - 1) * gap)


def save(model: QuantileTrees, path: str) -> None:
    """Trees, edges and settings as Parquet under one folder."""
    spark = model.trees.sparkSession
    model.trees.write.mode("overwrite").parquet(f"{path}/trees")
    edges = [(i, c, model.edges[c]) for i, c in enumerate(model.features)]
    spark.createDataFrame(edges, "position int, feature string, edges array<double>").write.mode("overwrite").parquet(
        f"{path}/edges"
    )
    settings = [(list(model.quantiles), list(model.start), model.rate, model.depth)]
    spark.createDataFrame(settings, "quantiles array<double>, start array<double>, rate double, depth int").write.mode(
        "overwrite"
    ).parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> QuantileTrees:
    edges = spark.read.parquet(f"{path}/edges").orderBy("position").collect()
    settings = spark.read.parquet(f"{path}/settings").first()
    return QuantileTrees(
        tuple(r["feature"] for r in edges), tuple(settings["quantiles"]), {r["feature"]: list(r["edges"]) for r in edges},
        tuple(settings["start"]), settings["rate"], settings["depth"], spark.read.schema(TREE).parquet(f"{path}/trees"),
    )
