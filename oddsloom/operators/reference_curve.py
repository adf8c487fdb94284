"""Reference curves: weighted no-vig medians per point, made non-increasing, then read off.

A curve belongs to one (snapshot, event, market, player) identity, optionally with one book
left out. Its input is already one row per distinct point, so the collected array is as long
as the ladder of half-point lines a book offers for one player.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import odds
from oddsloom.operators.pricing import IDENTITY

_BLOCK = "struct<value: double, weight: double, points: int>"


def reference_points(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lines with at least one two-sided book as weighted curve points."""
    return lines.where(F.col("p_over_median").isNotNull()).select(
        *(keys or IDENTITY),
        "point",
        F.col("p_over_median").alias("p_over"),
        F.col("hold_median").alias("hold"),
        F.greatest(F.col("book_pair_count"), F.lit(1)).cast("double").alias("weight"),
        "books_used",
    )


def merge_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted means per distinct point, for inputs that repeat a point."""
    weight = F.greatest(F.col("weight"), F.lit(1e-9))
    hold_weight = F.sum(F.when(F.col("hold").isNotNull(), weight))
    return points.groupBy(*keys, "point").agg(
        (F.sum(odds.clamp_probability(F.col("p_over")) * weight) / F.sum(weight)).alias("p_over"),
        F.when(hold_weight > 0, F.sum(F.col("hold") * weight) / hold_weight).alias("hold"),
        F.sum(weight).alias("weight"),
        F.array_distinct(F.flatten(F.collect_set("books_used"))).alias("books_used"),
    )


def isotonic_nonincreasing(values: Column, weights: Column) -> Column:
    """Weighted non-increasing fit of an array by pooling adjacent violators.

    The fold keeps a stack of blocks, last block first; a new value pools with the top
    blocks for as long as they lie below it.
    """
    items = F.zip_with(
        values,
        weights,
        lambda v, w: F.struct(
            v.cast("double").alias("value"),
            F.greatest(w, F.lit(1e-9)).cast("double").alias("weight"),
            F.lit(1).alias("points"),
        ),
    )

    def pool(a: Column, b: Column) -> Column:
        weight = a["weight"] + b["weight"]
        return F.struct(
            ((a["value"] * a["weight"] + b["value"] * b["weight"]) / weight).alias("value"),
            weight.alias("weight"),
            (a["points"] + b["points"]).alias("points"),
        )

    def push(stack: Column, item: Column) -> Column:
        # Walk the stack from its top; once a block is kept, all deeper ones are kept too.
        start = F.struct(
            item.alias("top"), F.array().cast(f"array<{_BLOCK}>").alias("kept")
        )

        def step(acc: Column, block: Column) -> Column:
            pools = (F.size(acc["kept"]) == 0) & (block["value"] < acc["top"]["value"])
            return F.struct(
                F.when(pools, pool(block, acc["top"])).otherwise(acc["top"]).alias("top"),
                F.when(pools, acc["kept"])
                .otherwise(F.concat(acc["kept"], F.array(block)))
                .alias("kept"),
            )

        walked = F.aggregate(stack, start, step)
        return F.concat(F.array(walked["top"]), walked["kept"])

    stack = F.aggregate(items, F.array().cast(f"array<{_BLOCK}>"), push)
    return F.flatten(
        F.transform(F.reverse(stack), lambda b: F.array_repeat(b["value"], b["points"]))
    )


def _ladder_entry(point, p_over, hold, weight, books_used) -> Column:
    return F.struct(
        point.alias("point"),
        odds.clamp_probability(p_over).alias("raw"),
        hold.alias("hold"),
        weight.alias("weight"),
        books_used.alias("books_used"),
    )


def _with_fit(frame: DataFrame) -> DataFrame:
    """Replaces the sorted array ``ladder`` by curve, curve_hold_median and curve_books."""
    ladder = F.col("ladder")
    fitted = frame.withColumn(
        "fit",
        isotonic_nonincreasing(
            F.transform(ladder, lambda p: p["raw"]), F.transform(ladder, lambda p: p["weight"])
        ),
    )
    curve = F.zip_with(
        ladder,
        F.col("fit"),
        lambda p, fit: F.struct(
            p["point"].alias("point"),
            odds.clamp_probability(fit).alias("p_over"),
            p["hold"].alias("hold"),
            p["weight"].alias("weight"),
            p["raw"].alias("raw"),
        ),
    )
    holds = F.sort_array(F.filter(F.transform(ladder, lambda p: p["hold"]), lambda h: h.isNotNull()))
    return fitted.withColumns(
        {
            "curve": curve,
            "curve_hold_median": odds.sorted_quantile(holds, 0.5),
            "curve_books": F.sort_array(
                F.array_distinct(F.flatten(F.transform(ladder, lambda p: p["books_used"])))
            ),
        }
    ).drop("ladder", "fit")


def reference_curves(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per identity: sorted ``curve`` of (point, p_over, hold) and its median hold."""
    keys = keys or IDENTITY
    entry = _ladder_entry(*[F.col(c) for c in ("point", "p_over", "hold", "weight", "books_used")])
    collected = points.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("ladder"))
    return _with_fit(collected)


def with_reference(lines: DataFrame, keys: list[str] | None = None, name: str = "reference") -> DataFrame:
    """Lines with the reading of their identity's curve as struct ``name``, and the curve's books.

    The lines of an identity (as many as a ladder has points) are gathered once, fitted, read and spread again:
    one shuffle, and none if they lie together already.
    """
    keys = keys or IDENTITY
    rest = [c for c in lines.columns if c not in keys]
    gathered = lines.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("rows"))
    ladder = F.sort_array(
        F.transform(
            F.filter("rows", lambda r: r["p_over_median"].isNotNull()),
            lambda r: _ladder_entry(
                r["point"],
                r["p_over_median"],
                r["hold_median"],
                F.greatest(r["book_pair_count"], F.lit(1)).cast("double"),
                r["books_used"],
            ),
        )
    )
    fitted = _with_fit(gathered.withColumn("ladder", ladder)).withColumn("row", F.explode("rows"))
    return fitted.select(
        *keys,
        *[F.col(f"row.{c}").alias(c) for c in rest],
        estimate(F.col("curve"), F.col("curve_hold_median"), F.col("row.point")).alias(name),
        "curve_books",
    )


def curve_points(curves: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return curves.select(*(keys or IDENTITY), F.inline("curve"))


def estimate(curve: Column, hold_median: Column, target: Column) -> Column:
    """struct(p_over, hold, method, points) read off a curve at a target point."""
    left = F.try_element_at(F.filter(curve, lambda p: p["point"] <= target), F.lit(-1))
    right = F.try_element_at(F.filter(curve, lambda p: p["point"] >= target), F.lit(1))
    one_sided = F.coalesce(left, right)
    inner_p = odds.interpolate(left["point"], right["point"], left["p_over"], right["p_over"], target)
    inner_hold = odds.interpolate(left["point"], right["point"], left["hold"], right["hold"], target)
    method = (
        F.when(curve.isNull() | (F.size(curve) == 0), "missing")
        .when(left["point"] == target, "exact")
        .when(left.isNull(), "clamped_low")
        .when(right.isNull(), "clamped_high")
        .otherwise("interpolated")
    )
    inside = left.isNotNull() & right.isNotNull() & (left["point"] < right["point"])
    return F.struct(
        odds.clamp_probability(F.when(inside, inner_p).otherwise(one_sided["p_over"])).alias("p_over"),
        F.when(inside, F.coalesce(inner_hold, hold_median))
        .otherwise(F.coalesce(one_sided["hold"], hold_median))
        .alias("hold"),
        method.alias("method"),
        F.coalesce(F.when(curve.isNotNull(), F.size(curve)), F.lit(0)).alias("points"),
    )


def with_estimates(
    lines: DataFrame, curves: DataFrame, keys: list[str] | None = None, name: str = "reference"
) -> DataFrame:
    """Lines with a ``reference`` struct read off the curve of their identity."""
    keys = keys or IDENTITY
    joined = lines.join(curves, keys, "left")
    return joined.withColumn(
        name, estimate(F.col("curve"), F.col("curve_hold_median"), F.col("point"))
    ).drop("curve", "curve_hold_median")
