"""Exact medians, boosted quantiles, stored models and day predictions."""

import datetime as dt
import random
import statistics
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.operators import exact_quantiles, minutes, minutes_model, quantile_boost
from oddsloom.session import stage_path
from oddsloom.sources import model_store

QUICK = minutes_model.ModelSettings(
    classifier_rounds=3, boost=quantile_boost.BoostSettings(rounds=5, rate=0.3, rounds_per_write=2)
)


def test_medians_are_exact(spark):
    rng = random.Random(8)
    rows = [
        (
            rng.choice([None, float("nan"), rng.random() * 10**6]),
            float(rng.randint(0, 2)),
            None,
            i if i % 3 else None,
            -7.5,
        )
        for i in range(3001)
    ]
    frame = spark.createDataFrame(rows, "a double, b double, c double, `d.x` long, e double")
    found = {r["column"]: (r["n"], r["median"]) for r in exact_quantiles.medians(frame, ("a", "b", "c", "d.x", "e"), 500).collect()}
    for i, name in enumerate(("a", "b", "c", "d.x", "e")):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert found[name] == (len(values), statistics.median(values) if values else None)
    empty = exact_quantiles.medians(frame.limit(0), ("a", "b")).collect()
    assert [(r["n"], r["median"]) for r in empty] == [(0, None)] * 2


def thousandths(values):
    """Halves go away from zero, on the shortest decimal form of the number."""
    return np.array([float(Decimal(repr(round(float(v), 9))).quantize(Decimal("0.001"), ROUND_HALF_UP)) for v in values])


def boosted_by_hand(x, y, quantiles, edges, settings):
    """The same trees, row by row."""
    bins = np.array([[sum(v >= e for e in own) for v, own in zip(row, edges)] for row in x])
    start = [float(np.quantile(y, q)) for q in quantiles]
    out = []
    for q, level in enumerate(quantiles):
        f = np.full(len(y), start[q])
        for _ in range(settings.rounds):
            node = np.zeros(len(y), int)
            for depth in range(settings.depth):
                goes = np.zeros(len(y), int)
                for j in range(2**depth - 1, 2 ** (depth + 1) - 1):
                    own = node == j
                    low = (thousandths(y - f) < 0).astype(float)
                    best = (0.0, None)
                    for k in range(x.shape[1]):
                        for cut in range(settings.bins - 1):
                            left = own & (bins[:, k] <= cut)
                            right = own & (bins[:, k] > cut)
                            if min(left.sum(), right.sum()) < settings.min_leaf:
                                continue
                            apart = low[left].mean() - low[right].mean()
                            gain = round(apart * apart * left.sum() * right.sum() / own.sum(), 9)
                            if gain > best[0]:
                                best = (gain, (k, cut))
                    if best[1] is not None:
                        goes |= own & (bins[:, best[1][0]] > best[1][1])
                node = 2 * node + 1 + goes
            for j in set(node.tolist()):
                own = node == j
                f[own] += settings.rate * np.quantile(thousandths(y[own] - f[own]), level)
        out.append(f)
    return np.sort(np.array(out).T, axis=1)


def test_boosted_quantiles_against_hand(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 10, (120, 2)), 1)
    y = np.round(3 * x[:, 0] + rng.normal(0, 1 + x[:, 1] / 5, 120), 2)
    settings = quantile_boost.BoostSettings(rounds=4, rate=0.5, depth=2, min_leaf=10, bins=12, rounds_per_write=3)
    frame = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, y double")
    levels = (0.1, 0.5, 0.9)
    model = quantile_boost.fit(frame, ("a", "b"), "y", levels, settings)
    rows = quantile_boost.predict(model, frame).collect()
    want = boosted_by_hand(x, y, levels, [model.edges["a"], model.edges["b"]], settings)
    np.testing.assert_allclose([r.q for r in rows], want, atol=2e-3)
    path = stage_path(spark, "boost")
    quantile_boost.save(model, path)
    again = quantile_boost.predict(quantile_boost.load(spark, path), frame).collect()
    assert [r.q for r in again] == [r.q for r in rows]


def test_tasks_add_up_counts_and_writes_do_not_matter(spark):
    rng = np.random.default_rng(4)
    bins, at = rng.integers(0, 5, (90, 3)), rng.integers(2, 6, (90, 2))  # nodes 1 and 2, as twice the node
    rows = [([int(b) for b in r], [int(a) for a in t]) for r, t in zip(bins, at)]
    frame = spark.createDataFrame(rows, "bins array<smallint>, at array<int>").repartition(3)
    found = quantile_boost._histogram(frame, (2, 2, 3, 5))
    want = {}
    for b, a in rows:
        for q in range(2):
            for feature in range(3):
                cell = ((q * 2 + a[q] // 2 - 1) * 3 + feature) * 5 + b[feature]
                n, below = want.get(cell, (0, 0))
                want[cell] = n + 1, below + a[q] % 2
    assert {r.cell: (r.n, r.below) for r in found.collect()} == want
    learnt = spark.range(400).selectExpr("id % 37 / 3d as a", "id % 11 / 7d as b", "round(id % 37 / 2d + id % 5, 2) as y")
    trees = [
        quantile_boost.fit(
            learnt, ("a", "b"), "y", (0.1, 0.9), quantile_boost.BoostSettings(rounds=4, rate=0.3, rounds_per_write=n)
        ).trees.orderBy("round", "quantile").collect()
        for n in (1, 3)
    ]
    assert trees[0] == trees[1]


def test_constant_features_and_targets(spark):
    frame = spark.createDataFrame([(1.0, 5.0)] * 60, "a double, y double")
    model = quantile_boost.fit(frame, ("a",), "y", (0.1, 0.9), quantile_boost.BoostSettings(rounds=2))
    assert [r.q for r in quantile_boost.predict(model, frame.limit(2)).collect()] == [[5.0, 5.0]] * 2


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(1)
    rows = [
        (f"g{d}", dt.date(2024, 1, 1) + dt.timedelta(days=d), f"p{p}", f"t{p % 2}", float(max(0, 8 * p + rng.randint(-6, 6))))
        for d in range(25)
        for p in range(5)
    ]
    box = spark.createDataFrame(rows, "game_id string, game_date date, player_id string, team_id string, minutes double")
    return minutes.feature_frame(box).persist()


def scores(rows):
    return sorted((r.event_id, r.player_id, r.minutes_p10, r.minutes_p50, r.minutes_p90, r.p_active) for r in rows)


def test_stored_model_gives_the_same_predictions(spark, frame):
    root = stage_path(spark, "model-root")
    model = minutes_model.train(frame, QUICK)
    assert model.boosted is not None and model.classifier is not None
    model_store.save_model(spark, model, root, "m1", dt.datetime(2024, 2, 1))
    other = spark.newSession()
    loaded = model_store.load_model(other, root, "m1")
    assert loaded.fills == model.fills and loaded.halfwidth == model.halfwidth
    assert scores(minutes_model.predict(loaded, frame).collect()) == scores(minutes_model.predict(model, frame).collect())
    with pytest.raises(FileExistsError):
        model_store.save_model(spark, model, root, "m1")
    with pytest.raises(FileNotFoundError):
        model_store.load_model(spark, root, "m9")


def test_small_data_store_constants(spark, frame):
    root = stage_path(spark, "model-root")
    model = minutes_model.train(frame.limit(5), QUICK)
    assert model.boosted is None and model.classifier is None
    model_store.save_model(spark, model, root, "small", dt.datetime(2024, 2, 1))
    assert model_store.load_model(spark, root, "small") == model


def test_day_is_built_once_by_the_newest_model(spark, frame, monkeypatch):
    root = stage_path(spark, "model-root")
    day = "2024-01-20"
    assert model_store.day_predictions(spark, root, day, frame) is None  # no model
    old, new = minutes_model.train(frame.limit(5), QUICK), minutes_model.train(frame, QUICK)
    model_store.save_model(spark, new, root, "new", dt.datetime(2024, 3, 1))
    model_store.save_model(spark, old, root, "old", dt.datetime(2024, 2, 1))
    # A folder without facts is of a run that broke off, and is not read.
    spark.range(1).write.parquet(f"{root}/models/zz-broken/boosted/trees")
    first = model_store.day_predictions(spark, root, day, frame)
    assert {r.model_id for r in first.collect()} == {"new"} and first.count() == 5
    wanted = frame.where(F.col("game_date") == day)
    assert scores(first.collect()) == scores(minutes_model.predict(new, wanted).collect())
    assert {r.snapshot_id for r in first.collect()} == {f"day-{day}"}

    def refuse(*_, **__):
        raise AssertionError("built again")

    monkeypatch.setattr(minutes_model, "predict", refuse)
    monkeypatch.setattr(minutes_model, "train", refuse)
    again = model_store.day_predictions(spark.newSession(), root, day, frame.limit(0))
    assert scores(again.collect()) == scores(first.collect())
    assert model_store.day_predictions(spark, root, "2030-01-01", frame) is None  # no rows of that day
    with pytest.raises(ValueError):
        model_store.day_predictions(spark, root, "someday", frame)


def test_tasks_walk_trees_as_columns_do():
    import pyarrow as pa

    tree = {"features": [0, 1, 0], "cuts": [1, 0, 2], "leaves": [0.1, 0.2, 0.3, 0.4]}
    grown = {"features": [1, 0, 0], "cuts": [0, 1, quantile_boost.UNSPLIT], "leaves": []}
    bins, y, f = [[0, 0], [1, 1], [2, 0], [3, 1]], [1.0, 2.0005, None, 0.15], [[1.0], [2.0], [3.0], [0.0]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(bins, pa.list_(pa.int16())), pa.array(y), pa.array(f, pa.list_(pa.float64()))], ["bins", "y", "f"]
    )
    residuals, written, leaves = quantile_boost._standing([[tree]], [grown], 0.5, 2)
    (out,) = written(iter([batch]))
    assert out.column(2).to_pylist() == [[1.05], [2.1], [3.15], [0.2]] and out.column(1).to_pylist() == y
    _, node, gap = residuals(batch, 2)
    assert node[:, 0].tolist() == [3, 5, 4, 5]
    assert [g for g in gap[:, 0].tolist() if g == g] == [-50.0, -100.0, -50.0]  # -0.0995 goes away from zero
    (cells,) = leaves(iter([batch]))
    assert sorted(zip(*(c.to_pylist() for c in cells.columns))) == [(0, -50, 1), (2, -100, 1), (2, -50, 1)]
