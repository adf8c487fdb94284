"""Steps over candidates copy few fields, and read days and keys once."""

import datetime as dt

from pyspark.sql import functions as F

from oddsloom.operators import calibration, candidates
from oddsloom.plans import bindings, catalog, recipes, strategy


def test_unchanged_fields_of_a_line_go_as_one(spark):
    lines = strategy.contextual_lines(catalog.inputs(spark, "/root/testdata/sf0.001")).drop("panel")
    groups = candidates.variant_groups(recipes.RECIPES)[False]
    picked = candidates.pick_sides(lines, groups, False)
    plan = picked._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Generate":
        assert plan.children().size() == 1
        plan = plan.children().head()
    assert plan.output().size() < 12
    assert {"game", "tip_et", "injury_note", "book_count", "pricing_group", "reference_points_count"} <= set(picked.columns)
    assert not {"over_best", "reference", "scenario", "line", "variant"} & set(picked.columns)


def test_priors_read_tickets_and_snapshots_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(strategy, "materialize", lambda df, label: written.append(label) or df)
    day = dt.date(2024, 1, 1)
    tickets = spark.createDataFrame(
        [("s009", day, "player_points", "over", "win", 0.6)] * 3,
        "strategy_id string, modeled_day date, market string, recommended_side string, result string, model_p_hit double",
    )
    snapshots = spark.createDataFrame([("day-main-2024-01-02",)] * 2 + [(None,)], "snapshot_id string")
    side, wide = strategy.prior_tables(tickets, snapshots, calibration.PriorSettings())
    assert written == ["snapshots", "prior-outcomes"]
    assert [(r.as_of, r.prior_sample_size) for r in side.collect()] == [(dt.date(2024, 1, 2), 3)]
    assert len(wide.collect()) == 1


def test_floors_of_whole_keys_need_no_decimals(spark):
    expr = "cast(floor(k / 5000.0) as int)"
    assert ".0" not in bindings.whole_steps(expr)
    keys = [0, 4999, 5000, -1, -5000, -5001, None, 10_000_000_000]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").select(
        F.expr(expr).alias("a"), F.expr(bindings.whole_steps(expr)).alias("b")
    )
    assert all(r.a == r.b for r in rows.collect())
    plan = bindings.quotes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan.lower()
