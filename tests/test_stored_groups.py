"""Pricing groups store what cannot be worked out from the row itself."""

from oddsloom.operators import candidates


def test_hits_are_read_off_stored_rows(spark):
    rows = spark.createDataFrame(
        [("over", 0.6, 0.55, 0.5, 0.7, 0.2, -0.3, 100), ("under", 0.3, 0.35, 0.2, 0.4, -0.4, 0.25, -150), ("none", 0.6, 0.5, 0.5, 0.7, None, None, None)],
        "recommended_side string, p_over_model double, p_over_fair double, p_over_low double, p_over_high double, ev_over double, ev_under double, selected_price int",
    )
    over, under, none = candidates.with_hits(rows, False).collect()
    assert (over.model_p_hit, over.fair_p_hit, over.p_hit_low, over.p_hit_high, over.best_ev) == (0.6, 0.55, 0.5, 0.7, 0.2)
    assert (over.p_under_low, over.p_under_high, over.ev_low, over.ev_high, over.best_kelly) == (0.3, 0.5, 0.0, 0.4, 0.2)
    assert (under.model_p_hit, under.fair_p_hit, under.p_hit_low, under.p_hit_high, under.best_ev) == (0.7, 0.65, 0.6, 0.8, 0.25)
    assert (none.model_p_hit, none.p_hit_low, none.best_ev, none.best_kelly, none.p_under_low) == (None, None, None, None, 0.3)
    # Without the selected book the over scenario shows where no side has a price.
    assert candidates.with_hits(rows, True).collect()[2].model_p_hit == 0.6


def test_groups_store_no_hits(spark):
    from oddsloom.plans import catalog, recipes, strategy

    lines = strategy.contextual_lines(catalog.inputs(spark, "/root/testdata/sf0.001")).drop("panel")
    picked = candidates.pick_sides(lines, candidates.variant_groups(recipes.RECIPES)[False], False)
    added = set(candidates.with_hits(picked, False).columns) - set(picked.columns)
    assert added == {
        "p_under_low", "p_under_high", "model_p_hit", "fair_p_hit", "p_hit_low", "p_hit_high", "best_ev", "best_kelly", "ev_low", "ev_high"
    }
