"""Rows of pricing groups carry a number, and each recipe's settings are looked up by it."""

from pyspark.sql import functions as F

from oddsloom.operators import candidates
from oddsloom.plans import recipes


def test_groups_fan_out_to_their_recipes(spark):
    for groups in candidates.variant_groups(recipes.RECIPES).values():
        picked = spark.range(len(groups)).select(F.col("id").cast("int").alias("pricing_group"), "id")
        rows = candidates.with_recipes(picked, groups, recipes.recipe_struct).collect()
        wanted = {s: (at, recipe) for at, (_, members) in enumerate(groups) for s, recipe in members.items()}
        assert {r.strategy_id: r.id for r in rows} == {s: at for s, (at, _) in wanted.items()}
        assert len(rows) == len(wanted)
        for row in rows:
            assert row.recipe.asDict() == recipes.resolved(row.strategy_id, wanted[row.strategy_id][1])
