"""Lines are dealt out once; shuffle files and stages that nothing reads any more do not stay."""

import os

from pyspark.sql import functions as F

from oddsloom import session
from oddsloom.operators import candidates, pricing
from oddsloom.plans import bindings, catalog, recipes, strategy

SF = "/root/testdata/sf0.001"


def shuffles(df) -> int:
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_curves_need_no_shuffle_of_their_own(spark):
    lines = pricing.priced_lines(bindings.quotes(spark, SF), links=False, clock=spark.range(1).selectExpr("'a' as snapshot_id", "now() as now_utc"))
    assert shuffles(candidates.with_reference(lines)) == shuffles(lines)


def test_scenarios_deal_lines_out_once(spark):
    quotes = bindings.quotes(spark, SF).where("snapshot_id < 'day-main-2024-01-03'")
    lines = session.materialize(candidates.with_reference(pricing.priced_lines(quotes)), "test-lines")
    with session.settings(spark, candidates.CO_PARTITIONED):
        # The books to leave out and the wide lines, each once by identity.
        assert shuffles(candidates.with_scenarios(lines)) == 2
    assert spark.conf.get(*candidates.CO_PARTITIONED) == "true"
    found = candidates.with_scenarios(lines).select(*pricing.LINE, "over_best", "under_best", "less_over", "less_under")
    every = candidates.leave_one_out(lines).select(
        *pricing.LINE, "excluded_book", F.struct(*candidates._SCENARIO_FIELDS).alias("wanted")
    )
    wanted = {(*[r[c] for c in pricing.LINE], r.excluded_book): r.wanted for r in every.collect()}
    rows = found.collect()
    assert len(rows) == lines.count() > 100
    for r in rows:
        for best, less in ((r.over_best, r.less_over), (r.under_best, r.less_under)):
            if best is not None and best.book:
                assert less == wanted[(*[r[c] for c in pricing.LINE], best.book)]


def test_scenarios_do_not_stay(spark, monkeypatch):
    inputs = catalog.inputs(spark, SF)
    paths = []
    kept = strategy.stage_path
    monkeypatch.setattr(strategy, "stage_path", lambda spark, label: paths.append(kept(spark, label)) or paths[-1])
    some = {s: r for s, r in recipes.RECIPES.items() if s in ("s001", "s016")}
    rows = strategy.strategy_candidates(inputs, some)
    assert len(paths) == 1 and not os.path.exists(paths[0].removeprefix("file://"))
    assert {r.strategy_id for r in rows.select("strategy_id").distinct().collect()} == set(some)


def test_shuffle_files_go_with_their_query(spark):
    session.apply_engine_conf(spark)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    # The same frame can be read again.
    assert sorted(grouped.collect()) == sorted(grouped.collect()) and grouped.count() == 7
