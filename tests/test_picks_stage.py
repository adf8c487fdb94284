"""A portfolio stores its picks; verdicts and selected rows are read off them."""

from pyspark.sql import functions as F
from test_portfolio import SCHEMA, row

from oddsloom.plans import catalog, strategy

SF = "/root/testdata/sf0.001"


def test_only_picks_are_written(spark, monkeypatch):
    rows = [row("a", "e1", f"p{i}", i, 0.1 * i) for i in range(1, 9)] + [row("a", f"e{i}", f"q{i}", i, 0.01 * i) for i in range(2, 6)]
    written = []
    monkeypatch.setattr(catalog, "candidates_stage", lambda spark, sf: spark.createDataFrame(rows, SCHEMA))
    monkeypatch.setattr(catalog, "stage", lambda spark, sf, name, build: written.append((name, build())) or written[-1][1])
    found = catalog.portfolio_stage(spark, "none").collect()
    assert [name for name, _ in written] == ["picks"]
    assert written[0][1].columns == ["snapshot_id", "strategy_id", "picks"]
    got = {r.player_key: (r.portfolio_rank, r.portfolio_reason) for r in found}
    assert got["p8"] == (1, "") and got["p7"] == (2, "") and got["p6"] == (None, "portfolio_cap_game")
    assert got["q5"] == (3, "") and got["q4"] == (4, "") and got["q3"] == (5, "") and got["q2"] == (None, "portfolio_cap_daily")


def test_candidates_of_named_lines_alone(spark):
    inputs, written = catalog.inputs(spark, SF), {}
    every = strategy.strategy_candidates(inputs, written=written).drop("recipe")
    keys = ["snapshot_id", "strategy_id", *strategy.ONLY]
    few = every.where("strategy_id in ('s009', 's016') and event_id = 'e1'").select(*keys).limit(7).cache()
    files = dict(written)
    only = strategy.strategy_candidates(inputs, only=few, written=written).drop("recipe")
    assert {k: id(v) for k, v in written.items()} == {k: id(v) for k, v in files.items()}
    wanted = every.join(F.broadcast(few), keys, "left_semi").select(*only.columns)
    assert sorted(map(str, only.collect())) == sorted(map(str, wanted.collect()))
    assert only.count() == few.count() == 7
