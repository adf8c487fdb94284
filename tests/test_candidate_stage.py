import datetime as dt

from oddsloom.plans import catalog, strategy


def test_only_report_gates_are_written(spark, monkeypatch):
    at = dt.datetime(2024, 1, 1, 12)
    raw = spark.createDataFrame(
        [("a", "s1", True, "", at), ("a", "s2", False, "injury_gate", at - dt.timedelta(hours=1)), ("b", "s1", True, "", at)],
        "snapshot_id string, strategy_id string, eligible boolean, reason string, selected_last_update timestamp",
    )
    inputs = strategy.StrategyInputs(
        quotes=raw.selectExpr("snapshot_id", "selected_last_update as last_update"),
        event_context=None, slate=None, roster=None,
        injuries=spark.createDataFrame([("a", "official"), ("b", "secondary")], "snapshot_id string, source string"),
    )
    written = []
    monkeypatch.setattr(catalog, "raw_candidates_stage", lambda spark, sf: raw)
    monkeypatch.setattr(catalog, "inputs", lambda spark, sf: inputs)
    monkeypatch.setattr(strategy, "described", lambda rows: rows)
    monkeypatch.setattr(catalog, "stage", lambda spark, sf, name, build: written.append(name) or build())
    found = catalog.candidates_stage(spark, "none")
    assert written == ["health-gates"]
    assert {(r["snapshot_id"], r["strategy_id"], r["eligible"], r["reason"]) for r in found.collect()} == {
        ("a", "s1", True, ""),
        ("a", "s2", False, "injury_gate"),
        ("b", "s1", False, "health_gate:official_injury_missing"),
    }


def test_raw_candidates_are_not_written(spark, monkeypatch):
    # Twenty recipes times all columns would be many times the pricing groups that they are read from.
    inputs = catalog.inputs(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(catalog, "_STAGES", {})
    monkeypatch.setattr(catalog, "inputs", lambda spark, sf: inputs)
    monkeypatch.setattr(catalog, "lines_stage", lambda spark, sf: None)
    made = []
    rows = spark.createDataFrame([("a", "s1", "r")], "snapshot_id string, strategy_id string, recipe string")
    monkeypatch.setattr(strategy, "strategy_candidates", lambda *args, **named: made.append(1) or rows)
    monkeypatch.setattr(catalog, "materialize", lambda df, label: made.append(label) or df)
    first, second = (catalog.raw_candidates_stage(spark, "none") for _ in range(2))
    assert made == [1] and first is second and first.columns == ["snapshot_id", "strategy_id"]


def test_lines_are_priced_once(spark):
    lines = strategy.contextual_lines(catalog.inputs(spark, "/root/testdata/sf0.001"))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS over_offer#") == 1
