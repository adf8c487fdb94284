import json

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import contracts
from oddsloom.plans import recipes
from oddsloom.sources import files, payloads
from oddsloom.streaming import incremental

EVENT = {
    "id": "e1",
    "bookmakers": [
        {
            "key": "bk", "last_update": "2026-01-01T00:00:00Z",
            "markets": [{"key": "player_points", "outcomes": [
                {"name": "Over", "description": "A B", "price": -105, "point": 22.5},
                {"name": "Under", "description": "A B", "price": -115, "point": 22.5, "link": "x"}]}],
        },
        {"key": "empty", "markets": []},
    ],
}


def test_event_payload(spark):
    frame = spark.createDataFrame([("feed", "s", json.dumps(EVENT))], "provider string, snapshot_id string, body string")
    rows = contracts.canonical(payloads.event_odds(frame), "event_props").orderBy("side").collect()
    assert [(r.side, r.price, r.link, r.last_update, r.schema_version) for r in rows] == [
        ("Over", -105.0, "", "2026-01-01T00:00:00Z", 1), ("Under", -115.0, "x", "2026-01-01T00:00:00Z", 1),
    ]


def test_required_columns(spark):
    with pytest.raises(contracts.ContractError, match="book, event_id"):
        contracts.require_columns(spark.range(1).select(*[F.lit("x").alias(c) for c in contracts.schemas.TABLES["event_props"] if c not in ("book", "event_id")]), "event_props")


def test_report_text(spark):
    text = "\n".join(
        ["Injury Report: 02/12/26 05:30 PM", "Team", "Boston Celtics", "Tatum, Jayson", "Out", "Right Achilles;", "Repair",
         "Brown, Jaylen", "White, Derrick", "Questionable", "Utah Jazz", "Page 1 of 3", "George, Keyonte", "Probable"]
    )
    reports = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [(r.player, r.team_norm, r.status, r.note) for r in payloads.report_injuries(reports).orderBy("player").collect()]
    assert got == [
        ("Derrick White", "boston celtics", "questionable", ""), ("Jayson Tatum", "boston celtics", "out", "Right Achilles; Repair"),
        ("Keyonte George", "utah jazz", "probable", ""),
    ]
    cover = payloads.report_coverage(reports).first()
    assert (str(cover.generated_at), cover.parse_coverage) == ("2026-02-12 22:30:00", 1.0)


def test_results_file_precedence(spark, tmp_path):
    for name, result in (("settlement.csv", "loss"), ("settlement.s001.csv", "win"), ("backtest-results-template.s001.csv", "push")):
        (tmp_path / name).write_text(f"snapshot_id,strategy_id,result\nd1,s001,{result}\n")
    rows = files.read_ticket_csv(spark, str(tmp_path / "*.csv"), ["snapshot_id", "strategy_id", "result"])
    assert [r.result for r in files.preferred_results(rows).collect()] == ["win"]


def test_day_sink_refuses_then_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "fact")
    days = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "day string, v int")
    files.write_days(days, path, overwrite=False)
    with pytest.raises(Exception, match="already exists"):
        files.write_days(days, path, overwrite=False)
    files.write_days(spark.createDataFrame([("2026-01-02", 9)], "day string, v int"), path, overwrite=True)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 9]


def test_clean_sink_and_export(spark, tmp_path):
    row = ("2024-25", "regular_season", "g1", "2025-01-01", "1", "2")
    games = spark.createDataFrame([row, ("2023-24", *row[1:])], files.schema_of("games"))
    files.write_clean(games, str(tmp_path / "a"), "games", True)
    assert files.read_clean(spark, str(tmp_path / "a"), "games", ["2024-25"], "Regular Season").count() == 1
    files.export_seasons(spark, str(tmp_path / "a"), str(tmp_path / "b"), "games", ["2023-24"])
    assert [r.season for r in spark.read.schema(files.schema_of("games")).parquet(str(tmp_path / "b/games")).collect()] == ["2023-24"]


def test_incremental_load_skips_seen_files(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def drop(name):
        (source / name).write_text(json.dumps({"provider": "feed", "snapshot_id": name, "body": json.dumps(EVENT)}))

    drop("a.json")
    incremental.load_new_payloads(spark, str(source), str(target), str(tmp_path / "ck"))
    drop("b.json")
    incremental.load_new_payloads(spark, str(source), str(target), str(tmp_path / "ck"))
    got = spark.read.parquet(str(target)).groupBy("snapshot_id").count().collect()
    assert {r.snapshot_id: r["count"] for r in got} == {"a.json": 2, "b.json": 2}


def test_recipes_compose_and_stay_unique():
    merged = recipes.compose(recipes.Recipe(hold_cap=0.1, force_allow_tier_b=True), recipes.Recipe(hold_cap=0.08))
    assert merged.hold_cap == 0.08 and merged.force_allow_tier_b
    assert len(recipes.RECIPES) == 20
    with pytest.raises(ValueError):
        recipes.registry({"S001": recipes.Recipe()})


def test_day_sink_adds_days_that_do_not_exist(spark, tmp_path):
    path = str(tmp_path / "fact")
    for day in ("2026-01-01", "2026-01-02"):
        files.write_days(spark.createDataFrame([(day, 1)], "day string, v int"), path, overwrite=False)
    assert spark.read.parquet(path).count() == 2


def test_result_player_last_row_wins(spark):
    body = (
        '{"game": {"gameId": "g", "homeTeam": {"teamName": "A", "players": [{"name": "Zed Az"}, {"name": "Zed AZ", '
        '"status": "ACTIVE"}]}, "awayTeam": {"teamName": "B", "players": [{"name": "Zed az", "status": "INACTIVE"}]}}}'
    )
    rows = payloads.result_players(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.player, r.status) for r in rows] == [("Zed az", "INACTIVE")]


def test_every_entity_is_found_and_cells_are_read_once(spark):
    known = payloads._entities()
    rows = [(f"&{name};", chars) for name, chars in known.items()]
    rows += [("&nosuch;", "&nosuch;"), ("&;", "&;"), ("&Amp;", "&Amp;"), ("&\x01amp\x02;", "&\x01amp\x02;"), ("&#65;&#x42;&amp;c", "AB&c")]
    read = spark.createDataFrame([(f"x{t}y", f"x{c}y") for t, c in rows], "html string, wanted string")
    assert read.where(~payloads.plain_html(F.col("html")).eqNullSafe(F.col("wanted"))).count() == 0
    # The filter on the cells sees their texts; before, it worked them out a second time.
    pages = spark.createDataFrame([(1, "<tr></tr>")], "page_id long, html string")
    plan = payloads.html_injuries(pages)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line and "note" in line]
    assert filters and not any("regexp" in line for line in filters)
