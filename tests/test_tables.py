"""Canonical order, repair, export and file listings."""

import random

import pytest
from pyspark.sql import functions as F

from oddsloom.functions import formats
from oddsloom.operators import canonical_order, contracts
from oddsloom.session import stage_path
from oddsloom.sources import repair

NUMBERS = [
    0.0, -0.0, 1.0, -1.5, 0.1 + 0.2, 1e-7, 1.5e-5, 0.0001, 0.00012345678901234, 1e15, 123456789012.0, 999999999999.4,
    999999999999.6, 1234567890123.0, -2.5e-10, 1e100, 1e-300, 22.5, 110.0, -115.0, 1 / 3, 2 / 3, 1e12, 1e11,
    18600000000065.0, 18600000000075.0, 1234567890.125, 1234567890.375, 9999999999995.0, 0.5, 2.0**-20, 123456789012.5,
    1e22, 1.7976931348623157e308,
]


def test_twelve_significant_digits(spark):
    rng = random.Random(4)
    values = NUMBERS + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 20) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for r in rows.select("v", formats.significant(F.col("v")).alias("t")).collect():
        assert r.t == f"{r.v:.12g}"
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double")
    assert {r[0] for r in odd.select(formats.significant(F.col("v"))).collect()} == {""}


def quote(**changes):
    row = {
        "provider": "feed", "snapshot_id": "s1", "schema_version": 1, "event_id": "e1", "market": "m", "player": "p",
        "side": "Over", "price": -110.0, "point": 20.5, "book": "b", "last_update": "t", "link": "l",
    }
    return {**row, **changes}


def quotes(spark, rows):
    from oddsloom.sources.files import schema_of

    frame = spark.createDataFrame([], schema_of("event_props"))
    return spark.createDataFrame([tuple(r[c] for c in frame.columns) for r in rows], frame.schema)


def test_canonical_order_and_ordinals(spark):
    rng = random.Random(2)
    rows = [
        quote(
            snapshot_id=rng.choice(["s1", "s1", "s2"]), event_id=rng.choice(["e1", " e1", None]), link=str(i),
            player=rng.choice(["é", "a", "Z"]), point=rng.choice([9.5, 10.5, 1e-7, 0.1 + 0.2, None, float("nan"), 100.0]),
        )
        for i in range(400)
    ]

    def key(r):
        number = lambda v: "" if v is None or v != v else f"{v:.12g}"
        text = [(r[c] or "").strip() if c not in canonical_order.NUMBERS else number(r[c]) for c in canonical_order.ORDER["event_props"]]
        return (r["snapshot_id"], *text, r["link"])

    frame = quotes(spark, rows).repartition(7)
    want = [(r["snapshot_id"], r["link"]) for r in sorted(rows, key=key)]
    ordered = canonical_order.canonical_sort(frame, "event_props", ("snapshot_id",), ("link",))
    assert [(r.snapshot_id, r.link) for r in ordered.collect()] == want
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange rangepartitioning") == 1
    places, seen = {}, {}
    for snapshot, link in want:
        seen[snapshot] = seen.get(snapshot, 0) + 1
        places[link] = seen[snapshot]
    found = canonical_order.with_ordinals(frame, "event_props", last=("link",)).collect()
    assert {r.link: r.ordinal for r in found} == places
    assert canonical_order.with_ordinals(frame.limit(0), "event_props").count() == 0


def stored(spark, rows):
    path = stage_path(spark, "table")
    frame = contracts.canonical(quotes(spark, rows), "event_props")
    canonical_order.canonical_sort(frame, "event_props", ("snapshot_id",)).coalesce(1).write.partitionBy("snapshot_id").parquet(path)
    return path


def listing(path):
    from pathlib import Path

    return sorted(str(p.relative_to(path.removeprefix("file://"))) for p in Path(path.removeprefix("file://")).rglob("*.parquet"))


def damaged_table(spark):
    """s1 is whole, s2 has untrimmed text, s 3 (a name that paths escape) is out of order."""
    path = stored(spark, [quote(snapshot_id=s, event_id=f"e{i}", link=str(i)) for s in ("s1", "s 3") for i in range(9)])
    bad = quotes(spark, [quote(snapshot_id="s2", player=" p ", link=str(i), price=float("nan")) for i in range(5)])
    bad.write.mode("append").partitionBy("snapshot_id").parquet(path)
    mixed = spark.read.parquet(path).where("snapshot_id = 's 3'").orderBy(F.desc("event_id")).coalesce(1)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    held = spark.createDataFrame(mixed.collect(), mixed.schema).coalesce(1)
    held.write.mode("overwrite").partitionBy("snapshot_id").parquet(path)
    return path


def test_repair_rewrites_damaged_partitions_only(spark):
    path = damaged_table(spark)
    before = listing(path)
    rows = sorted(map(str, contracts.canonical(spark.read.parquet(path), "event_props").collect()))
    assert repair.repair_table(spark, path, "event_props") == ["s 3", "s2"]
    after = listing(path)
    whole = [f for f in before if f.startswith("snapshot_id=s1/")]
    assert whole == [f for f in after if f.startswith("snapshot_id=s1/")] and not set(before) - set(whole) & set(after)
    spark.catalog.refreshByPath(path)
    now = spark.read.parquet(path)
    assert sorted(map(str, contracts.canonical(now, "event_props").collect())) == rows
    assert {r.player for r in now.collect()} == {"p"} and not [f for f in after if f.startswith("_")]
    assert canonical_order.unordered_files(now, "event_props").isEmpty()
    assert repair.repair_table(spark, path, "event_props") == [] and listing(path) == after


def test_failing_check_or_move_leaves_the_table(spark, monkeypatch):
    path = damaged_table(spark)
    before, rows = listing(path), sorted(map(str, spark.read.parquet(path).collect()))
    monkeypatch.setattr(repair, "staged_differences", lambda wanted, staged: wanted)
    with pytest.raises(repair.RepairError):
        repair.repair_table(spark, path, "event_props")
    assert listing(path) == before
    monkeypatch.undo()
    moves, real = [], repair._rename

    def third_fails(spark, source, target):
        moves.append(source)
        if len(moves) == 4:
            raise repair.RepairError("disk")
        real(spark, source, target)

    monkeypatch.setattr(repair, "_rename", third_fails)
    with pytest.raises(repair.RepairError):
        repair.repair_table(spark, path, "event_props")
    assert listing(path) == before
    spark.catalog.refreshByPath(path)
    assert sorted(map(str, spark.read.parquet(path).collect())) == rows


def export_inputs(spark):
    """Days 1 to 7: whole, incomplete, no status, no snapshot id, unknown snapshot, no quotes, no requests."""
    days = spark.createDataFrame([(f"2024-01-0{d}",) for d in range(1, 8)], "day string")
    status = spark.createDataFrame(
        [
            (f"2024-01-0{d}", d != 2, {4: " ", 5: "lost"}.get(d, f" s{d}"), [" ", f"r{d}"] if d == 7 else [], "sc" if d == 1 else "", 0.5, 0, 9)
            for d in (1, 2, 4, 5, 6, 7)
        ],
        "day string, complete boolean, snapshot_id string, reason_codes array<string>, status_code string, "
        "odds_coverage_ratio double, missing_count long, total_events long",
    )
    snapshots = spark.createDataFrame([("s1",), ("s2",), ("s6",), ("s7",)], "snapshot_id string")
    rows = quotes(spark, [quote(snapshot_id=s, event_id=e, player=p) for s in ("s1", "s2", "s7") for e in ("e1", "e2") for p in "ab"])
    requests = spark.createDataFrame(
        [
            ("s1", "event_odds: e1 ", "k2", "/p", "ok", None, {"regions": " us ", "other": "x"}),
            ("s1", "event_odds:e1", "k1", None, "ok", "now", None),
            ("s1", "event_odds:", "k0", "/p", "ok", None, {}),
            ("s1", "events", "k9", "/p", "ok", None, {}),
            ("s2", "event_odds:e1", "k1", "/p", "ok", None, {}),
        ],
        "snapshot_id string, label string, request_key string, path string, status string, updated_at_utc string, params map<string, string>",
    )
    return days, status, snapshots, rows, requests


def test_export_writes_or_skips_each_row_once(spark):
    from oddsloom.operators import exports

    root = stage_path(spark, "export")
    report = exports.export_days(root, "main", *export_inputs(spark))
    assert report.counts == {
        "days": 7, "exported_days": 2, "skipped_missing_day_status": 1, "skipped_incomplete_day": 1,
        "skipped_missing_snapshot_id": 1, "skipped_missing_snapshot": 1, "skipped_missing_event_props": 1,
        "fact_outcomes_rows": 8, "skipped_fact_rows": 4, "dim_request_rows": 4, "dim_day_status_rows": 2,
    }
    assert report.warnings == [
        ("2024-01-03", "missing_day_status"), ("2024-01-04", "missing_snapshot_id"), ("2024-01-05", "missing_snapshot"),
        ("2024-01-06", "missing_event_props"), ("2024-01-07", "missing_manifest"),
    ]
    facts = spark.read.parquet(f"{root}/fact_outcomes")
    assert {(str(r.day), r.event_id, r.request_key) for r in facts.collect()} == {
        ("2024-01-01", "e1", "k1"), ("2024-01-01", "e2", None), ("2024-01-07", "e1", None), ("2024-01-07", "e2", None),
    }
    sent = {r.request_key: r for r in spark.read.parquet(f"{root}/dim_request").collect()}
    assert set(sent) == {"k0", "k1", "k2", "k9"} and sent["k2"].param_regions == "us" and sent["k1"].param_regions == ""
    assert {(str(r.day), r.day_reason_code) for r in spark.read.parquet(f"{root}/dim_day_status").collect()} == {
        ("2024-01-01", "sc"), ("2024-01-07", "r7"),
    }
    with pytest.raises(FileExistsError, match="2024-01-01, 2024-01-07"):
        exports.export_days(root, "main", *export_inputs(spark))
    again = exports.export_days(root, "main", *export_inputs(spark), overwrite=True)
    assert again == report and spark.read.parquet(f"{root}/fact_outcomes").count() == 8


def test_day_sink_names_days_in_the_way(spark):
    from oddsloom.sources import files

    path = stage_path(spark, "days")
    rows = spark.createDataFrame([(f"2024-01-0{d % 3 + 1}", i) for i, d in enumerate(range(90))], "day string, v int")
    files.write_days(rows.where("day < '2024-01-03'"), path, False)
    assert files.partition_values(spark, path, "day") == ["2024-01-01", "2024-01-02"]
    with pytest.raises(FileExistsError, match="2024-01-01, 2024-01-02"):
        files.write_days(rows, path, False)
    files.write_days(rows, path, True)
    assert spark.read.parquet(path).count() == 90


def test_listing_index_and_discovery(spark, tmp_path):
    import json

    from oddsloom.sources import listing as listed

    def put(path, text):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)

    def line(game, path):
        return json.dumps({"game_id": game, "resources": {"boxscore": {"path": path, "status": "ok"}}})

    for name in ("a1", "a2", "b1", "c1", "d1"):
        put(f"raw/{name}.json", "" if name == "d1" else "{}")
    old = [line("a", "raw/a1.json"), line(" b ", "raw/b1.json"), "broken {", "[1]", "", line("", "raw/b1.json"), line("c", "raw/c1.json")]
    new = [line("a", "raw/a1.json"), line("a", " raw/a2.json "), line("c", "raw/gone.json"), line("d", "raw/d1.json"), json.dumps({"game_id": "e"}), line("f", "")]
    put("manifests/season=2023-24/season_type=regular/manifest.jsonl", "\n".join(old))
    put("manifests/season=2024-25/season_type=regular/manifest.jsonl", "\n".join(new) + "\n")
    put("manifests/season=2024-25/other.jsonl", line("z", "raw/a1.json"))
    put("datasets/one/spec.json", "{}")
    for day in ("2024-01-02", "2024-02-30", "someday", "2024-01-01"):
        put(f"datasets/two/days/{day}.json", "{}")
    put("datasets/two/days/2024-01-03.txt", "x")
    put("datasets/two/days/deep/2024-01-04.json", "x")
    put("datasets/none/readme.md", "x")
    root = str(tmp_path)
    files = listed.list_files(spark, root)
    index = {r.game_id: r.path for r in listed.boxscore_index(spark, root, files).collect()}
    # The newest line whose file is there: game c falls back to the older manifest.
    assert index == {"a": "raw/a2.json", "b": "raw/b1.json", "c": "raw/c1.json"}
    assert sorted(r.dataset_id for r in listed.datasets(files).collect()) == ["one", "two"]
    days = sorted((r.dataset_id, r.day) for r in listed.dataset_days(files).collect())
    assert days == [("two", "2024-01-01"), ("two", "2024-01-02")]
    sizes = {r.path: r.bytes for r in files.collect()}
    assert sizes["raw/a1.json"] == 2 and "raw/d1.json" not in sizes
    missing = listed.list_files(spark, root + "/nowhere")
    assert missing.count() == 0 and listed.boxscore_index(spark, root + "/nowhere", missing).count() == 0


def test_load_takes_expected_keys_and_a_batch_once(spark, tmp_path):
    import json
    import shutil

    from oddsloom.streaming import incremental

    source, target, marks = (tmp_path / n for n in ("in", "out", "marks"))
    source.mkdir()
    event = {"id": "e", "bookmakers": [{"key": "b", "markets": [{"key": "m", "outcomes": [
        {"name": side, "description": "p", "price": -110, "point": 1.5} for side in ("Over", "Under")]}]}]}

    def drop(name, *keys):
        rows = [{"provider": "feed", "snapshot_id": name, "request_key": k, "body": json.dumps(event)} for k in keys]
        (source / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))

    expected = spark.createDataFrame([("s1", "k1"), ("s1", "k1"), ("s2", "k2"), ("s9", "k9")], "snapshot_id string, request_key string")

    def load():
        incremental.load_new_payloads(spark, str(source), str(target), str(marks), expected)
        spark.catalog.refreshByPath(str(target))
        return sorted((r.snapshot_id, r["count"]) for r in spark.read.parquet(str(target)).groupBy("snapshot_id").count().collect())

    drop("s1", "k1", "k5")
    assert load() == [("s1", 2)]
    drop("s2", "k2")
    drop("s3", "k2")
    assert load() == [("s1", 2), ("s2", 2)]
    # The last batch runs again, as after a failure before its commit: it replaces itself.
    shutil.move(max((marks / "commits").glob("[0-9]*"), key=lambda p: int(p.name)), tmp_path / "lost-commit")
    for crc in (marks / "commits").glob(".*.crc"):
        shutil.move(crc, tmp_path / crc.name)
    assert load() == [("s1", 2), ("s2", 2)]
