from pyspark.sql import functions as F

from oddsloom.functions import clocks, hashing, names, odds, parsing, states


def values(spark, rows, schema, **columns):
    frame = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in frame.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_american_odds_table(spark):
    prices = [(100,), (150,), (-150,), (0,), (None,)]
    got = values(spark, prices, "p int", i=odds.implied_probability(F.col("p")), d=odds.decimal_odds(F.col("p")))
    assert [r[0] for r in got] == [0.5, 0.4, 0.6, None, None]
    assert [round(r[1], 6) if r[1] else None for r in got] == [2.0, 2.5, 1.666667, None, None]
    back = values(spark, [(2.5,), (2.0,), (1.5,), (1.0,)], "d double", a=odds.american_odds(F.col("d")))
    assert [r[0] for r in back] == [150, 100, -200, None]


def test_ev_needs_open_probability(spark):
    got = values(spark, [(0.55, 100), (1.0, 100), (0.5, None)], "p double, a int", e=odds.rounded_ev(F.col("p"), F.col("a")))
    assert [r[0] for r in got] == [0.1, None, None]


def test_integer_parsers_differ_on_decimals(spark):
    rows = [("100",), ("+100",), ("100.0",), ("1.5",), ("x",), ("",)]
    got = values(spark, rows, "t string", s=parsing.strict_int_text(F.col("t")), n=parsing.near_int_text(F.col("t")))
    assert got == [(100, 100), (100, 100), (None, 100), (None, None), (None, None), (None, None)]


def test_clock_minutes(spark):
    rows = [("PT34M12.00S",), ("12:30",), ("7",), ("bad",), ("PT05S",)]
    got = [r[0] for r in values(spark, rows, "t string", m=parsing.clock_minutes(F.col("t")))]
    assert [round(x, 4) if x is not None else None for x in got] == [34.2, 12.5, 7.0, None, 0.0833]


def test_person_keys_fold_accents(spark):
    rows = [("Nikola Jokić",), ("Luka Dončić Jr.",), ("  O'Neal III ",), ("Ørsted Ǆ",)]
    got = values(spark, rows, "n string", k=names.person_key(F.col("n")), a=names.name_aliases(F.col("n")), l=names.last_word(F.col("n")))
    assert [r[0] for r in got] == ["nikolajokic", "lukadoncicjr", "onealiii", "rsteddz"]
    assert got[2][1] == ["oneal", "onealiii"] and got[2][2] == "neal"


def test_team_keys(spark):
    rows = [("  LA   Lakers ",), ("gsw",), ("Nowhere FC",)]
    got = values(spark, rows, "n string", k=names.team_key(F.col("n")), c=names.team_code(F.col("n")))
    assert got == [("los angeles lakers", "LAL"), ("golden state warriors", "GSW"), ("nowhere fc", "FC")]


def test_injury_status_order(spark):
    rows = [("Out for season",), ("Out",), ("Without doubt",), ("Game-Time Decision",), ("Day-To-Day",)]
    got = [r[0] for r in values(spark, rows, "t string", s=states.injury_status(F.col("t")))]
    assert got == ["out_for_season", "out", "unknown", "questionable", "day_to_day"]


def test_snapshot_days(spark):
    rows = [("2026-02-12T10",), ("daily-20260213T233551Z",), ("day-abc-2026-02-14",), ("other",)]
    got = [str(r[0]) for r in values(spark, rows, "s string", d=clocks.snapshot_day(F.col("s")))]
    assert got == ["2026-02-12", "2026-02-13", "2026-02-14", "None"]
    label = values(spark, [("Thursday, Feb 12, 2026 (ET)",)], "s string", d=clocks.modeled_day(F.col("s")))
    assert str(label[0][0]) == "2026-02-12"


def test_day_window_crosses_daylight_saving(spark):
    frame = spark.sql("select date'2026-03-08' as d")
    row = frame.select(
        ((F.unix_timestamp(clocks.day_end_utc(F.col("d"))) - F.unix_timestamp(clocks.day_start_utc(F.col("d")))) / 3600).alias("h")
    ).first()
    assert row.h == 23.0


def test_ticket_key_escapes_wide_characters(spark):
    import hashlib
    import json

    payload = {"version": 2, "event_id": "e1", "player": "jokić 😀", "market": "player_points", "point": 22.5, "side": "over"}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    got = values(
        spark, [("e1", "Jokić 😀", "player_points", 22.5, "over")], "e string, p string, m string, x double, s string",
        k=hashing.ticket_key(F.col("e"), F.col("p"), F.col("m"), F.col("x"), F.col("s")),
    )
    assert got == [(want,)]


def test_day_reasons(spark):
    rows = [(False, "HTTP 404", "", 3), (False, "", "", 2), (True, "", "", 0), (False, "", "something", 0)]
    codes = states.day_reason_codes(F.col("c"), F.lit(None).cast("array<string>"), F.col("e"), F.col("n"), F.col("m"))
    got = [r[0] for r in values(spark, rows, "c boolean, e string, n string, m int", r=codes)]
    assert got == [["upstream_404"], ["missing_event_odds"], ["complete"], ["note"]]
