import datetime as dt
import random

from pyspark.sql import functions as F

from oddsloom.operators import pricing, reference_curve

SCHEMA = (
    "snapshot_id string, event_id string, market string, player string, point double, side string, "
    "book string, price double, last_update timestamp, link string"
)


def quote(side, book, price, point=22.5, minute=50):
    return ("s", "e1", "player_points", "A B", point, side, book, float(price) if price else None, dt.datetime(2026, 1, 1, 11, minute), "")


def test_fair_pair_golden(spark):
    rows = [quote("Over", "a", -110), quote("over", "a", -120), quote("U", "a", 105), quote("under", "a", 100), quote("over", "b", 110)]
    pairs = pricing.fair_pairs(pricing.line_books(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(pairs) == 1
    assert round(pairs[0].p_over_fair, 6) == 0.517796 and round(pairs[0].hold, 6) == 0.011614


def test_quality_without_pairs(spark):
    rows = [quote("over", "a", -110, minute=50), quote("over", "b", -105, minute=40)]
    clock = spark.createDataFrame([("s", dt.datetime(2026, 1, 1, 12, 0))], "snapshot_id string, now_utc timestamp")
    row = pricing.quality_columns(
        pricing.best_pair_columns(
            pricing.line_panels(pricing.line_books(spark.createDataFrame(rows, SCHEMA))).join(clock, "snapshot_id")
        ).withColumn("hold_best", F.lit(0.06))
    ).first()
    assert (row.quote_age_minutes, row.hold_score, row.freshness_score) == (10.0, 0.5, 0.75)
    assert (row.quality_score, row.uncertainty_band) == (0.275, 0.1275)


def test_best_side_tie_takes_first_book(spark):
    rows = [quote("over", "z", 105), quote("over", "b", 105), quote("over", "", 105), quote("over", "c", None)]
    line = pricing.priced_lines(spark.createDataFrame(rows, SCHEMA)).first()
    assert line.over_best.book == "" and line.over_books == 3 and line.book_count == 3


def pool(values, weights):
    """Independent pool-adjacent-violators for checking."""
    blocks = []
    for v, w in zip(values, weights):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] < blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    return [b[0] / b[1] for b in blocks for _ in range(b[2])]


def test_isotonic_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for case in range(60):
        n = rng.randint(1, 12)
        rows.append((case, [round(rng.uniform(0.1, 0.9), 3) for _ in range(n)], [float(rng.randint(1, 5)) for _ in range(n)]))
    frame = spark.createDataFrame(rows, "id int, v array<double>, w array<double>")
    got = {r.id: r.fit for r in frame.select("id", reference_curve.isotonic_nonincreasing(F.col("v"), F.col("w")).alias("fit")).collect()}
    for case, v, w in rows:
        want = pool(v, w)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[case], want)) and len(got[case]) == len(want)


def test_estimate_methods(spark):
    points = spark.createDataFrame(
        [("s", "e", "m", "p", x, p, h, 1.0, ["b"]) for x, p, h in [(20.5, 0.6, 0.05), (22.5, 0.4, None)]],
        "snapshot_id string, event_id string, market string, player string, point double, p_over double, hold double, weight double, books_used array<string>",
    )
    curves = reference_curve.reference_curves(points)
    targets = spark.createDataFrame(
        [("s", "e", "m", "p", x) for x in (19.5, 20.5, 21.5, 23.5)],
        "snapshot_id string, event_id string, market string, player string, point double",
    )
    got = {r.point: r.reference for r in reference_curve.with_estimates(targets, curves).collect()}
    assert [got[x].method for x in (19.5, 20.5, 21.5, 23.5)] == ["clamped_low", "exact", "interpolated", "clamped_high"]
    assert abs(got[21.5].p_over - 0.5) < 1e-12 and got[21.5].hold == 0.05 and got[23.5].hold == 0.05
