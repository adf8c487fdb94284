import random

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import portfolio

SCHEMA = (
    "snapshot_id string, strategy_id string, event_id string, player string, player_key string, market string, point double, "
    "recommended_side string, ev_low double, best_ev double, quality_score double, historical_prior_delta double, "
    "ev_low_calibrated double, calibration_confidence double, quote_age_minutes double, eligible boolean, portfolio_ranking string"
)


def row(group, event, player, point, ev):
    return (group, "s001", event, player, player, "m", float(point), "over", ev, ev, 0.5, 0.0, None, 0.0, 1.0, True, "default")


def greedy(rows, caps):
    picked, reasons = [], {}
    for r in sorted(rows, key=lambda r: (-r[8], r[2], r[4], r[6])):
        event, player = r[2], r[4]
        if len(picked) >= caps.max_picks:
            reason = "portfolio_cap_daily"
        elif caps.max_per_player and player and sum(p[4] == player for p in picked) >= caps.max_per_player:
            reason = "portfolio_cap_player"
        elif caps.max_per_game and event and sum(p[2] == event for p in picked) >= caps.max_per_game:
            reason = "portfolio_cap_game"
        else:
            reason = ""
            picked.append(r)
        reasons[(r[2], r[4], r[6])] = reason
    return reasons


@pytest.mark.parametrize(
    "caps", [portfolio.Caps(3, 1, 2), portfolio.Caps(6, 2, 1), portfolio.Caps(5, 0, 2), portfolio.Caps(4, 1, 0), portfolio.Caps(4, 0, 0)]
)
def test_matches_greedy_loop(spark, caps):
    rng = random.Random(caps.max_picks)
    rows, want = [], {}
    for g in range(25):
        group = [
            row(f"g{g}", rng.choice(["", "e1", "e2", "e3"]), rng.choice(["", "p1", "p2", "p3", "p4"]), i, round(rng.uniform(0, 1), 2))
            for i in range(rng.randint(1, 40))
        ]
        rows += group
        want.update({(f"g{g}", *k): v for k, v in greedy(group, caps).items()})
    got = portfolio.select_portfolio(spark.createDataFrame(rows, SCHEMA), caps).collect()
    assert {(r.snapshot_id, r.event_id, r.player_key, r.point): r.portfolio_reason for r in got} == want


def test_zero_picks_selects_nothing(spark):
    rows = spark.createDataFrame([row("g", "e", "p", 1, 0.5)], SCHEMA)
    got = portfolio.select_portfolio(rows, portfolio.Caps(0, 1, 2)).first()
    assert not got.portfolio_selected and got.portfolio_reason == "portfolio_cap_daily"


def test_calibrated_ranking_blends(spark):
    rows = spark.createDataFrame([row("g", "e", "p", 1, 0.1)], SCHEMA).withColumns(
        {"ev_low_calibrated": F.lit(0.3), "calibration_confidence": F.lit(1.0)}
    )
    value = rows.select(portfolio.primary_value(F.lit("calibrated_ev_low")).alias("v")).first().v
    assert abs(value - (0.7 * 0.1 + 0.3 * 0.3)) < 1e-12
