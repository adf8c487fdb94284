import datetime as dt


from oddsloom.operators import calibration, evaluation, settlement

TICKET = (
    "strategy_id string, modeled_day date, market string, recommended_side string, result string, price_american int, stake_units double, "
    "model_p_hit double, p_hit_low double, best_ev double, ev_low double, quality_score double, candidate_lines double, eligible_lines double"
)


def ticket(result, price, p, low, day=1, strategy="s001"):
    return (strategy, dt.date(2026, 1, day), "player_points", "over", result, price, 1.0, p, low, 0.05, 0.01, 0.6, 10.0, 5.0)


def test_extreme_probabilities(spark):
    rows = spark.createDataFrame([ticket("win", -110, 0.0, 0.0), ticket("loss", -110, 1.0, 1.0)], TICKET)
    row = evaluation.scoreboard(rows, ["strategy_id"]).first()
    assert round(row.log_loss, 6) == 13.815511 and row.ece == 1.0 and row.brier == 1.0


def test_scoreboard_counts_and_roi(spark):
    rows = spark.createDataFrame(
        [ticket("W", 100, 0.6, 0.55), ticket("loss", 100, 0.55, 0.5), ticket("Push", 100, 0.5, 0.45), ticket("", 100, 0.5, 0.4), ticket("win", None, 0.5, 0.4)],
        TICKET,
    )
    row = evaluation.scoreboard(rows, ["strategy_id"]).first()
    assert (row.wins, row.losses, row.pushes, row.rows_graded, row.roi) == (1, 1, 1, 3, 0.0)
    assert round(row.brier, 6) == 0.23125 and round(row.brier_low, 6) == 0.22625 and row.actionability_rate == 0.5


def test_priors_exclude_the_as_of_day(spark):
    rows = spark.createDataFrame([ticket("win", 100, 0.5, 0.4, d) for d in (1, 2, 10)], TICKET)
    days = spark.createDataFrame([(dt.date(2026, 1, 10),)], "as_of date")
    daily = calibration.daily_outcomes(rows, 0.1)
    got = calibration.prior_adjustments(calibration.windowed_outcomes(daily, days, 21)).collect()
    assert [(r.sample_size, r.wins) for r in got] == [(2, 2)]
    short = calibration.prior_adjustments(calibration.windowed_outcomes(daily, days, 8)).collect()
    assert [(r.sample_size,) for r in short] == [(1,)]


def test_walk_forward_uses_strictly_earlier_days(spark):
    rows = spark.createDataFrame([ticket("win", 100, 0.52, 0.4, 1), ticket("loss", 100, 0.52, 0.4, 2), ticket("win", 100, 0.71, 0.4, 3)], TICKET)
    got = {(r.day.day, r.bin): (r["count"], r.hit_rate) for r in calibration.walk_forward_map(rows).collect()}
    assert got == {(2, 10): (1, 1.0), (3, 10): (2, 0.5)}


def test_power_guidance_golden(spark):
    days = [(s, dt.date(2026, 1, d), v) for s, vs in {"s007": (0.0, 0.1, -0.1, 0.05), "s008": (0.1, 0.2, 0.0, 0.25)}.items() for d, v in zip((1, 2, 3, 4), vs)]
    rows = evaluation.power_guidance(spark.createDataFrame(days, "strategy_id string, day date, pnl double")).collect()
    assert {r.overlap_days for r in rows} == {4} and len(rows) == 4
    by_target = {r.target_roi_uplift_per_bet: r for r in rows}
    assert by_target[0.02].required_graded_rows == 5 * by_target[0.02].required_days


def test_name_ladder(spark):
    players = spark.createDataFrame(
        [("s", "g", n, 10.0, 5.0, 3.0, 1.0) for n in ("Gary Payton II", "Tim Hardaway", "J. Brunson", "Jalen Williams", "Jaylin Williams", "Kenrich Williams")],
        "snapshot_id string, game_id string, player string, points double, rebounds double, assists double, threes double",
    )
    wanted = ["Gary Payton II", "Tim Hardaway Jr.", "Jalen Brunson", "Kenneth Williams", "Jack Williams", "Nobody Here"]
    tickets = spark.createDataFrame([("s", "g", n) for n in wanted], "snapshot_id string, game_id string, player string")
    got = {r.player: r.matched_by for r in settlement.resolve_players(tickets, players).collect()}
    assert got == {
        "Gary Payton II": "key", "Tim Hardaway Jr.": "key", "Jalen Brunson": "last_name",
        "Kenneth Williams": "initial", "Jack Williams": "ambiguous", "Nobody Here": "not_found",
    }


def test_settlement_outcomes(spark):
    games = spark.createDataFrame(
        [("s", "Home A", "Away A", "g1", "final", 1), ("s", "Home B", "Away B", "g2", "in_progress", 2)],
        "snapshot_id string, home_team string, away_team string, game_id string, game_status string, game_order int",
    )
    players = spark.createDataFrame(
        [("s", "g1", "Al Bo", 20.0, 7.0, 4.0, 2.0)],
        "snapshot_id string, game_id string, player string, points double, rebounds double, assists double, threes double",
    )
    cases = [
        ("t1", "Away A @ Home A", "", "", "Al Bo", "player_points", "over", 18.5, "win"),
        ("t2", "", "Away A", "Home A", "Al Bo", "player_rebounds", "under", 7.0, "push"),
        ("t3", "", "Home B", "Away B", "Al Bo", "player_points", "over", 1.5, "pending"),
        ("t4", "", "Home A", "Away A", "Al Bo", "player_steals", "over", 1.5, "unresolved"),
        ("t5", "", "Home C", "Away C", "Al Bo", "player_points", "over", 1.5, "unresolved"),
        ("t6", "", "Home A", "Away A", "No One", "player_points", "over", 1.5, "unresolved"),
    ]
    tickets = spark.createDataFrame(
        [("s", *c[:8]) for c in cases],
        "snapshot_id string, ticket_key string, game string, home_team string, away_team string, player string, market string, recommended_side string, point double",
    )
    got = {r.ticket_key: (r.result, r.result_reason) for r in settlement.settle(tickets, games, players).collect()}
    assert {k: v[0] for k, v in got.items()} == {c[0]: c[8] for c in cases}
    assert got["t4"][1] == "unsupported_market" and got["t5"][1] == "game_not_found" and got["t6"][1] == "player_not_found"
