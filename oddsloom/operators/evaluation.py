"""Graded tickets to scoreboards: proper scores, calibration error, gates and winners.

All measures are conditional sums over one map-side combined aggregation, so a strategy or
market with most of the tickets costs a handful of partial rows per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import odds, parsing

DEFAULT_BASELINE = "s007"
UPLIFTS = (0.01, 0.02, 0.03, 0.05)

# Standard normal quantiles for a two-sided 5 % test with 80 % power.
Z_ALPHA = 1.959963984540054
Z_POWER = 0.8416212335729143


@dataclass(frozen=True)
class GateThresholds:
    min_graded: int = 200
    min_scored_fraction: float = 0.9
    ece_slack: float = 0.01
    brier_slack: float = 0.01


def graded(tickets: DataFrame) -> DataFrame:
    """Tickets with a result and price, with stake, profit and scoring columns."""
    result = parsing.result_label(F.col("result"))
    stake = F.greatest(F.lit(0.0), F.coalesce(F.col("stake_units").cast("double"), F.lit(1.0)))
    base = tickets.withColumns({"result": result, "stake": stake}).where(
        (F.col("result") != "") & F.col("price_american").isNotNull()
    )
    decided = F.col("result").isin("win", "loss")

    def scored(name: str) -> Column:
        p = F.col(name)
        return F.when(decided & (p >= 0.0) & (p <= 1.0), p)

    ratio = F.when(
        (F.col("candidate_lines") > 0) & (F.col("eligible_lines") >= 0),
        odds.clamp(F.col("eligible_lines") / F.col("candidate_lines"), 0.0, 1.0),
    )
    return base.withColumns(
        {
            "pnl": odds.pnl_units(F.col("result"), F.col("price_american"), F.col("stake")),
            "p": scored("model_p_hit"),
            "p_low": scored("p_hit_low"),
            "hit": (F.col("result") == "win").cast("int"),
            "actionability": ratio,
        }
    )


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, profit and proper scores per group of graded rows."""
    hit = F.col("hit")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_graded"),
        F.count("p").alias("rows_scored"),
        F.count_if(F.col("result") == "win").alias("wins"),
        F.count_if(F.col("result") == "loss").alias("losses"),
        F.count_if(F.col("result") == "push").alias("pushes"),
        F.sum("stake").alias("total_stake_units"),
        F.sum("pnl").alias("total_pnl_units"),
        F.when(F.sum("stake") > 0, F.sum("pnl") / F.sum("stake")).alias("roi"),
        F.avg("best_ev").alias("avg_best_ev"),
        F.avg("ev_low").alias("avg_ev_low"),
        F.avg("quality_score").alias("avg_quality_score"),
        F.avg("p_low").alias("avg_p_hit_low"),
        F.avg(odds.brier_term(F.col("p"), hit)).alias("brier"),
        F.avg(odds.brier_term(F.col("p_low"), hit)).alias("brier_low"),
        F.avg(F.when(F.col("p").isNotNull(), odds.log_loss_term(F.col("p"), hit))).alias("log_loss"),
        F.avg("actionability").alias("actionability_rate"),
    )


def calibration_bins(rows: DataFrame, keys: list[str], size: float = 0.05) -> DataFrame:
    """Average probability, hit rate and Brier score per probability bin."""
    p, hit = F.col("p"), F.col("hit")
    binned = rows.where(p.isNotNull()).withColumn("bin", odds.bin_index(p, size))
    return binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("p").alias("avg_p"),
        F.avg(hit.cast("double")).alias("hit_rate"),
        F.avg(odds.brier_term(p, hit)).alias("brier"),
    ).withColumns(
        {
            "bucket_low": odds.bin_low(F.col("bin"), size),
            "bucket_high": odds.bin_high(F.col("bin"), size),
        }
    )


def calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and maximum calibration error from bins."""
    gap = F.abs(F.col("avg_p") - F.col("hit_rate"))
    return bins.groupBy(*keys).agg(
        (F.sum(gap * F.col("count")) / F.sum("count")).alias("ece"), F.max(gap).alias("mce")
    )


def scoreboard(tickets: DataFrame, keys: list[str], size: float = 0.05) -> DataFrame:
    """Summary with calibration error; one row per group."""
    rows = graded(tickets)
    errors = calibration_error(calibration_bins(rows, keys, size), keys)
    return summary(rows, keys).join(errors, keys, "left")


def baseline_id(board: DataFrame, requested: str = "") -> DataFrame:
    """One row with the baseline strategy: requested, else the default if present, else the first."""
    if requested.strip():
        return board.sparkSession.range(1).select(F.lit(requested.strip()).alias("baseline_id"))
    ids = board.where(F.trim("strategy_id") != "")
    return ids.agg(
        F.coalesce(
            F.max(F.when(F.col("strategy_id") == DEFAULT_BASELINE, F.col("strategy_id"))),
            F.min("strategy_id"),
        ).alias("baseline_id")
    )


def with_baseline(board: DataFrame, segment: list[str], requested: str = "") -> DataFrame:
    """Board rows next to the ECE and Brier score of the baseline of their segment.

    The baseline id is a single value and its board one row per segment.
    """
    chosen = baseline_id(board, requested)
    base = board.join(F.broadcast(chosen), F.col("strategy_id") == F.col("baseline_id"))
    base = base.select(
        *segment,
        "baseline_id",
        F.col("ece").alias("baseline_ece"),
        F.col("brier").alias("baseline_brier"),
        F.lit(True).alias("baseline_found"),
    )
    if segment:
        return board.join(base, segment, "left").withColumn(
            "baseline_found", F.coalesce("baseline_found", F.lit(False))
        )
    return board.join(F.broadcast(base), F.lit(True), "left").withColumn(
        "baseline_found", F.coalesce("baseline_found", F.lit(False))
    )


def promotion_gate(board: DataFrame, limits: GateThresholds = GateThresholds()) -> DataFrame:
    """Promotion status and sorted reasons per board row with baseline columns."""
    decided = F.col("wins") + F.col("losses")
    fraction = F.when(decided > 0, F.col("rows_scored") / decided).otherwise(F.lit(0.0))
    floor = min(1.0, max(0.0, limits.min_scored_fraction))
    other = F.col("baseline_found") & (F.col("strategy_id") != F.col("baseline_id"))
    reasons = F.array_sort(
        F.array_compact(
            F.array(
                F.when(~F.col("baseline_found"), "missing_baseline"),
                F.when(F.col("rows_graded") < max(0, limits.min_graded), "insufficient_graded"),
                F.when((decided <= 0) | (fraction < floor), "insufficient_scored_rows"),
                F.when(F.col("ece").isNull(), "missing_calibration"),
                F.when(
                    other & (F.col("ece") > F.col("baseline_ece") + max(0.0, limits.ece_slack)),
                    "calibration_regressed",
                ),
                F.when(
                    other & (F.col("brier") > F.col("baseline_brier") + max(0.0, limits.brier_slack)),
                    "brier_regressed",
                ),
            )
        )
    )
    return board.withColumns(
        {
            "gate_reasons": reasons,
            "gate_status": F.when(F.size(reasons) == 0, "pass").otherwise("fail"),
            "rows_win_loss": decided,
            "scored_fraction": fraction,
        }
    )


def execution_order() -> Column:
    """Sort struct of the winner rule: ROI, rows, ECE, Brier score, id."""
    return F.struct(
        -F.coalesce("roi", F.lit(-9999.0)),
        -F.col("rows_graded"),
        F.coalesce("ece", F.lit(9999.0)),
        F.coalesce("brier", F.lit(9999.0)),
        F.col("strategy_id"),
    )


def winners(board: DataFrame, segment: list[str]) -> DataFrame:
    """Execution winner per segment, and the winner among gate-passing rows."""
    row = F.struct("strategy_id", "roi", "rows_graded", "ece", "brier", "gate_status")
    order = execution_order()
    passed = F.col("gate_status") == "pass"
    picked = board.groupBy(*segment).agg(
        F.min_by(row, order).alias("best"),
        F.min_by(F.when(passed, row), F.when(passed, order)).alias("promoted"),
    )
    return picked.select(
        *segment,
        F.col("best.strategy_id").alias("winner_id"),
        F.col("best.roi").alias("winner_roi"),
        F.col("best.rows_graded").alias("winner_rows_graded"),
        F.col("best.gate_status").alias("winner_gate_status"),
        F.coalesce("promoted.strategy_id", F.lit("")).alias("promotion_winner_id"),
    )


def roi_winner(board: DataFrame, min_graded: int) -> DataFrame:
    """Best ROI among rows with enough graded tickets."""
    order = F.struct(
        -F.coalesce("roi", F.lit(-9999.0)), -F.col("rows_graded"), F.col("strategy_id")
    )
    return (
        board.where(F.col("rows_graded") >= max(0, min_graded))
        .agg(F.min_by(F.struct("strategy_id", "roi", "rows_graded"), order).alias("best"))
        .select("best.*")
    )


def daily_pnl(tickets: DataFrame) -> DataFrame:
    """Profit per strategy and day with graded tickets."""
    return graded(tickets).groupBy("strategy_id", F.col("modeled_day").alias("day")).agg(
        F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("graded")
    )


def power_guidance(
    daily: DataFrame, baseline: str = DEFAULT_BASELINE, picks_per_day: int = 5,
    uplifts: tuple[float, ...] = UPLIFTS,
) -> DataFrame:
    """Days needed to show an uplift over the baseline, per strategy and target uplift.

    Strategies and baseline meet on the day; their daily rows are already aggregated.
    """
    base = daily.where(F.col("strategy_id") == baseline).select(
        "day", F.col("pnl").alias("baseline_pnl")
    )
    others = daily.where(F.col("strategy_id") != baseline)
    diffs = others.join(base, "day", "left").withColumn("diff", F.col("pnl") - F.col("baseline_pnl"))
    stats = diffs.groupBy("strategy_id").agg(
        F.count("diff").alias("overlap_days"),
        F.avg("diff").alias("mean_daily_pnl_diff"),
        F.stddev_samp("diff").alias("std"),
    )
    target = F.explode(F.array(*[F.lit(u) for u in sorted(uplifts)]))
    rows = stats.withColumn("target_roi_uplift_per_bet", target).withColumns(
        {
            "insufficient_overlap": F.col("overlap_days") < 2,
            "std_daily_pnl_diff": F.when(F.col("overlap_days") >= 2, F.col("std")),
            "daily_effect_units": F.col("target_roi_uplift_per_bet") * max(1, picks_per_day),
        }
    )
    ratio = (Z_ALPHA + Z_POWER) * F.col("std_daily_pnl_diff") / F.col("daily_effect_units")
    days = F.when(F.col("std_daily_pnl_diff") == 0.0, F.lit(1)).when(
        F.col("std_daily_pnl_diff").isNotNull(),
        F.greatest(F.lit(1), F.ceil(F.pow(ratio, 2)).cast("long")),
    )
    return rows.withColumn("required_days", days).withColumns(
        {
            "required_graded_rows": F.col("required_days") * max(1, picks_per_day),
            "meets_with_observed_days": F.coalesce(
                F.col("overlap_days") >= F.col("required_days"), F.lit(False)
            ),
        }
    ).drop("std")


def power_gate(
    board: DataFrame, guidance: DataFrame, target: float, baseline: str = DEFAULT_BASELINE
) -> DataFrame:
    """Power status per strategy for the guidance row nearest to the target uplift."""
    gap = F.abs(F.col("target_roi_uplift_per_bet") - target)
    order = F.struct(gap, F.col("target_roi_uplift_per_bet"))
    nearest = guidance.groupBy("strategy_id").agg(
        F.min_by(
            F.struct("overlap_days", "insufficient_overlap", "required_days", "required_graded_rows"),
            order,
        ).alias("row")
    )
    joined = board.select("strategy_id", "rows_graded").join(nearest, "strategy_id", "left")
    needed = F.coalesce(F.col("row.required_graded_rows"), F.lit(0))
    is_base = F.col("strategy_id") == baseline
    reason = (
        F.when(F.lit(target <= 0.0), "missing_power_target")
        .when(is_base, "")
        .when(F.col("row").isNull(), "missing_power_row")
        .when(F.col("row.insufficient_overlap"), "insufficient_overlap_for_power")
        .when(needed <= 0, "missing_required_rows")
        .when(F.col("rows_graded") < needed, "underpowered_for_target_uplift")
        .otherwise("")
    )
    status = (
        F.when(is_base & F.lit(target > 0.0), "baseline")
        .when(reason == "", "pass")
        .when(
            reason.isin("insufficient_overlap_for_power", "underpowered_for_target_uplift"), "fail"
        )
        .otherwise("unknown")
    )
    return joined.select(
        "strategy_id", "rows_graded", status.alias("power_status"), reason.alias("power_reason"),
        F.col("row.overlap_days").alias("observed_days"),
        F.col("row.required_days").alias("required_days"),
        F.col("row.required_graded_rows").alias("required_graded_rows"),
    )
