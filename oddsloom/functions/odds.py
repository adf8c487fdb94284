"""American-odds arithmetic as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBABILITY_FLOOR = 0.01
PROBABILITY_CEILING = 0.99


def round6(value: Column) -> Column:
    """Round to six places; values within 1e-12 of a half go up, whatever their binary form."""
    return F.round(value + 1e-12, 6)


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    """Keep ``value`` inside [low, high]; null stays null."""
    low_col = low if isinstance(low, Column) else F.lit(float(low))
    high_col = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.greatest(low_col, F.least(high_col, value)))


def clamp_probability(value: Column) -> Column:
    return clamp(value, PROBABILITY_FLOOR, PROBABILITY_CEILING)


def implied_probability(price: Column) -> Column:
    """Break-even probability of an American price; zero or null has none."""
    return F.when(price > 0, F.lit(100.0) / (price + 100.0)).when(
        price < 0, -price / (F.lit(100.0) - price)
    )


def decimal_odds(price: Column) -> Column:
    return F.when(price > 0, price / 100.0 + 1.0).when(price < 0, F.lit(1.0) - F.lit(100.0) / price)


def american_odds(decimal: Column) -> Column:
    """Nearest American price (ties to even); decimal odds of 1 or less have none."""
    profit = decimal - 1.0
    return F.when(
        decimal >= 2.0, F.bround(profit * 100.0, 0).cast("int")
    ).when(decimal > 1.0, F.bround(F.lit(-100.0) / profit, 0).cast("int"))


def no_vig_over(over_implied: Column, under_implied: Column) -> Column:
    """Over share of the implied pair; an empty pair is a coin flip."""
    total = over_implied + under_implied
    return F.when(total > 0, over_implied / total).when(total <= 0, F.lit(0.5))


def hold(over_implied: Column, under_implied: Column) -> Column:
    return over_implied + under_implied - 1.0


def expected_value(probability: Column, price: Column) -> Column:
    """Profit per unit staked; undefined for certain outcomes or missing prices."""
    payout = decimal_odds(price)
    return F.when(
        (probability > 0) & (probability < 1) & (payout > 1),
        probability * (payout - 1.0) - (1.0 - probability),
    )


def rounded_ev(probability: Column, price: Column) -> Column:
    return round6(expected_value(probability, price))


def kelly_fraction(probability: Column, price: Column) -> Column:
    payout = decimal_odds(price)
    return F.when(payout > 1, round6(expected_value(probability, price) / (payout - 1.0)))


def play_to_decimal(probability: Column, target_roi: float | Column) -> Column:
    roi = target_roi if isinstance(target_roi, Column) else F.lit(float(target_roi))
    return F.when(probability > 0, (roi + 1.0) / probability)


def pnl_units(result: Column, price: Column, stake: Column) -> Column:
    """Settled profit for one graded ticket."""
    win_return = F.when(price > 0, stake * (price / 100.0)).when(
        price < 0, stake * (F.lit(100.0) / F.abs(price))
    )
    return (
        F.when(stake <= 0, F.lit(0.0))
        .when(result == "loss", -stake)
        .when(result == "win", F.coalesce(win_return, F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )


def brier_term(probability: Column, hit: Column) -> Column:
    return F.pow(probability - hit.cast("double"), 2)


def log_loss_term(probability: Column, hit: Column) -> Column:
    safe = clamp(probability, 1e-6, 1.0 - 1e-6)
    return F.when(hit == 1, -F.log(safe)).otherwise(-F.log(1.0 - safe))


def bin_size(raw: float) -> float:
    """Bin width limited to [0.02, 0.5]; a non-positive width means the default of 0.1."""
    return 0.1 if raw <= 0 else max(0.02, min(0.5, raw))


def bin_index(probability: Column, size: float) -> Column:
    top = int(1.0 / size)
    return F.greatest(
        F.lit(0), F.least(F.lit(top), F.floor(probability / F.lit(size)).cast("int"))
    )


def bin_low(index: Column, size: float) -> Column:
    return index * F.lit(size)


def bin_high(index: Column, size: float) -> Column:
    return F.least(F.lit(1.0), index * F.lit(size) + F.lit(size))


def interpolate(x0: Column, x1: Column, y0: Column, y1: Column, target: Column) -> Column:
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * ((target - x0) / (x1 - x0)))


def zero_as_missing(value: Column, default: float) -> Column:
    """A stored zero counts as missing here, as it does in the ranking rules."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(default))


def sorted_quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of an ascending array; null for an empty one."""
    count = F.size(values)
    position = (count - 1) * F.lit(q)
    low = F.floor(position).cast("int")
    high = F.least(low + 1, count - 1)
    weight = position - low
    return F.when(
        count > 0,
        F.get(values, low) * (1.0 - weight) + F.get(values, high) * weight,
    )
