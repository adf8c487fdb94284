"""Numbers as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def significant(number: Column, digits: int = 12) -> Column:
    """A number with so many significant digits, without trailing zeros; '' for null, NaN and infinities.

    Numbers below 1e-4 or with more places before the point than digits take an exponent of two places or more.
    Halves go to the even digit. A number that is no half but whose shortest decimal form looks like one (it needs
    a digit more than asked for, a 5) is rounded away from zero; numbers below 1e-307 may differ in their last digits.
    """
    finite = ~(F.isnan(number) | (F.abs(number) == float("inf")))

    def split(parts: Column) -> Column:
        shown = F.replace(F.get(parts, F.lit(0)), F.lit("."), F.lit(""))
        return F.struct(
            F.get(parts, F.lit(1)).cast("int").alias("power"),
            F.substring(shown, 1, digits).cast("bigint").alias("head"),
            F.rpad(F.substring(shown, digits + 1, 17), 17, "0").alias("rest"),
        )

    def rounded(s: Column) -> Column:
        # A number with p decimals is exactly that decimal if p halvings make it whole.
        scaled = F.abs(number) * F.pow(F.lit(2.0), F.greatest(F.lit(0), digits - s["power"]))
        half = (s["rest"] == "5".ljust(17, "0")) & (F.floor(scaled).cast("double") == scaled)
        up = (s["rest"] >= "5") & ~(half & (s["head"] % 2 == 0))
        return F.struct(s["power"].alias("power"), (s["head"] + F.when(up, 1).otherwise(0)).alias("head"))

    def carried(s: Column) -> Column:
        over = s["head"] == 10**digits
        return F.struct(
            (s["power"] + F.when(over, 1).otherwise(0)).alias("power"),
            F.lpad(F.when(over, 10 ** (digits - 1)).otherwise(s["head"]).cast("string"), digits, "0").alias("shown"),
        )

    def placed(s: Column) -> Column:
        """What stands before the point, after it, and the exponent."""
        power, shown = s["power"], s["shown"]
        long = (power < -4) | (power >= digits)
        size = F.abs(power).cast("string")
        return F.struct(
            F.when(long, F.substring(shown, 1, 1))
            .when(power >= 0, F.substring(shown, F.lit(1), power + 1))
            .otherwise("0")
            .alias("whole"),
            F.regexp_replace(
                F.when(long, F.substring(shown, 2, digits))
                .when(power >= 0, F.substring(shown, power + 2, F.lit(digits)))
                .otherwise(F.concat(F.repeat(F.lit("0"), -power - 1), shown)),
                "0+$",
                "",
            ).alias("fraction"),
            F.when(
                long,
                F.concat(
                    F.when(power < 0, "e-").otherwise("e+"),
                    F.when(F.length(size) < 2, F.lpad(size, 2, "0")).otherwise(size),
                ),
            )
            .otherwise("")
            .alias("exponent"),
        )

    def written(s: Column) -> Column:
        point = F.when(s["fraction"] == "", "").otherwise(".")
        minus = F.when(number.cast("string").startswith("-"), "-").otherwise("")  # minus zero too
        return F.concat(minus, s["whole"], point, s["fraction"], s["exponent"])

    # All digits that a number needs, and zeros.
    text = F.split(F.format_string("%.16e", F.when(finite, F.abs(number))), "e")
    for step in (split, rounded, carried, placed, written):
        text = _let(text, step)
    # Text of no more digits that reads back as the number is what rounding gives, if digits are fewer than a
    # double's 15. It spares most numbers the steps above.
    plain = number.cast("double").cast("string")
    short = ~plain.contains("E") & (F.length(plain) <= digits + 1) & F.lit(digits <= 15)
    whole = (F.abs(number) < 10 ** min(digits, 15)) & (number % 1 == 0) & (number != 0)
    return (
        F.when(number.isNull() | ~finite, "")
        .when(short, F.rtrim(F.rtrim(plain, F.lit("0")), F.lit(".")))
        .when(whole, number.cast("bigint").cast("string"))
        .otherwise(text)
    )
