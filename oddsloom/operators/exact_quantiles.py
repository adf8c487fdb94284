"""Exact medians of many columns at once, in two passes.

The first pass brackets each median with a sketch of bounded size and known rank error. The second one counts rows
below the bracket and rows by value inside it, in the tasks first; what is then ranked is a thousandth of the rows at most, or
few values with many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10000


def medians(rows: DataFrame, columns: tuple[str, ...], accuracy: int = ACCURACY) -> DataFrame:
    """column, n (values that are no null or NaN) and median: the middle value, or the mean of the two."""
    numbers = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns}
    base = rows.select(*[v.alias(f"v{i}") for i, v in enumerate(numbers.values())])
    # The sketch's rank error is one part of its accuracy at most; thrice that is left on both sides.
    shares = [0.5 - 3 / accuracy, 0.5 + 3 / accuracy]
    found = base.agg(
        *[F.percentile_approx(c, F.lit(shares), accuracy).alias(c) for c in base.columns],
        *[F.count(c).alias(f"n_{c}") for c in base.columns],
    ).first()
    cells = []
    for i, c in enumerate(base.columns):
        if found[c]:
            low, high = found[c]
            value = F.when(F.col(c) >= low, F.col(c))  # null: below the bracket
            cells.append(F.when(F.col(c) <= high, F.struct(F.lit(i).alias("i"), value.alias("value"))))
    names = rows.sparkSession.createDataFrame(
        [(i, name, found[f"n_v{i}"]) for i, name in enumerate(columns)], "i int, column string, n long"
    )
    if not cells:
        return names.select("column", "n", F.lit(None).cast("double").alias("median"))
    counted = (
        base.select(F.explode(F.array_compact(F.array(*cells))).alias("cell"))
        .groupBy("cell.i", "cell.value")
        .count()
    )
    upto = Window.partitionBy("i").orderBy(F.col("value").asc_nulls_first())
    reached = counted.withColumn("reached", F.sum("count").over(upto)).join(names, "i")

    def ranked(rank: str):
        return F.min(F.when(F.col("reached") > F.expr(rank), F.col("value")))

    middle = reached.groupBy("column", "n").agg(((ranked("(n - 1) div 2") + ranked("n div 2")) / 2).alias("median"))
    return names.select("column", "n").join(middle, ["column", "n"], "left")
