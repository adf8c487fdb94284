"""The canonical order of quote tables: text keys, numbers compared as text of twelve digits, missing ones first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsloom.functions import formats, parsing
from oddsloom.session import materialize

# The columns that order each table.
ORDER = {
    "event_props": ("event_id", "player", "market", "point", "side", "book", "price", "last_update"),
    "featured_odds": ("game_id", "market", "point", "side", "book", "price", "last_update"),
}
NUMBERS = ("point", "price")


def sort_keys(table: str, schema: T.StructType | None = None) -> list[Column]:
    """Keys of a table; with its ``schema``, columns of doubles are not read from text."""

    def number(c: str) -> Column:
        ready = schema is not None and c in schema.names and isinstance(schema[c].dataType, T.DoubleType)
        # NaN and infinities show as missing either way.
        return F.col(c) if ready else parsing.float_or_null(F.col(c))

    return [formats.significant(number(c)) if c in NUMBERS else parsing.text(F.col(c)) for c in ORDER[table]]


def canonical_sort(
    rows: DataFrame,
    table: str,
    first: tuple[str, ...] = (),
    last: tuple[str, ...] = (),
    texts: dict[str, str] | None = None,
) -> DataFrame:
    """Rows in canonical order over all partitions, by one range exchange: files written from it are in order.

    ``first`` columns go before the canonical keys, ``last`` ones decide between equal keys; ``texts`` as in
    :func:`with_ordinals`.
    """
    names = [f"__k{i}" for i in range(len(ORDER[table]))]
    keyed = rows.withColumns(dict(zip(names, sort_keys(table, rows.schema))))
    kept = {names[ORDER[table].index(number)]: name for number, name in (texts or {}).items()}
    return keyed.orderBy(*first, *names, *last).withColumnsRenamed(kept).drop(*names)


def with_ordinals(
    rows: DataFrame,
    table: str,
    group: str = "snapshot_id",
    last: tuple[str, ...] = (),
    texts: dict[str, str] | None = None,
) -> DataFrame:
    """Adds ``ordinal``, the place from 1 in the canonical order of its group.

    The sorted rows are written once; a place is the place in its partition plus the rows of the group in the
    partitions before, so a large group is not one task's work. ``texts`` names columns for the texts by which
    numbers were ordered, by number.
    """
    texts = texts or {}
    placed = materialize(
        canonical_sort(rows, table, (group,), last, texts).withColumns(
            {"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}
        ),
        "ordered",
    )
    # One row for each group and partition.
    runs = placed.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col(group).alias("__group"), F.col("__part").alias("__run"), "__first",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    found = placed.join(runs, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__run")))
    ordinal = F.col("__before") + F.col("__place") - F.col("__first") + 1
    return found.select(*rows.columns, *texts.values(), ordinal.alias("ordinal"))


def unordered_files(rows: DataFrame, table: str) -> DataFrame:
    """Files of a Parquet table, read with its file columns, whose rows are not in canonical order."""
    keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(table))])
    placed = rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), keys.alias("key")
    )
    before = F.lag("key").over(Window.partitionBy("file").orderBy("row"))
    return placed.withColumn("before", before).where(F.col("before") > F.col("key")).select("file").distinct()
