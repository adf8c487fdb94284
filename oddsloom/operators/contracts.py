"""Quote-table contracts: canonical rows, validation, parity and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom import schemas
from oddsloom.functions import parsing

QUOTE_SCHEMA_VERSION = 1


class ContractError(ValueError):
    """A table misses required columns."""


def require_columns(df: DataFrame, table: str) -> None:
    missing = sorted(set(schemas.TABLES[table]) - set(df.columns))
    if missing:
        raise ContractError(f"{table} misses required columns: {', '.join(missing)}")


def enforce_schema(df: DataFrame, table: str) -> DataFrame:
    """Contract columns in order; missing ones as typed nulls, failing casts as null."""
    out = []
    for name, kind in schemas.TABLES[table].items():
        value = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append(value.alias(name))
    return df.select(*out)


def generic_frame(df: DataFrame) -> DataFrame:
    """Unknown tables: sorted columns, untyped nulls as text."""
    return df.select(
        *[
            F.col(c).cast("string").alias(c) if df.schema[c].dataType.typeName() == "void" else F.col(c)
            for c in sorted(df.columns)
        ]
    )


def canonical(df: DataFrame, table: str) -> DataFrame:
    """Trimmed text, finite numbers and a positive schema version."""
    out = []
    for name, kind in schemas.TABLES[table].items():
        source = F.col(name) if name in df.columns else F.lit(None)
        if name == "schema_version":
            version = source.cast("string").try_cast("bigint")
            value = F.when(version > 0, version).otherwise(F.lit(QUOTE_SCHEMA_VERSION)).cast("bigint")
        elif kind == "double":
            value = parsing.float_or_null(source)
        else:
            value = parsing.text(source)
        out.append(value.alias(name))
    return df.select(*out)


def row_contract(quotes: DataFrame) -> DataFrame:
    """Rows and blank-field rows per snapshot; only blank text breaks the contract."""
    blank = F.lit(False)
    for name in schemas.REQUIRED_QUOTE_FIELDS:
        blank = blank | F.coalesce(parsing.strip(F.col(name)) == "", F.lit(False))
    return quotes.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(blank).alias("invalid_count")
    ).withColumn("status", F.when(F.col("invalid_count") == 0, "ok").otherwise("invalid_rows"))


def table_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows added and removed between two versions of a table, in one shuffle."""
    keys = old.columns
    tagged = old.select(*keys, F.lit(True).alias("was")).unionByName(new.select(*keys, F.lit(False).alias("was")))
    sides = tagged.groupBy(*keys).agg(F.bool_or("was").alias("before"), F.bool_and("was").alias("gone"))
    return sides.where(F.col("before") == F.col("gone")).select(
        *keys, F.when(F.col("gone"), "removed").otherwise("added").alias("change")
    )


def parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Row-count difference of two multisets per distinct row; empty when they are equal.

    Both sides are counted before the shuffle, so heavy repetition costs one row per task.
    """
    tagged = left.withColumn("d", F.lit(1)).unionByName(right.withColumn("d", F.lit(-1)))
    return tagged.groupBy(*keys).agg(F.sum("d").alias("surplus")).where("surplus <> 0")
