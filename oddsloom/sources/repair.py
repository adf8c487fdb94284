"""Repair of a stored table that is in use: only damaged partitions are rewritten, and only after a check.

The canonical rows of damaged partitions are staged beside the table, read back and compared with the canonical form
of what is there. Where they agree, the folders change places; the old ones are kept until all have. A step that
fails leaves the table as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import canonical_order, contracts
from oddsloom.session import discard


class RepairError(RuntimeError):
    """The staged rows are not those of the table, or folders could not be swapped."""


def canonical_rows(rows: DataFrame, table: str) -> DataFrame:
    """Contract columns in canonical form."""
    return contracts.canonical(rows, table)


def damaged_partitions(rows: DataFrame, canonical: DataFrame, table: str, partition: str) -> list[str]:
    """Partitions whose rows are not the canonical ones, or lie in a file out of order."""
    columns = canonical.columns
    current = rows.select(*[F.col(c).cast(canonical.schema[c].dataType) for c in columns])
    other = contracts.parity(canonical, current, columns).select(F.col(partition).cast("string").alias("p"))
    files = canonical_order.unordered_files(rows, table)
    loose = rows.select(F.col("_metadata.file_path").alias("file"), F.col(partition).cast("string").alias("p")).distinct()
    found = other.union(loose.join(files, "file").select("p")).where("p is not null").distinct()
    return sorted(r["p"] for r in found.collect())


def staged_differences(wanted: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows that the staged copy has too many or too few of."""
    return contracts.parity(wanted, staged.select(*wanted.columns), wanted.columns)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)):
        raise RepairError(f"{source} could not be moved to {target}")


def repair_table(
    spark: SparkSession,
    path: str,
    table: str,
    partition: str = "snapshot_id",
    canonicalize: Callable[[DataFrame, str], DataFrame] = canonical_rows,
) -> list[str]:
    """Rewrites the damaged partitions of the Parquet table at ``path``; returns their values.

    Readers see a partition's old rows or its new ones, but for the moment between two renames.
    """
    rows = spark.read.parquet(path)
    canonical = canonicalize(rows, table)
    damaged = damaged_partitions(rows, canonical, table, partition)
    if not damaged:
        return []
    run = uuid.uuid4().hex
    staging, kept = f"{path}/_staged-{run}", f"{path}/_replaced-{run}"
    wanted = canonical.where(F.col(partition).isin(*damaged))
    try:
        ordered = canonical_order.canonical_sort(wanted, table, (partition,), tuple(wanted.columns))
        ordered.write.partitionBy(partition).parquet(staging)
        staged = spark.read.schema(canonical.schema).parquet(staging)
        if not staged_differences(wanted, staged).isEmpty():
            raise RepairError(f"{path}: the staged rows differ from the table's")
    except Exception:
        discard(spark, staging)
        raise
    moved: list[str] = []
    try:
        for value in damaged:
            name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(
                partition, value
            )
            _rename(spark, f"{path}/{name}", f"{kept}/{name}")
            moved.append(name)
            _rename(spark, f"{staging}/{name}", f"{path}/{name}")
    except Exception:
        # The last one may lie at neither place; the others go back.
        for name in moved:
            discard(spark, f"{path}/{name}")
            _rename(spark, f"{kept}/{name}", f"{path}/{name}")
        discard(spark, staging)
        raise
    discard(spark, staging)
    discard(spark, kept)
    return damaged
