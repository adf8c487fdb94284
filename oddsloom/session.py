"""Session settings the engine relies on, and lineage cuts that survive executor loss."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings with a meaning for results or for plan quality; sizes stay with the cluster.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM leaves methods above 8000 bytes uncompiled; wide projections then run better
    # as split per-operator code than as one huge fused method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Lines and candidates have more fields than the default of 100: each of their many projections would copy whole rows.
    "spark.sql.codegen.maxFields": "1000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    # Shuffle files go when their query has ended. Else those of all stages written so far add up until the driver
    # happens to collect garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def apply_engine_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime (non-static) settings on an existing session."""
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "oddsloom", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**ENGINE_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``.

    Unset, a temporary folder serves a session that runs in this one process (``local[...]``); on a
    cluster, where executors would each write to a disk of their own, that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="oddsloom-stages-")
    return _LOCAL_FOLDERS[app]


_LOCAL_FOLDERS: dict[str, str] = {}


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/oddsloom/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stage that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries that run inside."""
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write a stage once as Parquet in the shared folder and continue from the files.

    Used where one expensive stage feeds several branches: it is computed once, later plans
    stay small and prune columns from the files, and a lost executor costs no recomputation.
    A ``path`` of :func:`stage_path` is named by those who :func:`discard` it later.
    """
    spark = df.sparkSession
    path = path or stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
