"""File scans and sinks: explicit schemas in, partitioned and compressed tables out."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsloom import schemas
from oddsloom.functions import clocks, parsing


def schema_of(table: str) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in schemas.TABLES[table].items())


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with a given schema; bad lines are dropped, or fail when strict."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_ticket_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Ticket results as text columns, with the file each row came from."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    frame = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return frame.withColumn("source_file", F.input_file_name())


def preferred_results(rows: DataFrame) -> DataFrame:
    """Rows of the best results file per snapshot and strategy.

    A strategy's settlement file wins, then the canonical one, then the templates. Files are
    ranked on their distinct names; rows follow by an equality join.
    """
    name = F.element_at(F.split("source_file", "/"), -1)
    rank = (
        F.when(name == F.concat(F.lit("settlement."), F.col("strategy_id"), F.lit(".csv")), 0)
        .when(name == "settlement.csv", 1)
        .when(name == F.concat(F.lit("backtest-results-template."), F.col("strategy_id"), F.lit(".csv")), 2)
        .otherwise(3)
    )
    files = rows.select("snapshot_id", "strategy_id", "source_file", rank.alias("rank")).distinct()
    best = files.groupBy("snapshot_id", "strategy_id").agg(
        F.min_by("source_file", F.struct("rank", "source_file")).alias("source_file")
    )
    return rows.join(best, ["snapshot_id", "strategy_id", "source_file"], "left_semi")


def read_clean(spark: SparkSession, root: str, table: str, seasons: list[str], season_type: str) -> DataFrame:
    """A clean table limited to seasons and a season type, both partition columns."""
    frame = spark.read.schema(schema_of(table)).parquet(f"{root}/{table}")
    wanted = parsing.season_slug(F.lit(season_type))
    return frame.where(
        F.col("season").isin(*seasons) & (parsing.season_slug(F.col("season_type")) == wanted)
    )


def write_clean(df: DataFrame, root: str, table: str, overwrite: bool) -> bool:
    """Writes a clean table by season and type; keeps an existing one unless told to replace it."""
    mode = "overwrite" if overwrite else "ignore"
    df.write.mode(mode).partitionBy("season", "season_type").parquet(f"{root}/{table}")
    return overwrite


def _matches(spark: SparkSession, pattern: str) -> list:
    """Status of the files and folders that match a path pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return list(found or [])


def exists(spark: SparkSession, pattern: str) -> bool:
    return bool(_matches(spark, pattern))


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column, from the folders of a table and not from its rows."""
    names = (status.getPath().getName() for status in _matches(spark, f"{path}/{column}=*"))
    return sorted(unquote(name.split("=", 1)[1]) for name in names)


def write_days(df: DataFrame, path: str, overwrite: bool, files_per_day: int = 8) -> None:
    """Writes day partitions; days that exist already are an error unless they may be replaced.

    A day is dealt to ``files_per_day`` tasks by a hash of its rows, so a large one is not one task's work.
    """
    spark = df.sparkSession
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_day))
    writer = df.repartition("day", part).write.partitionBy("day").option("compression", "zstd")
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        return
    there = partition_values(spark, path, "day")
    if there:
        days = df.select(F.col("day").cast("string").alias("day")).where(F.col("day").isin(*there)).distinct()
        clash = [row["day"] for row in days.orderBy("day").limit(5).collect()]
        if clash:
            raise FileExistsError(f"{path} already exists for {', '.join(clash)}")
    writer.mode("append").parquet(path)


def write_mirror(df: DataFrame, path: str, sort: list[str]) -> None:
    """Canonical table mirror, sorted inside files."""
    df.sortWithinPartitions(*sort).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_seed_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_template_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("snapshot_date").parquet(path)


def export_seasons(spark: SparkSession, source: str, target: str, table: str, seasons: list[str]) -> None:
    """Copies the partitions of chosen seasons."""
    frame = spark.read.schema(schema_of(table)).parquet(f"{source}/{table}")
    write_clean(frame.where(F.col("season").isin(*seasons)), target, table, True)


def schedule_games(schedules: DataFrame, day: str) -> DataFrame:
    """Distinct game ids of one day over all season schedules."""
    return schedules.where(F.col("date") == day).select("game_id").distinct().orderBy("game_id")


def valid_days(names_frame: DataFrame) -> DataFrame:
    """Names that are ISO days."""
    return names_frame.where(clocks.try_day(F.col("name")).isNotNull()).distinct()


def latest_manifest(rows: DataFrame) -> DataFrame:
    """Last manifest row per game, with unknown resource statuses read as missing.

    ``rows`` holds season, season_type, game_id, row_order and the map ``resources``.
    """
    clean = F.transform_values(
        "resources", lambda _, v: F.when(v.isin("missing", "ok", "error"), v).otherwise("missing")
    )
    keys = ["season", "season_type", "game_id"]
    last = rows.groupBy(*keys).agg(F.max_by("resources", "row_order").alias("resources"))
    return last.withColumn("resources", clean)


def pending_games(manifest: DataFrame, only_missing: bool = True, include_errors: bool = False) -> DataFrame:
    """Games with a resource that still needs work."""

    def needs(_, status):
        todo = status == "missing"
        if include_errors:
            todo = todo | (status == "error")
        if not only_missing:
            todo = todo | (status != "ok")
        return todo

    return manifest.where(F.size(F.map_filter("resources", needs)) > 0)


def complete_games(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.size(F.map_filter("resources", lambda _, s: s != "ok")) == 0)


def reconcile(resources: DataFrame, files: DataFrame) -> DataFrame:
    """``ok`` resources whose file is absent or empty become missing."""
    present = files.where(F.col("bytes") > 0).select("path", F.lit(True).alias("present"))
    joined = resources.join(present, "path", "left")
    lost = (F.col("status") == "ok") & F.col("present").isNull()
    return joined.withColumn("status", F.when(lost, "missing").otherwise(F.col("status"))).drop("present")


def upsert_games(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Newly found games added with all resources missing."""
    keys = ["season", "season_type", "game_id"]
    fresh = found.select(*keys).distinct().join(manifest.select(*keys), keys, "left_anti")
    blank = F.create_map(*[F.lit(x) for r in ("boxscore", "enhanced_pbp", "possessions") for x in (r, "missing")])
    return manifest.select(*keys, "resources").unionByName(fresh.withColumn("resources", blank))


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
