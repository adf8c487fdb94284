"""Folders as tables: files, datasets and their days, and the box score each game's manifest points to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions import clocks
from oddsloom.sources.files import exists

_FILES = "path string, modificationTime timestamp, length long"


def list_files(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    """path (below the root, no slash first), modified and bytes of the files below a folder; contents stay unread.

    Empty files are left out, as Spark's scans do."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, modified timestamp, bytes long")
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    )
    # Paths come back in an authority form that may have more slashes than the folder's.
    inner = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + _quoted(base), "")
    return found.select(inner.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def _quoted(base: str) -> str:
    plain = base.removeprefix("file:")
    return "\\Q" + ("/" + plain.lstrip("/") if base.startswith("file:") else base) + "\\E"


def datasets(files: DataFrame) -> DataFrame:
    """dataset_id of each folder below ``datasets`` that has a spec or any day file; from ``list_files`` of the root."""
    inside = files.where(F.col("path").rlike("^datasets/[^/]+/(spec\\.json$|days/)"))
    return inside.select(F.split("path", "/")[1].alias("dataset_id")).distinct()


def dataset_days(files: DataFrame) -> DataFrame:
    """dataset_id, day and path of the day files of all datasets; names that are no ISO days are left out."""
    days = files.where(F.col("path").rlike("^datasets/[^/]+/days/[^/]+\\.json$"))
    name = F.trim(F.regexp_extract("path", "([^/]+)\\.json$", 1))
    named = days.select(F.split("path", "/")[1].alias("dataset_id"), name.alias("day"), "path", "bytes")
    return named.where(clocks.try_day(F.col("day")).isNotNull())


def boxscore_index(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """game_id and path of the box score that the last manifest line names, among those whose file is there.

    Manifests lie at ``manifests/season=.../season_type=.../manifest.jsonl`` and count in the order of their paths, lines
    in theirs. Lines that are no objects, or lack an id or a path, are skipped. An empty file holds no box score, so an earlier one stays.
    """
    pattern = f"{root}/manifests/season=*/season_type=*/manifest.jsonl"
    if not exists(spark, pattern):
        return spark.createDataFrame([], "game_id string, path string")
    texts = spark.read.option("wholetext", True).text(pattern).select(
        F.col("_metadata.file_path").alias("manifest"), F.posexplode(F.split("value", "\n")).alias("line", "body")
    )
    row = F.from_json("body", "struct<game_id: string, resources: struct<boxscore: struct<path: string>>>")
    named = texts.select(
        "manifest", "line", F.trim(row["game_id"]).alias("game_id"), F.trim(row["resources"]["boxscore"]["path"]).alias("path")
    ).where("game_id <> '' and path <> ''")
    there = named.join(files.select("path").distinct(), "path", "left_semi")
    return there.groupBy("game_id").agg(F.max_by("path", F.struct("manifest", "line")).alias("path"))
