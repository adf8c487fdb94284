"""The denormalised export of complete days: facts, requests, day status, with counters and warnings.

A plan says for each selected day whether it goes out and, if not, why. Facts and requests are then filtered by it.
What was written and what was left out is counted by the pass that writes (``observe``), not by a second one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from oddsloom.functions import parsing
from oddsloom.operators import contracts
from oddsloom.sources import files

TABLES = ("fact_outcomes", "dim_request", "dim_day_status")


def export_plan(days: DataFrame, status: DataFrame, snapshots: DataFrame, quotes: DataFrame, requests: DataFrame) -> DataFrame:
    """day, snapshot_id, skip (null: the day goes out) and warnings (codes) of the selected days.

    ``status`` has day, complete and snapshot_id, ``snapshots`` the ids there are, ``quotes`` and ``requests`` rows by
    snapshot. Incomplete days are left out without a warning; a day without requests goes out with one.
    """

    def known(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("snapshot_id").distinct().withColumn(name, F.lit(True))

    stored = status.select(
        F.col("day").cast("string").alias("day"), "complete", parsing.text(F.col("snapshot_id")).alias("snapshot_id"),
        F.lit(True).alias("stored"),
    )
    joined = days.select(F.col("day").cast("string").alias("day")).distinct().join(stored, "day", "left")
    for frame, name in ((snapshots, "there"), (quotes, "quoted"), (requests, "requested")):
        joined = joined.join(known(frame, name), "snapshot_id", "left")
    skip = (
        F.when(F.col("stored").isNull(), "missing_day_status")
        .when(~F.coalesce("complete", F.lit(False)), "incomplete_day")
        .when(F.col("snapshot_id") == "", "missing_snapshot_id")
        .when(F.col("there").isNull(), "missing_snapshot")
        .when(F.col("quoted").isNull(), "missing_event_props")
    )
    warns = F.when(skip.isNotNull(), F.nullif(skip, F.lit("incomplete_day"))).when(
        F.col("requested").isNull(), "missing_manifest"
    )
    return joined.select("day", "snapshot_id", skip.alias("skip"), F.array_compact(F.array(warns)).alias("warnings"))


def facts(quotes: DataFrame, plan: DataFrame, requests: DataFrame, dataset_id: str) -> DataFrame:
    """Quotes of the snapshots of the plan with day, skip and the first request key of their event.

    A request belongs to an event by its label, ``event_odds:`` and the event id.
    """
    label = parsing.text(F.col("label"))
    first_key = (
        requests.where(label.startswith("event_odds:"))
        .select("snapshot_id", F.trim(F.substring(label, len("event_odds:") + 1, 1 << 30)).alias("event_id"), "request_key")
        .where("event_id <> ''")
        .groupBy("snapshot_id", "event_id")
        .agg(F.min("request_key").alias("request_key"))
    )
    dated = quotes.join(plan.select("day", "snapshot_id", "skip"), "snapshot_id")
    keyed = dated.withColumn("event_id", parsing.text(F.col("event_id"))).join(first_key, ["snapshot_id", "event_id"], "left")
    texts = ("market", "player", "side", "book", "last_update", "link")
    return keyed.withColumns(
        {
            "dataset_id": F.lit(dataset_id),
            **{c: parsing.text(F.col(c)) for c in texts},
            **{c: parsing.float_or_null(F.col(c)) for c in ("point", "price")},
        }
    )


# Request parameters by the name they are sent under.
PARAMETERS = {
    "param_bookmakers": "bookmakers", "param_regions": "regions", "param_markets": "markets", "param_date": "date",
    "param_odds_format": "oddsFormat", "param_date_format": "dateFormat",
}


def request_rows(requests: DataFrame, plan: DataFrame) -> DataFrame:
    """Requests of the days that go out; ``requests`` has label, path, status, updated_at_utc and the map ``params``."""
    dated = requests.join(plan.where("skip is null").select("day", "snapshot_id"), "snapshot_id")
    params: dict[str, Column] = {n: parsing.text(F.try_element_at("params", F.lit(p))) for n, p in PARAMETERS.items()}
    return dated.withColumns(
        {
            "request_label": parsing.text(F.col("label")),
            "request_path": parsing.text(F.col("path")),
            "request_status": parsing.text(F.col("status")),
            "updated_at_utc": parsing.text(F.col("updated_at_utc")),
            **params,
        }
    )


def day_rows(status: DataFrame, plan: DataFrame, dataset_id: str) -> DataFrame:
    """Status of the days that go out: the first reason code, else the status code, else ``complete``.

    ``status`` is the canonical day status; events_timestamp and updated_at_utc are taken where it has them.
    """
    out = plan.where("skip is null").select("day", "snapshot_id")
    known = status.drop("snapshot_id").withColumn("day", F.col("day").cast("string"))
    filled = F.filter("reason_codes", lambda c: parsing.text(c) != "")
    reason = F.coalesce(F.get(filled, 0), F.nullif(parsing.text(F.col("status_code")), F.lit("")), F.lit("complete"))
    stamps = {
        c: parsing.text(F.col(c)) if c in known.columns else F.lit("") for c in ("events_timestamp", "updated_at_utc")
    }
    return out.join(known, "day").withColumns(
        {
            "dataset_id": F.lit(dataset_id),
            "day_complete": F.col("complete"),
            "day_odds_coverage_ratio": F.col("odds_coverage_ratio"),
            "day_missing_count": F.col("missing_count"),
            "day_total_events": F.col("total_events"),
            "day_reason_code": reason,
            **stamps,
        }
    )


@dataclass(frozen=True)
class ExportReport:
    """Counters by name, and a row of day and code for each warning."""

    counts: dict[str, int]
    warnings: list[tuple[str, str]]


def export_days(
    root: str,
    dataset_id: str,
    days: DataFrame,
    status: DataFrame,
    snapshots: DataFrame,
    quotes: DataFrame,
    requests: DataFrame,
    overwrite: bool = False,
) -> ExportReport:
    """Writes the three tables by day under ``root``.

    Days that stand in any of the tables already are an error unless they may be replaced, and then nothing is
    written. Warnings and skip counters come from the plan, which has a row a day.
    """
    spark = quotes.sparkSession
    plan = export_plan(days, status, snapshots, quotes, requests)
    rows = plan.orderBy("day").collect()
    going = {r["day"] for r in rows if r["skip"] is None}
    if not overwrite:
        for table in TABLES:
            clash = sorted(going.intersection(files.partition_values(spark, f"{root}/{table}", "day")))
            if clash:
                raise FileExistsError(f"{root}/{table} already exists for {', '.join(clash[:5])}")
    plan = spark.createDataFrame([(r["day"], r["snapshot_id"], r["skip"]) for r in rows], "day string, snapshot_id string, skip string")
    all_facts = facts(quotes, plan, requests, dataset_id)
    out = {
        "fact_outcomes": all_facts,
        "dim_request": request_rows(requests, plan).withColumn("skip", F.lit(None).cast("string")),
        "dim_day_status": day_rows(status, plan, dataset_id).withColumn("skip", F.lit(None).cast("string")),
    }
    counts = {"days": len(rows), "exported_days": len(going)}
    reasons = ("missing_day_status", "incomplete_day", "missing_snapshot_id", "missing_snapshot", "missing_event_props")
    counts |= {f"skipped_{reason}": sum(r["skip"] == reason for r in rows) for reason in reasons}
    for table, frame in out.items():
        seen = Observation(table)
        counted = frame.observe(
            seen,
            F.count_if(F.col("skip").isNull()).alias("written"),
            F.count_if(F.col("skip").isNotNull()).alias("skipped"),
        )
        files.write_days(contracts.enforce_schema(counted.where("skip is null"), table), f"{root}/{table}", True)
        counts[f"{table}_rows"] = seen.get["written"]
        if table == "fact_outcomes":
            counts["skipped_fact_rows"] = seen.get["skipped"]
    return ExportReport(counts, [(r["day"], w) for r in rows for w in r["warnings"]])
