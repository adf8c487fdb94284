"""The query catalogue: named jobs over the given tables, with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsloom.functions import odds
from oddsloom.operators import candidates, portfolio
from oddsloom.plans import bindings as b
from oddsloom.plans import oracles, strategy
from oddsloom.session import apply_engine_conf, materialize


@dataclass(frozen=True)
class Query:
    """A job, its output columns and the SQL it is checked with (None: rows only)."""

    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}
_STAGES: dict[tuple[str, str, str], DataFrame] = {}
_WRITTEN: dict[tuple[str, str], dict] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A job stage written once per application and shared by the queries that read it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = materialize(build(), name)
    return _STAGES[key]


def shaped(df: DataFrame, columns: str) -> DataFrame:
    """Output columns in order; doubles rounded to six places, times as text."""
    out = []
    for name in columns.split():
        kind = df.schema[name].dataType
        col = F.col(name)
        if isinstance(kind, T.DoubleType):
            col = odds.round6(col)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), ",")
        out.append(col.alias(name))
    return df.select(*out)


def r6(names: str) -> str:
    """SQL list rounding the named doubles; ``new=old`` renames."""
    parts = []
    for item in names.split():
        new, _, old = item.partition("=")
        parts.append(f"round({old or new}, 6) as {new}")
    return ", ".join(parts)


def ts(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') as {name or column}"


def register(name: str, columns: str, sql: str | None):
    """Adds a query; its builder returns a frame holding at least ``columns``."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_engine_conf(spark)
            return shaped(build(spark, sf_dir), columns)

        CATALOG[name] = Query(run, None if sql is None else oracles.query(sql))
        return build

    return wrap


def inputs(spark: SparkSession, sf_dir: str) -> strategy.StrategyInputs:
    return strategy.StrategyInputs(
        quotes=b.quotes(spark, sf_dir),
        event_context=b.event_context(spark, sf_dir),
        slate=b.slate(spark, sf_dir),
        roster=b.roster(spark, sf_dir),
        injuries=b.injuries(spark, sf_dir),
        minutes=b.minutes_predictions(spark, sf_dir),
        tickets=b.tickets(spark, sf_dir),
    )


def lines_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        spark, sf_dir, "lines", lambda: strategy.contextual_lines(inputs(spark, sf_dir))
    )


def _strategy_rows(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Candidates read off the written pricing groups; the first call writes them."""
    written = _WRITTEN.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    return strategy.strategy_candidates(
        inputs(spark, sf_dir), lines=lines_stage(spark, sf_dir), only=only, written=written
    ).drop("recipe")


def raw_candidates_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates before the report's health gates.

    Read off the written pricing groups, not written themselves: twenty recipes times all columns are many times
    the pricing groups, and a query makes only the columns that it uses.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "raw-candidates")
    if key not in _STAGES:
        _STAGES[key] = _strategy_rows(spark, sf_dir)
    return _STAGES[key]


def _reported(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows of candidates with health gates applied and texts added; the gates come from all candidates."""
    raw = raw_candidates_stage(spark, sf_dir)
    gates = stage(spark, sf_dir, "health-gates", lambda: strategy.report_gates(raw, inputs(spark, sf_dir)))
    return strategy.described(candidates.apply_health_gates(rows, gates))


def candidates_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as the report has them: health gates applied, texts added.

    Only the gates are written, a row for each report. Joined to the raw candidates as they are read, a query
    makes no more than the columns it uses: texts of every row would take as long as the recipes themselves.
    """
    return _reported(spark, sf_dir, raw_candidates_stage(spark, sf_dir))


def picks_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "picks", lambda: portfolio.picks(candidates_stage(spark, sf_dir)))


def portfolio_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eligible candidates with the portfolio's verdict.

    Only the picks are written, a row for each report, for the verdict on every row follows from them.
    """
    return portfolio.with_picks(candidates_stage(spark, sf_dir), picks_stage(spark, sf_dir))


def selected_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected rows of the portfolio with all columns: a few for each report, and no others are made for them."""

    def build() -> DataFrame:
        picks = picks_stage(spark, sf_dir)
        named = picks.select("snapshot_id", "strategy_id", F.explode("picks.rank_key").alias("pick"))
        only = named.select("snapshot_id", "strategy_id", *[f"pick.{c}" for c in strategy.ONLY])
        rows = _reported(spark, sf_dir, _strategy_rows(spark, sf_dir, only))
        return portfolio.with_picks(rows, picks).where("portfolio_selected")

    return stage(spark, sf_dir, "selected", build)
