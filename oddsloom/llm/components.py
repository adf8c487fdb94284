"""Connected components of a table of links, by repeated star steps.

Every round turns the neighbours of a node towards the smallest one. The number of links never grows, and
long chains fall to stars in a number of rounds that grows with the logarithm of their length. Each round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.session import discard, materialize, stage_path


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with b < a. Each node's chosen neighbours get linked with its smallest one.

    Large: its larger neighbours, over links in both directions; small: its smaller neighbours.
    """
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    # Written first: the join then has two plain sides, and Spark can split the links of a hot node.
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = both.join(least, "a")
    if large:
        turned = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        turned = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return turned.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (its component's smallest node), for the nodes of ``links`` (a, b: long)."""
    spark = links.sparkSession
    state = links.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    path = stage_path(spark, "links")
    state.write.parquet(path)
    state = spark.read.schema(state.schema).parquet(path)
    seen = None
    while True:
        turned = _star(_star(state, large=True), large=False)
        new = stage_path(spark, "links")
        turned.write.parquet(new)
        discard(spark, path)
        state, path = spark.read.schema(state.schema).parquet(new), new
        # The sum tells whether the links changed: both steps only ever lower their ends.
        now = state.agg(
            F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
