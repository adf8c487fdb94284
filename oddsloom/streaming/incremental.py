"""Day-resume of raw payload folders: new files only, through a file stream that then stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.operators import contracts
from oddsloom.sources import payloads

PAYLOAD_SCHEMA = "provider string, snapshot_id string, request_key string, body string"


def load_new_payloads(
    spark: SparkSession, source: str, target: str, checkpoint: str, expected: DataFrame | None = None
) -> None:
    """Appends quote rows of files not seen before to the ``event_props`` table.

    The checkpoint remembers the files; ``availableNow`` handles what is there and ends. Each
    batch is written under its own number, so a batch replayed after a failure replaces itself.
    With ``expected`` (snapshot_id, request_key) only payloads of requests that the days ask for are taken; it is
    joined batch by batch, so keys that come later count for files that come later.
    """
    keys = ["snapshot_id", "request_key"]

    def write(batch: DataFrame, number: int) -> None:
        wanted = batch if expected is None else batch.join(expected.select(*keys), keys, "left_semi")
        rows = contracts.canonical(payloads.event_odds(wanted), "event_props")
        (
            rows.withColumn("batch", F.lit(number))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("batch")
            .parquet(target)
        )

    stream = spark.readStream.schema(PAYLOAD_SCHEMA).json(source)
    (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
