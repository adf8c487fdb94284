"""Staged calibration feedback against the one expression."""

from pyspark.sql import functions as F

from oddsloom.operators import calibration


def test_staged_feedback_is_the_same(spark):
    entry = "struct<count: bigint, delta: double, bucket_low: double, bucket_high: double>"
    # Some bins of a market side hold too few rows; the strategy's own bins are all full.
    full = {i: (1 if i % 2 else 800, 0.05, i / 20, i / 20 + 0.05) for i in range(52)}
    small = {i: (5000, -0.2, i / 20, i / 20 + 0.05) for i in range(52)}
    rows = [
        (p, bins, wide, delta, n)
        for p in (None, -0.1, 0.0, 0.52, 0.57, 0.68, 0.95, 1.0, 1.1, float("nan"))
        for bins in (None, full)
        for wide in (None, small)
        for delta, n in ((None, None), (0.04, 120))
    ]
    frame = spark.createDataFrame(
        rows, f"p double, side_bins map<int, {entry}>, global_bins map<int, {entry}>, prior_delta double, prior_sample_size bigint"
    )
    both = calibration.with_feedback(frame.withColumn("one", calibration.feedback(F.col("p"))), {"two": "p"})
    assert both.columns == [*frame.columns, "one", "two"]
    found = both.collect()
    assert all(r.one == r.two for r in found)
    assert {r.two.source for r in found} == {"unavailable", "none", "adjustment", "market_side", "global"}
