"""Texts of twelve digits: short numbers take a short way, and keys are made once for order and output."""

import random
import struct

from pyspark.sql import functions as F

from oddsloom.functions import formats
from oddsloom.operators import canonical_order


def test_short_way_gives_the_same_text(spark):
    rng = random.Random(5)
    numbers = [0.0, -0.0, 1e7, -1e7, 1e12, 999999999999.0, 1e11 + 0.5, 123456789012.0, 0.001, 0.00099, 100.0, -110.0, 2.5e-3]
    numbers += [99999999999.96, 0.1 + 0.2, 1234567.125, 9999999.99999, 1e15, 2.0**53, 9.5e6, 1.7976931348623157e308]
    numbers += [round(rng.uniform(-1e6, 1e6), rng.randint(0, 6)) for _ in range(400)]
    numbers += [float(rng.randint(-(10**13), 10**13)) for _ in range(100)] + [rng.randint(-(10**6), 10**6) / 8 for _ in range(100)]
    numbers += [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(200)) if x == x and abs(x) > 1e-307]
    rows = spark.createDataFrame([(x,) for x in numbers], "v double").select("v", formats.significant(F.col("v")).alias("t"))
    assert [(r.v, r.t) for r in rows.collect() if r.t != f"{r.v:.12g}"] == []
    few = rows.select("v", formats.significant(F.col("v"), 5).alias("t")).where("abs(v) > 1e-3 and abs(v) < 1e7")
    assert [(r.v, r.t) for r in few.collect() if r.t != f"{r.v:.5g}" and "5" not in repr(r.v)[5:]] == []


def test_other_types_keep_their_text(spark):
    row = spark.sql(
        "select cast(11.50 as decimal(10,4)) as a, cast(100 as decimal(12,0)) as b, 7 as c, cast(12345678 as bigint) as d, "
        "cast(0.5 as float) as e, cast(null as double) as f, double('NaN') as g, double('-Infinity') as h"
    )
    got = row.select(*[formats.significant(F.col(c)).alias(c) for c in row.columns]).first()
    assert tuple(got) == ("11.5", "100", "7", "12345678", "0.5", "", "", "")


def test_texts_of_the_order_are_kept(spark):
    schema = "snapshot_id string, event_id string, player string, market string, point double, side string, book string, price double, last_update string"
    rows = spark.createDataFrame(
        [("s", "e", "p", "m", point, "over", "b", -110.0, "") for point in (2.5, 10.5, None, float("nan"), 1e-7, 0.1 + 0.2)], schema
    )
    found = canonical_order.with_ordinals(rows, "event_props", texts={"point": "point_text", "price": "price_text"})
    assert found.columns == [*rows.columns, "point_text", "price_text", "ordinal"]
    texts = [(r.ordinal, r.point_text, r.price_text) for r in found.orderBy("ordinal").collect()]
    assert texts == [(i + 1, t, "-110") for i, t in enumerate(["", "", "0.3", "10.5", "1e-07", "2.5"])]
    parsed = canonical_order.with_ordinals(rows.withColumn("point", F.col("point").cast("string")), "event_props")
    assert sorted(r.ordinal for r in parsed.where("point in ('2.5', '10.5')").collect()) == [4, 6]
