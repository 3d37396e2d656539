"""Joins with hot keys and mixed intervals, and sketches, against exact results."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from askspark.operators import sketches as K
from askspark.operators.skew import heavy_keys, interval_join, skew_join


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_key_with_half_of_the_rows(spark, how):
    left = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 WHEN id % 97 = 0 THEN NULL ELSE id % 50 END AS k", "id AS v")
    right = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (None, "d"), (99, "e")], "k long, w string")
    assert rows(skew_join(left, right, ["k"], how, parts=16)) == rows(left.join(right, ["k"], how))
    hot = heavy_keys(left, ["k"], 16)
    assert [p for _, p in hot] == [16]  # that key alone, over all tasks
    plain = spark.range(100).selectExpr("id AS k", "id AS v")
    assert heavy_keys(plain, ["k"], 8) == [] and heavy_keys(plain.limit(0), ["k"]) == []
    assert rows(skew_join(plain, right, ["k"], how)) == rows(plain.join(right, ["k"], how))


def test_only_hot_keys_are_repeated(spark):
    left = spark.range(2000).selectExpr("IF(id < 1000, 1, id) AS k", "id AS v")
    right = spark.range(3000).selectExpr("id AS k", "id AS w")
    joined = skew_join(left, right, ["k"], parts=10)
    assert joined.count() == 2000
    sizes = [r["count"] for r in left.withColumn("p", F.pmod(F.xxhash64("v"), F.lit(10))).where("k = 1").groupBy("p").count().collect()]
    assert max(sizes) < 200  # the rows of the hot key lie in ten parts


def test_intervals_from_a_minute_to_ten_years(spark):
    rng = random.Random(5)
    day = dt.datetime(2020, 1, 1)
    points = [(i, day + dt.timedelta(seconds=rng.randrange(10**8))) for i in range(800)] + [(900, None)]
    points += [(1000 + i, day + dt.timedelta(days=3)) for i in range(300)]  # one hot moment
    lengths = [60, 3600, 86400, 86400 * 30, 86400 * 3650, 0, -5, 1, 7]
    spans = []
    for i in range(120):
        low = day + dt.timedelta(seconds=rng.randrange(-(10**7), 10**8))
        spans.append((i, low, low + dt.timedelta(seconds=lengths[i % len(lengths)])))
    spans += [(500, None, day), (501, day, None), (502, day + dt.timedelta(days=3), day + dt.timedelta(days=3, seconds=1))]
    left = spark.createDataFrame(points, "p long, at timestamp_ntz")
    right = spark.createDataFrame(spans, "s long, low timestamp_ntz, high timestamp_ntz")
    want = sorted((p, s) for p, at in points for s, low, high in spans if None not in (at, low, high) and low <= at < high)
    got = interval_join(left, right, "at", "low", "high", parts=16)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want and got.columns == ["p", "at", "s", "low", "high"]


@pytest.mark.parametrize("kind", ["long", "double", "date"])
def test_intervals_of_numbers_and_dates(spark, kind):
    rng = random.Random(6)
    make = {"long": lambda: rng.randrange(-500, 500), "double": lambda: rng.uniform(-50, 50), "date": lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(300))}[kind]
    points = [(i, make()) for i in range(300)]
    spans = [(i, make(), make()) for i in range(60)]
    left, right = spark.createDataFrame(points, f"p long, at {kind}"), spark.createDataFrame(spans, f"s long, low {kind}, high {kind}")
    want = sorted((p, s) for p, at in points for s, low, high in spans if low <= at < high)
    assert sorted((r["p"], r["s"]) for r in interval_join(left, right, "at", "low", "high").collect()) == want
    assert interval_join(left, right.limit(0), "at", "low", "high").count() == 0


def test_an_interval_makes_few_rows_whatever_its_length(spark):
    spans = spark.range(40).selectExpr("0L AS low", "CAST(pow(2, id) AS BIGINT) + 1 AS high")
    plan = interval_join(spark.range(1).selectExpr("id AS at"), spans, "at", "low", "high")
    assert plan.count() == 40
    made = spans.selectExpr("high - low AS n").selectExpr("size(sequence(0L, shiftright(n, 2 * greatest(ceil(log2(n) / 2) - 1, 0)))) AS cells").agg(F.max("cells")).first()[0]
    assert made <= 5


def test_merged_days_are_the_month_and_near_the_exact_values(spark):
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    days = K.sketch_periods(events, "ts", "day", ["event_type"], ["user_id"], ["value"])
    month = K.read_sketches(K.merge_sketches(days, ["event_type"])).orderBy("event_type").collect()
    whole = K.read_sketches(K.merge_sketches(K.sketch_periods(events, "ts", "week", ["event_type"], ["user_id"], ["value"]), ["event_type"])).orderBy("event_type").collect()
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("d"), F.count("*").alias("n")).orderBy("event_type").collect()
    for m, w, e in zip(month, whole, exact):
        assert m["n_rows"] == e["n"] and m["user_id_distinct"] == w["user_id_distinct"]  # merging loses nothing
        assert abs(m["user_id_distinct"] - e["d"]) <= 4 * 1.04 / math.sqrt(2**K.LG) * e["d"]
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            below = events.where((F.col("event_type") == m["event_type"]) & (F.col("value") <= m[f"value_{name}"])).count()
            assert abs(below / e["n"] - p) <= 0.02
    empty = K.read_sketches(K.merge_sketches(K.sketch_periods(events.limit(0), "ts", "day", [], ["user_id"], ["value"]), []))
    assert empty.first()["n_rows"] is None
