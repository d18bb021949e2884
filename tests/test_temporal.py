"""Joins over time against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import temporal


def in_force(row, right, forward, strict, within):
    k, t = row[1], row[2]
    best = None
    for key, at, v in right:
        if None in (k, t, key, at) or key != k or (strict and at == t) or (at < t if forward else at > t):
            continue
        if within is None or abs(at - t) <= within:
            rank = (-at if forward else at, v)
            best = rank if best is None or rank > best else best
    return best and best[1]


@pytest.mark.parametrize("forward,strict,within,width", [(False, False, None, 10), (True, False, None, 7), (False, True, 15, 10), (True, True, 4, 1000), (False, False, 3, 1)])
def test_asof_equals_loop(spark, forward, strict, within, width):
    """A hot key, ties in time, repeated rows, null keys and times, negative times."""
    rng = random.Random(width)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    time = lambda: rng.choice([None, *range(-60, 60)])
    left = [(n // 2, key(), time()) for n in range(300)] + [(900, "hot", 5)] * 2
    right = [(key(), time(), rng.randrange(50)) for _ in range(80)]
    a = spark.createDataFrame(left, "n int, k string, t long").repartition(5)
    b = spark.createDataFrame(right, "k string, at long, v int").repartition(3)
    got = temporal.asof_join(a, b, ["k"], "t", "at", ["v"], forward=forward, strict=strict, within=within, width=width)
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, got.collect())) == order((*r, in_force(r, right, forward, strict, within)) for r in left)


def test_asof_without_key_and_of_nothing(spark):
    a = spark.createDataFrame([(1, 5), (2, 9)], "n int, t long")
    b = spark.createDataFrame([(4, "x"), (9, "y")], "at long, v string")
    assert sorted(map(tuple, temporal.asof_join(a, b, [], "t", "at", ["v"], width=3).collect())) == [(1, 5, "x"), (2, 9, "y")]
    assert sorted(map(tuple, temporal.asof_join(a, b.limit(0), [], "t", "at", ["v"]).collect())) == [(1, 5, None), (2, 9, None)]
    assert temporal.asof_join(a.limit(0), b, [], "t", "at", ["v"]).collect() == []
    with pytest.raises(ValueError):
        temporal.asof_join(a, b.withColumn("n", F.lit(1)), [], "t", "at", ["n"])


def test_stretches_deal_out_a_hot_key(spark):
    """No task of the deciding window holds more than its stretches; only ends of stretches are ordered by key alone."""
    a = spark.range(20000).selectExpr("id AS n", "'hot' AS k", "id * 10 AS t")
    b = spark.range(2000).selectExpr("'hot' AS k", "id * 100 AS at", "id AS v")
    got = temporal.asof_join(a, b, ["k"], "t", "at", ["v"], width=1000)
    assert got.filter("v <> t div 100 OR v IS NULL").isEmpty() and got.count() == 20000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "long"])
def test_ticks(spark, kind):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = ["1960-05-01 01:02:03.000004", "2024-03-10 01:59:59.999999", "2024-03-10 03:00:00", "2024-11-03 01:30:00.5"]
        df = spark.createDataFrame([(x,) for x in texts], "x string").select(F.col("x").cast("timestamp_ntz").alias("x"))
        df = df.select(F.unix_date(F.to_date("x")).cast("long").alias("t") if kind == "long" else F.col("x").cast(kind).alias("t"))
        got = [r[0] for r in df.select(temporal.ticks(df, "t")).collect()]
        assert got == sorted(got) and (kind == "date" or len(set(got)) >= 3)
        if kind == "timestamp":
            assert got[2] - got[1] == 1
        if kind == "timestamp_ntz":
            assert got[2] - got[1] == 3600 * 10**6 + 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_intervals_equal_loops(spark):
    """Long and short ones, empty ones, nulls, touching bounds, repeated rows."""
    rng = random.Random(8)
    key = lambda: rng.choice(["hot", "hot", "b", None])
    spot = lambda: rng.choice([None, *range(-40, 40)])
    points = [(key(), n // 2, spot()) for n in range(120)]
    spans = [(key(), n // 2, s, None if s is None or rng.random() < 0.05 else s + rng.choice([0, 1, 2, 3, 5, 8, 64, 900])) for n, s in enumerate(spot() for _ in range(90))]
    others = [(k, n + 1000, s, e) for k, n, s, e in spans[::2]] + [("hot", 5, -10**9, 10**9)]
    p = spark.createDataFrame(points, "k string, p int, t long").repartition(3)
    a = spark.createDataFrame(spans, "k string, a int, s long, e long").repartition(3)
    b = spark.createDataFrame(others, "k string, b int, bs long, be long")
    whole = lambda rows: [r for r in rows if None not in r]
    want = sorted((x[1], y[1]) for x in whole(points) for y in whole(spans) if x[0] == y[0] and y[2] <= x[2] < y[3])
    assert sorted(map(tuple, temporal.interval_join(p, a, ["k"], "t", "s", "e").select("p", "a").collect())) == want and len(want) > 100
    full = lambda rows: [r for r in whole(rows) if r[2] < r[3]]
    want = sorted((x[1], y[1]) for x in full(spans) for y in full(others) if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    got = temporal.overlap_join(a, b, ["k"], ("s", "e"), ("bs", "be"))
    assert sorted((r.a, r.b) for r in got.collect()) == want and len(want) > 100
    assert temporal.interval_join(p, a.limit(0), ["k"], "t", "s", "e").collect() == []
    with pytest.raises(ValueError):
        temporal.interval_join(p.withColumn("s", F.lit(1)), a, ["k"], "t", "s", "e")
