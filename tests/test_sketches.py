"""Summaries united in any way tell what one over all rows would, within their error."""

from pyspark.sql import functions as F

from ledgerlake.operators import sketches


def test_united_summaries_hold_their_error(spark):
    rows = spark.range(60000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), (F.col("id") % 30).alias("day"), (F.col("id") % 9000).alias("who"), (F.col("id") * 7919 % 60000).alias("v"))
    daily = sketches.summarised(rows, ["source", "day"], "who", "v")
    by_source, straight = sketches.united(daily, ["source"]), sketches.united(daily, [])
    by_way = sketches.united(by_source, [])
    exact = {r.source: r for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("who").alias("d"), F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")).collect()}
    for r in sketches.estimated(by_source, (0.1, 0.5, 0.9)).collect():
        want = exact[r.source]
        assert r.n == want.n and abs(r.n_distinct - want.d) <= 0.05 * want.d
        assert all(abs(a - b) <= 0.03 * 60000 for a, b in zip(r.quantiles, want.q))
    for one in (straight, by_way):
        (r,) = sketches.estimated(one, (0.25,)).collect()
        assert r.n == 60000 and abs(r.n_distinct - 9000) <= 450 and abs(r.quantiles[0] - 15000) <= 1800


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", None, None), ("a", None, None), ("b", "x", 2.0), (None, "x", 3.0)], "g string, who string, v double")
    got = {r.g: (r.n, r.n_distinct, r.quantiles) for r in sketches.estimated(sketches.summarised(rows, ["g"], "who", "v")).collect()}
    assert got == {"a": (2, 0, None), "b": (1, 1, [2.0]), None: (1, 1, [3.0])}
    (r,) = sketches.estimated(sketches.united(sketches.summarised(rows, ["g"], "who", "v"), []), (0.0, 1.0)).collect()
    assert (r.n, r.n_distinct, r.quantiles) == (4, 1, [2.0, 3.0])
    assert sketches.summarised(rows.limit(0), ["g"], "who", "v").collect() == []
