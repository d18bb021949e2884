"""Summaries by day and type, united, against exact figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches
from .registry import query


def _held(summaries, rows, by: list[str]):
    """Whether the estimates of ``summaries`` are near the exact figures of ``rows``: distinct counts by 5 %, ranks of quartiles by 3 %."""
    told = sketches.estimated(summaries, (0.25, 0.5, 0.75))
    exact = rows.groupBy(*by).agg(F.count_distinct("what").alias("d"))
    joined = rows.join(told, by) if by else rows.crossJoin(F.broadcast(told))  # one row
    shares = [F.avg((F.col("value") <= F.col("quantiles")[k]).cast("double")) for k in range(3)]
    near = F.lit(True)
    for share, q in zip(shares, (0.25, 0.5, 0.75)):
        near = near & (F.abs(share - q) <= 0.03)
    ranks = joined.groupBy(*by).agg(near.alias("ranks_held"))
    out = told.join(exact, by).join(ranks, by) if by else told.crossJoin(exact).crossJoin(ranks)
    return out.select(*by, "n", (F.abs(F.col("n_distinct") - F.col("d")) <= F.col("d") * 0.05 + 1).alias("distinct_held"), "ranks_held")


@query("sketches_united", """SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, true AS distinct_held, true AS ranks_held FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def sketches_united(t):
    """Daily summaries of each type united to types, and these to everything; each held against exact counts and ranks."""
    e = t("events").withColumn("day", F.to_date("ts")).withColumn("what", F.concat_ws(":", "user_id", "props"))
    daily = sketches.summarised(e, ["event_type", "day"], "what", "value")
    types = sketches.united(daily, ["event_type"])
    return _held(types, e, ["event_type"]).unionByName(_held(sketches.united(types, []), e, []).withColumn("event_type", F.lit("all")))
