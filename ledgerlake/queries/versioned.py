"""A ledger kept as versions: each commit whole, a stale writer refused."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..sources import versions
from .events import by_user_and_props, results
from .files import place
from .registry import query

_FIRST = "SELECT user_id, props, event_id, greatest(0, CAST(floor(value) AS BIGINT)) AS bytes, CAST(ts AS DATE) < DATE '2024-01-16' AS early FROM events WHERE event_type = 'purchase'"


@query("versioned_ledger", f"""SELECT 1 AS version, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, false AS refused FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS k FROM ({_FIRST}) WHERE early) WHERE k = 1
UNION ALL SELECT 2, count(*), CAST(sum(bytes) AS BIGINT), true FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY NOT early, event_id) AS k FROM ({_FIRST})) WHERE k = 1""")
def versioned_ledger(t):
    """First successes of half a month, then those of the other half added; a writer that began at the first is refused."""
    r = results(t, by_user_and_props())
    early = F.to_date("at") < F.to_date(F.lit("2024-01-16"))
    spark, folder = place(r)
    path = f"{folder}/successes"
    versions.update(spark, path, lambda known: ledger.first_success(r.filter(early)))
    versions.update(spark, path, lambda known: ledger.first_success(r.filter(~early), known))
    try:
        versions.commit(versions.read(spark, path, 1), path, 1)
        refused = False
    except versions.Conflict:
        refused = True
    count = lambda k, late: versions.read(spark, path, k).agg(F.lit(k).alias("version"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.lit(late).alias("refused"))
    return count(1, False).unionByName(count(2, refused))
