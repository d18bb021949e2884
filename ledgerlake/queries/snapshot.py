"""Snapshot rules over the events of each day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import snapshot
from .registry import query

_D = """SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'signup') AS s,
count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY 1"""
_F = f"""SELECT *, CASE e % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'attention' ELSE 'failed' END AS result, e % 5 > 0 AS has_snapshot, c % 40 AS age, CASE WHEN c % 2 = 0 THEN 'crawl' ELSE 'repair' END AS task, e % 4 AS lf, s % 3 AS blocked,
v % 2 AS cur, p % 2 AS backlog, s % 2 AS ign, e % 2 AS partials, p % 3 AS mf FROM ({_D})"""


def facts(t):
    day = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("event_type") == k).alias(a) for a, k in (("e", "error"), ("c", "click"), ("s", "signup"), ("v", "view"), ("p", "purchase"))])
    c = F.col
    result = F.when(c("e") % 3 == 0, "success").when(c("e") % 3 == 1, "attention").otherwise("failed")
    return day.select(
        "day", result.alias("event_result"), (c("e") % 5 > 0).alias("has_snapshot"), (c("c") % 40).cast("double").alias("age_hours"), F.when(c("c") % 2 == 0, "crawl").otherwise("repair").alias("event_task"),
        (c("e") % 4).alias("listing_failures"), (c("e") % 4).alias("event_listing_failures"), (c("s") % 3).alias("n_blocked"), (c("v") % 2).alias("n_current_errors"), (c("p") % 2).alias("n_backlog"), (c("s") % 2).alias("n_ignored"),
        (c("e") % 2).alias("n_partials"), (c("p") % 3).alias("n_manifest_failures"), c("n").alias("event_raw_links"), (c("n") - c("c")).alias("event_unique"), c("p").alias("event_new"), c("v").alias("event_retry"), c("s").alias("event_blocked"), c("e").alias("event_failed"),
        c("p").alias("event_downloaded"), c("v").alias("event_present"), c("n").alias("n_items"), c("n").alias("raw_links"), (c("n") - c("s")).alias("n_resolved"), (c("n") - (c("s") % 3) - (c("s") % 2)).alias("n_downloaded"), (c("c") % 5 > 0).alias("today_success"), F.when(c("v") % 4 == 1, 1).otherwise(0).alias("today_listing_failures"), F.when(c("s") % 3 == 2, 1).otherwise(0).alias("n_mismatch"), F.when(c("c") % 7 == 0, 1).otherwise(0).alias("n_unavailable"),
    )


_RULES = [
    ("1", "error", "run", "run_failed", "result = 'failed'", "lf"),
    ("2", "error", "run", "snapshot_missing", "NOT has_snapshot", "0"),
    ("3", "warning", "run", "snapshot_stale", "has_snapshot AND age > 26", "age"),
    ("4", "warning", "run", "listing_failures", "lf > 0", "lf"),
    ("5", "success", "run", "blocked_skipped", "blocked > 0", "blocked"),
    ("6", "warning", "task", "unresolved_now", "cur > 0", "cur"),
    ("7", "info", "backlog", "backlog", "backlog > 0", "backlog"),
    ("8", "info", "backlog", "ignored", "ign > 0", "ign"),
    ("9", "warning", "run", "partials_left", "partials > 0", "partials"),
    ("10", "error", "run", "downloads_failed", "mf > 0", "mf"),
]
_MIS, _UN = "CASE WHEN s % 3 = 2 THEN 1 ELSE 0 END", "CASE WHEN c % 7 = 0 THEN 1 ELSE 0 END"
_LEFT = f"greatest(0, blocked - ({_MIS}) - ({_UN}))"
_WHY = f"concat_ws(', ', CASE WHEN ({_MIS}) > 0 THEN ({_MIS}) || ' mismatch' END, CASE WHEN ({_UN}) > 0 THEN ({_UN}) || ' unavailable' END, CASE WHEN {_LEFT} > 0 THEN {_LEFT} || ' unclassified' END)"
_A = " UNION ALL ".join(f"SELECT day, CAST({o} AS INT) AS ord, '{lv}' AS level, '{sc}' AS scope, '{code}' AS code, CAST({n} AS BIGINT) AS n, {_WHY if o == '5' else chr(39) * 2} AS detail FROM f WHERE {when}" for o, lv, sc, code, when, n in _RULES)
_CLEAR = " AND ".join(f"NOT ({when})" for *_, when, _n in _RULES)


@query("alerts", f"WITH f AS ({_F}) {_A} UNION ALL SELECT day, CAST(11 AS INT), 'success', 'run', 'all_clear', CAST(0 AS BIGINT), '' FROM f WHERE {_CLEAR}")
def alerts(t):
    return snapshot.snapshot(facts(t)).select("day", F.explode("alerts").alias("a")).select("day", "a.*")


_ATT = "(result = 'failed' OR NOT has_snapshot OR (has_snapshot AND age > 26) OR lf > 0 OR cur > 0 OR partials > 0 OR mf > 0)"


@query("run_status", f"SELECT day, CASE WHEN result = 'success' AND NOT {_ATT} THEN 'ready' ELSE 'attention' END AS run_status, c % 5 > 0 AND v % 4 <> 1 AND partials = 0 AND cur = 0 AND mf = 0 AS completed_today FROM ({_F})")
def run_status(t):
    return snapshot.snapshot(facts(t)).select("day", "run_status", "completed_today")


@query("stages", f"""WITH f AS (SELECT *, CASE WHEN task = 'crawl' AND result = 'failed' THEN 'failed' WHEN task = 'crawl' THEN 'crawl' ELSE 'inventory' END AS form, CASE WHEN result = 'attention' OR e > 0 THEN 'attention' ELSE 'done' END AS st FROM ({_F}))
SELECT day, CAST(1 AS INT) AS ord, 'listing' AS name, CASE form WHEN 'failed' THEN 'attention' WHEN 'crawl' THEN CASE WHEN lf > 0 THEN 'attention' ELSE 'done' END ELSE 'done' END AS status, n AS value FROM f
UNION ALL SELECT day, CAST(2 AS INT), 'dedupe', 'done', CASE form WHEN 'inventory' THEN n ELSE n - c END FROM f
UNION ALL SELECT day, CAST(3 AS INT), 'resolve', CASE form WHEN 'failed' THEN CASE WHEN p + v > 0 THEN 'attention' ELSE 'waiting' END WHEN 'crawl' THEN st ELSE CASE WHEN n - s + blocked + ign = n THEN 'done' ELSE 'attention' END END, CASE form WHEN 'inventory' THEN n - s ELSE greatest(0, p + v - s - e) END FROM f
UNION ALL SELECT day, CAST(4 AS INT), 'store', CASE form WHEN 'failed' THEN CASE WHEN p + v > 0 THEN 'attention' ELSE 'waiting' END WHEN 'crawl' THEN st ELSE 'done' END, CASE form WHEN 'inventory' THEN n - blocked - ign ELSE p + v END FROM f""")
def stages(t):
    return snapshot.snapshot(facts(t)).select("day", F.explode("stages").alias("s")).select("day", "s.*")


_GAUGE = "SELECT CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'cancelled' ELSE 'downloading' END AS stage, count(*) AS total FROM events WHERE CAST(ts AS DATE) = DATE '{}' GROUP BY 1"


@query("shown_progress", f"SELECT stage, total, 'last' AS shown FROM ({_GAUGE.format('2024-01-05')}) WHERE stage <> 'downloading' ORDER BY total DESC, stage LIMIT 1")
def shown_progress(t):
    """Nothing in work: the last archived gauge, here the largest of a day. Gauges that ended in no way are not archived."""
    return snapshot.shown_progress(gauges(t, "2024-01-05").limit(0), gauges(t, "2024-01-05").filter("stage <> 'downloading'").orderBy(F.desc("total"), "stage").limit(1))


@query("shown_progress_live", f"SELECT stage, total, 'current' AS shown FROM ({_GAUGE.format('2024-01-06')}) WHERE stage = 'downloading'")
def shown_progress_live(t):
    """A gauge in work goes before an archived one."""
    return snapshot.shown_progress(gauges(t, "2024-01-06").filter("stage = 'downloading'"), gauges(t, "2024-01-05").filter("stage = 'complete'"))


def gauges(t, day):
    kind = F.col("event_type")
    stage = F.when(kind == "purchase", "complete").when(kind == "error", "failed").when(kind == "view", "cancelled").otherwise("downloading")
    return t("events").filter(F.to_date("ts") == F.to_date(F.lit(day))).groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("total"))
