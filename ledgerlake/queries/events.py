"""Result logs and run events: ``events`` in order of ``event_id``; types stand for outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import history, ledger, ranking
from .registry import query

STATUS = {"purchase": "downloaded", "view": "skipped", "click": "duplicate", "error": "failed", "signup": "blocked"}
CASE = "CASE event_type WHEN 'purchase' THEN 'downloaded' WHEN 'view' THEN 'skipped' WHEN 'click' THEN 'duplicate' WHEN 'error' THEN 'failed' ELSE 'blocked' END"
KEY = "CAST(user_id AS VARCHAR) || ':' || props"
LAST_DAY = "2024-01-30"


def status(col=None):
    c = F.col("event_type") if col is None else col
    out = F.lit("blocked")
    for k, v in STATUS.items():
        if v != "blocked":
            out = F.when(c == k, v).otherwise(out)
    return out


def results(t, key=None):
    """Events as results of a log."""
    e = t("events")
    return e.select((F.col("user_id").cast("string") if key is None else key).alias("key"), status().alias("status"), F.lit("download.log").alias("file_name"), F.col("event_id").alias("line_no"), F.col("ts").alias("at"), F.floor("value").cast("long").cast("string").alias("bytes"), "user_id", "props")


def by_user_and_props():
    return F.concat_ws(":", F.col("user_id").cast("string"), F.col("props"))


_FIRST = f"""SELECT key, CAST(ts AS DATE) AS date, greatest(0, CAST(floor(value) AS BIGINT)) AS bytes, event_id
FROM (SELECT %s AS key, *, row_number() OVER (PARTITION BY %s ORDER BY event_id) AS rn FROM events WHERE event_type = 'purchase') WHERE rn = 1"""
_BY_USER = _FIRST % ("CAST(user_id AS VARCHAR)", "user_id")
_BY_PAIR = _FIRST % (KEY, "user_id, props")


@query("first_success_ledger", f"SELECT key, date, bytes FROM ({_BY_USER})")
def first_success_ledger(t):
    return ledger.first_success(results(t)).select("key", "date", "bytes")


@query("first_success_keeps_known", f"""WITH n AS ({_BY_PAIR}), k AS (SELECT key, DATE '2023-12-31' AS date, CAST(1 AS BIGINT) AS bytes FROM n WHERE event_id % 3 = 0)
SELECT key, date, bytes FROM k UNION ALL SELECT key, date, bytes FROM n WHERE key NOT IN (SELECT key FROM k)""")
def first_success_keeps_known(t):
    r = results(t, by_user_and_props())
    known = ranking.first_by_aggregate(r.filter("status = 'downloaded'"), ["key"], ["line_no"], []).filter("line_no % 3 = 0").select("key", F.to_date(F.lit("2023-12-31")).alias("date"), F.lit("2023-12-31").cast("timestamp_ntz").alias("at"), F.lit(1).cast("long").alias("bytes"))
    return ledger.first_success(r, known).select("key", "date", "bytes")


@query("trend_14d", f"""WITH l AS ({_BY_PAIR}), d AS (SELECT CAST(x AS DATE) AS date FROM generate_series(DATE '{LAST_DAY}' - INTERVAL 13 DAY, DATE '{LAST_DAY}', INTERVAL 1 DAY) s(x))
SELECT d.date, strftime(d.date, '%m/%d') AS label, count(l.key) AS items, CAST(coalesce(sum(l.bytes), 0) AS BIGINT) AS bytes FROM d LEFT JOIN l ON l.date = d.date GROUP BY d.date""")
def trend_14d(t):
    return ledger.day_trend(ledger.first_success(results(t, by_user_and_props())), LAST_DAY)


@query("trend_last_7_scaled", f"""WITH l AS ({_BY_PAIR}), c AS (SELECT date, count(*) AS items FROM l WHERE date > DATE '{LAST_DAY}' - INTERVAL 7 DAY GROUP BY date)
SELECT date, items, items / greatest(1, max(items) OVER ()) AS scale FROM c""")
def trend_last_7_scaled(t):
    """Last seven of the days, each against the largest."""
    trend = ledger.day_trend(ledger.first_success(results(t, by_user_and_props())), LAST_DAY, 7)
    top = trend.agg(F.greatest(F.lit(1), F.max("items")).alias("top"))
    return trend.crossJoin(F.broadcast(top)).select("date", "items", (F.col("items") / F.col("top")).alias("scale"))  # one row


@query("ingest_totals", f"""WITH l AS ({_BY_PAIR}) SELECT count(*) AS n_total, CAST(sum(bytes) AS BIGINT) AS bytes_total, count(*) FILTER (WHERE date = DATE '{LAST_DAY}') AS n_today,
CAST(coalesce(sum(bytes) FILTER (WHERE date = DATE '{LAST_DAY}'), 0) AS BIGINT) AS bytes_today FROM l""")
def ingest_totals(t):
    today = F.col("date") == F.to_date(F.lit(LAST_DAY))
    return ledger.first_success(results(t, by_user_and_props())).agg(F.count(F.lit(1)).alias("n_total"), F.sum("bytes").alias("bytes_total"), F.count_if(today).alias("n_today"), F.coalesce(F.sum(F.when(today, F.col("bytes"))), F.lit(0)).alias("bytes_today"))


@query("status_counters", f"""SELECT count(*) FILTER (WHERE s = 'downloaded') AS n_downloaded, count(*) FILTER (WHERE s = 'skipped') AS n_present, count(*) FILTER (WHERE s = 'duplicate') AS n_duplicate,
count(*) FILTER (WHERE s = 'blocked') AS n_blocked, count(*) FILTER (WHERE s = 'failed') AS n_failed, CAST(sum(CASE WHEN s = 'downloaded' THEN greatest(0, CAST(floor(value) AS BIGINT)) END) AS BIGINT) AS bytes_downloaded,
CAST(sum(k) AS BIGINT) AS n_retries, count(*) FILTER (WHERE k > 0) AS n_retried, count(*) FILTER (WHERE k > 0 AND s IN ('downloaded', 'skipped', 'duplicate')) AS n_recovered
FROM (SELECT {CASE} AS s, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 AS k FROM events)""")
def status_counters(t):
    retries = (text.tolerant_int(F.get_json_object("props", "$.k")) % 4).cast("string")
    return history.outcome_counts(results(t).withColumn("autoRetries", retries))


@query("latest_event_by_type", "SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event_by_type(t):
    return history.latest(t("events").select("event_type", "event_id", "user_id"), "event_id", ["event_type"])


@query("latest_event_overall", "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 1")
def latest_event_overall(t):
    return history.latest(t("events").select("event_id", "event_type", "user_id"), "event_id")


@query("latest_task_events", """WITH e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'repair' ELSE 'crawl' END AS task, CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'attention' ELSE 'failed' END AS result FROM events WHERE event_id % 3 = 1)
SELECT 'any' AS of, max(event_id) AS event_id FROM e UNION ALL SELECT 'crawl', max(event_id) FROM e WHERE task = 'crawl' UNION ALL SELECT 'repair', max(event_id) FROM e WHERE task = 'repair'
UNION ALL SELECT 'complete', max(event_id) FROM e WHERE task = 'crawl' AND result <> 'failed'""")
def latest_task_events(t):
    """The last events of each kind; those without a timestamp (null or blank) are passed over."""
    n = F.col("event_id")
    e = t("events").select(
        n.alias("line_no"), F.when(n % 3 == 1, F.col("ts").cast("string")).when(n % 3 == 2, "").alias("timestamp"), F.when(F.col("event_type") == "view", "repair").alias("taskType"),
        F.when(n % 4 == 0, "success").when(n % 4 == 1, "attention").when(n % 4 == 2, "failed").alias("resultStatus"), F.lit("1").alias("crawlExitCode"), F.lit(None).cast("string").alias("downloadExitCode"), F.lit("0").alias("listingFailures"),
    )
    found = {"any": (), "crawl": ("crawl",), "repair": ("repair",), "complete": ("crawl", ("success", "attention"))}
    parts = [history.latest_task_event(e, *args).select(F.lit(name).alias("of"), F.col("line_no").alias("event_id")) for name, args in found.items()]
    return history.union_of(*parts)


@query("latest_success_of_day", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) = DATE '2024-01-15' AND event_id % 3 <> 0 AND event_id % 5 = 1 AND event_id % 7 <> 0 AND event_id % 11 <> 1 ORDER BY event_id DESC LIMIT 1")
def latest_success_of_day(t):
    """Downloads asked for (not each third), both exits 0 (or none, 1, or the text "0"), the result a success."""
    n = F.col("event_id")
    e = t("events").select(
        n.alias("line_no"), F.col("ts").cast("string").alias("timestamp"), F.lit("2024-01-15").alias("startedAt"), F.when(n % 2 == 0, "crawl").alias("taskType"), F.when(F.col("event_type") == "purchase", "success").otherwise("attention").alias("resultStatus"),
        F.when(n % 7 == 0, "1").when(n % 11 == 1, '"0"').otherwise("0").alias("crawlExitCode"), F.when(n % 5 == 1, "0").when(n % 5 == 2, "1").alias("downloadExitCode"), F.lit("0").alias("listingFailures"), (n % 3 != 0).alias("downloadRequested"), "user_id",
    )
    return history.latest_success_of_day(e, "2024-01-15").select(F.col("line_no").alias("event_id"), "user_id")


@query("result_status_by_day", """SELECT day, CASE WHEN errors % 5 IN (0, 2, 3) AND clicks % 3 <> 1 AND signups % 5 <> 3 THEN CASE WHEN signups % 2 > 0 THEN 'attention' ELSE 'success' END ELSE 'failed' END AS result FROM (
SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'signup') AS signups FROM events GROUP BY 1)""")
def result_status_by_day(t):
    """Exit codes as JSON text: numbers end well where they are 0, texts never do."""
    day = t("events").groupBy(F.to_date("ts").alias("day")).agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("error", "click", "signup")])
    exit_ = F.when(F.col("signup") % 5 == 3, '"0"').when(F.col("click") % 3 == 1, "1").when(F.col("click") % 3 == 2, "0")
    crawl = F.element_at(F.array(*[F.lit(x) for x in ("0", '"0"', "0.0", "false", "1")]), (F.col("error") % 5 + 1).cast("int"))
    return day.select("day", rules.result_status(F.lit(None).cast("string"), crawl, exit_, (F.col("signup") % 2).cast("string")).alias("result"))


@query("run_result_by_day", """SELECT day, CASE WHEN e % 7 = 0 THEN 'failed' WHEN c % 2 > 0 OR s % 2 > 0 THEN 'attention' ELSE 'success' END AS result, CASE WHEN e % 2 = 0 AND c % 2 = 0 THEN 'success' ELSE 'failed' END AS repair FROM (
SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'signup') AS s FROM events GROUP BY 1)""")
def run_result_by_day(t):
    day = t("events").groupBy(F.to_date("ts").alias("day")).agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("error", "click", "signup")])
    zero = F.lit(0)
    return day.select("day", rules.run_result(F.when(F.col("error") % 7 == 0, 1).otherwise(0), zero, F.col("click") % 2, F.col("signup") % 2, zero).alias("result"), rules.repair_result(F.col("error") % 2, F.col("click") % 2, zero).alias("repair"))


@query("counter_presence", """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(-1 AS BIGINT) AS missing, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN 0 WHEN event_id % 4 = 2 THEN event_id ELSE 7 END AS mixed FROM events""")
def counter_presence(t):
    line = F.when(F.col("event_id") % 4 == 0, '{"n": null}').when(F.col("event_id") % 4 == 1, '{"n": "nope"}').when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"n": "'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise("{}")
    return t("events").select("event_id", text.counter(F.col("props"), "k").alias("k"), text.counter(F.col("props"), "gone", -1).alias("missing"), text.counter(line, "n", 7).alias("mixed"))


@query("failure_summary", """SELECT count(*) FILTER (WHERE event_type NOT IN ('signup', 'click')) AS n_unsafe, count(*) FILTER (WHERE event_type = 'error') AS n_challenges, bool_or(event_type = 'error') AS challenged FROM events""")
def failure_summary(t):
    kind = F.when(F.col("event_type") == "signup", "media_mismatch").when(F.col("event_type") == "click", "media_unavailable").when(F.col("event_type") == "error", "auth_challenge").otherwise("resolve_error")
    return history.failure_counts(t("events").select(kind.alias("kind"), F.lit("").alias("error")))


@query("failure_kinds", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'auth_challenge' WHEN event_type = 'signup' THEN 'media_mismatch' WHEN event_type = 'click' THEN 'media_unavailable' WHEN event_id % 3 = 0 THEN 'media_mismatch' ELSE 'download_error' END AS kind, event_id % 3 = 0 AS safe FROM events""")
def failure_kinds(t):
    """Causes go before texts; what neither tells of is an error of the download."""
    cause = F.when(F.col("event_type") == "error", "challenge").when(F.col("event_type") == "signup", "mismatch").when(F.col("event_type") == "click", "unavailable").when(F.col("event_type") == "view", "")
    error = F.when(F.col("event_id") % 3 == 0, "page does not match the listing").when(F.col("event_id") % 3 == 1, "HTTP 503")
    return t("events").select("event_id", rules.failure_kind(cause, error).alias("kind"), rules.safe_block(F.lit(None).cast("string"), error).alias("safe"))


@query("blocked_distinct", "SELECT count(DISTINCT user_id) AS n FROM events WHERE event_type = 'signup' OR (event_type = 'error' AND event_id % 2 = 0)")
def blocked_distinct(t):
    e = t("events")
    failures = e.filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("viewkey"), F.when(F.col("event_id") % 2 == 0, "media_mismatch").otherwise("request_error").alias("kind"), F.lit("").alias("error"))
    manifest = e.select(F.col("user_id").cast("string").alias("viewkey"), status().alias("status"))
    return history.blocked_keys(failures, manifest).agg(F.count(F.lit(1)).alias("n"))


@query("manifest_union_latest", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 2 = 1 OR event_type <> 'view') WHERE rn = 1""")
def manifest_union_latest(t):
    e = t("events")
    a = e.filter("event_id % 2 = 1").select("user_id", "event_id", "event_type")
    b = e.filter("event_id % 2 = 0 and event_type <> 'view'").select("event_id", "user_id", "event_type", F.lit(1).alias("extra"))
    return ranking.last_per(history.union_of(a, b), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("newest_manifest", "SELECT count(*) AS n FROM events WHERE event_id % 2 = 0")
def newest_manifest(t):
    e = t("events")
    return history.newest([(5.0, e.filter("event_id % 2 = 0")), (3.0, e), (5.0, e.limit(0))]).agg(F.count(F.lit(1)).alias("n"))


@query("manifest_block_kinds", """SELECT user_id AS key, kind FROM (SELECT user_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM (
SELECT user_id, event_id, CASE WHEN event_type NOT IN ('signup', 'error') THEN NULL WHEN event_id % 4 = 0 THEN CASE WHEN event_type = 'signup' THEN 'media_unavailable' END WHEN event_id % 4 = 1 THEN 'media_mismatch' WHEN event_id % 5 = 0 THEN 'media_mismatch' END AS kind FROM events) WHERE kind IS NOT NULL) WHERE rn = 1""")
def manifest_block_kinds(t):
    """The row's own kind goes before the phrase in its text: a failed row that is merely unavailable blocks nothing."""
    kind = F.when(F.col("event_id") % 4 == 0, "media_unavailable").when(F.col("event_id") % 4 == 1, "media_mismatch").when(F.col("event_id") % 4 == 2, "request_error")
    k = rules.manifest_block_kind(status(), kind, F.when(F.col("event_id") % 5 == 0, "it does not match the listing").otherwise(""))
    return history.latest(t("events").select(F.col("user_id").alias("key"), k.alias("kind"), "event_id").filter("kind is not null"), "event_id", ["key"]).select("key", "kind")


@query("progress_metrics", """SELECT user_id, n, done, CAST(round(100.0 * done / n, 1) AS DOUBLE) AS percent, bytes, bytes / secs AS speed, CASE WHEN secs > 0 AND n > done THEN (n - done) * 1000.0 / (bytes / secs) END AS eta FROM (
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS done, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes, date_diff('second', min(ts), max(ts)) AS secs FROM events GROUP BY user_id HAVING date_diff('second', min(ts), max(ts)) > 0 AND sum(CAST(floor(value) AS BIGINT)) > 0)""")
def progress_metrics(t):
    sec = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    g = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.sum(F.floor("value").cast("long")).alias("bytes"), sec.alias("secs")).filter("secs > 0 and bytes > 0")
    rate = text.speed(F.col("bytes"), F.col("secs"))
    return g.select("user_id", "n", "done", text.percent(F.col("done"), F.col("n")).alias("percent"), "bytes", rate.alias("speed"), text.eta((F.col("n") - F.col("done")) * 1000.0, rate, F.lit(0), F.lit(0)).alias("eta"))


@query("ema_speed", "SELECT user_id, round(list_reduce(list(value ORDER BY event_id) FILTER (WHERE value >= 0.5), lambda a, v: 0.25 * v + 0.75 * a), 6) AS ema FROM events GROUP BY user_id")
def ema_speed(t):
    """Exponential mean of values a user, in order."""
    return ranking.ema(t("events"), ["user_id"], "event_id", "value", "value").withColumn("ema", F.round("ema", 6))


@query("progress_coercion", """SELECT user_id, CASE WHEN e > 0 AND e <= s THEN 'complete' WHEN e > 0 THEN 'failed' ELSE 'downloading' END AS stage, CAST(CASE WHEN e > 0 AND e <= s THEN 0 ELSE e END AS BIGINT) AS failed FROM (
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'signup') AS s FROM events GROUP BY user_id)""")
def progress_coercion(t):
    g = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "signup").alias("s"))
    out = rules.coerced_progress(F.when(F.col("e") > 0, "failed"), F.col("e"), F.lit(0), F.col("s"))
    return g.select("user_id", out.alias("p")).select("user_id", "p.stage", "p.failed")


@query("hours_and_labels", """SELECT event_id, greatest(0, date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') / 3600.0) AS hours, strftime(ts, '%m/%d') AS label, CAST(floor(value / 10) * 10 AS BIGINT) AS floored FROM events""")
def hours_and_labels(t):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return t("events").select("event_id", rules.hours_since(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), now).alias("hours"), rules.day_label(F.to_date("ts")).alias("label"), text.floor_to(F.col("value"), 10).alias("floored"))


@query("log_names", """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN strptime(strftime(ts, '%Y%m%d-%H%M%S'), '%Y%m%d-%H%M%S') END AS logged_at FROM events""")
def log_names(t):
    stamp = F.date_format("ts", "yyyyMMdd-HHmmss")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("download-"), stamp, F.lit(".log"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("repair-download-"), stamp, F.lit(".log"))).otherwise(F.concat(F.lit("other-"), stamp, F.lit(".log")))
    return t("events").select("event_id", rules.log_time(name).cast("timestamp_ntz").alias("logged_at"))


@query("active_outer_join", f"""WITH p AS (SELECT {KEY} AS key, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS a FROM events WHERE event_type = 'error' GROUP BY 1),
g AS (SELECT {KEY} AS key, CAST(sum(CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS d, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(value / 2) AS BIGINT) END) AS BIGINT) AS t FROM events WHERE event_type = 'click' GROUP BY 1),
j AS (SELECT coalesce(p.key, g.key) AS key, CASE WHEN coalesce(d, 0) <> 0 THEN d ELSE coalesce(a, 0) END AS done, coalesce(t, 0) AS total FROM p FULL JOIN g ON p.key = g.key)
SELECT key, done AS bytes_done, total AS bytes_total, CASE WHEN total <> 0 THEN round(100.0 * done / total, 1) END AS percent FROM j""")
def active_outer_join(t):
    """Errors stand for files and clicks for gauges, by user and props: some keys are on one side only, some gauges
    have no bytes or no total, some have more bytes than their total."""
    from ..operators.inventory import active_downloads

    e = t("events").withColumn("key", by_user_and_props())
    whole, half = F.floor("value").cast("long"), F.floor(F.col("value") / 2).cast("long")
    p = e.filter("event_type = 'error'").groupBy("key").agg(F.sum(whole).alias("size_bytes"))
    g = e.filter("event_type = 'click'").groupBy("key").agg(F.sum(F.when(F.col("event_id") % 2 == 0, whole).otherwise(0)).alias("bytes_done"), F.sum(F.when(F.col("event_id") % 3 == 0, 0).otherwise(half)).alias("bytes_total"))
    return active_downloads(p, g)


@query("sessionize", """SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts >= before + INTERVAL 30 MINUTE GROUP BY user_id""")
def sessionize(t):
    """Extension: sessions by a gap of half an hour."""
    s = t("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01 00:00:00') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(t):
    """Extension: counts by six hours."""
    return t("events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
