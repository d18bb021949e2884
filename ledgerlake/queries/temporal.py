"""Joins over time on ``events``: what was in force, what came next, what ran meanwhile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal
from .registry import query

_HOUR = 3_600_000_000


def _of(t, kind: str, **names: str):
    """Events of a kind under other names."""
    return t("events").filter(F.col("event_type") == kind).select("user_id", *[F.col(c).alias(n) for n, c in names.items()])


def _windows(t, kind: str, number: str, start: str, end: str, hours: int):
    """An interval from each event of a kind on, of 1 to ``hours`` hours."""
    e = t("events").filter(F.col("event_type") == kind)
    long = F.make_dt_interval(hours=(F.col("event_id") % hours + 1).cast("int"))
    return e.select("user_id", F.col("event_id").alias(number), F.col("ts").alias(start), (F.col("ts") + long).alias(end))


@query("credential_in_force", """WITH c AS (SELECT user_id, ts, max(event_id) AS credential FROM events WHERE event_type = 'signup' GROUP BY user_id, ts)
SELECT e.event_id, c.credential, c.ts IS NULL AS without FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def credential_in_force(t):
    """Each blocked event with the user's credential that held at its time."""
    blocked, held = _of(t, "error", event_id="event_id", ts="ts"), _of(t, "signup", credential="event_id", since="ts")
    found = temporal.asof_join(blocked, held, ["user_id"], "ts", "since", ["credential"])
    return found.select("event_id", "credential", F.col("credential").isNull().alias("without"))


@query("recovered_within_day", """WITH p AS (SELECT user_id, ts, max(event_id) AS success FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, CASE WHEN p.ts - e.ts <= INTERVAL 24 HOUR THEN p.success END AS success FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts <= p.ts""")
def recovered_within_day(t):
    """Each failure with the user's next success, if it came within a day."""
    failed, done = _of(t, "error", event_id="event_id", ts="ts"), _of(t, "purchase", success="event_id", at="ts")
    return temporal.asof_join(failed, done, ["user_id"], "ts", "at", ["success"], forward=True, within=24 * _HOUR).select("event_id", "success")


@query("last_failure_anywhere", """WITH f AS (SELECT ts, max(event_id) AS failure FROM events WHERE event_type = 'error' GROUP BY ts)
SELECT e.event_id, f.failure FROM events e ASOF LEFT JOIN f ON e.ts > f.ts""")
def last_failure_anywhere(t):
    """Each event with the failure before it, whoever's: one key holds every row, stretches of six hours share the work."""
    e = t("events").select("event_id", "ts")
    failures = _of(t, "error", failure="event_id", at="ts").drop("user_id")
    return temporal.asof_join(e, failures, [], "ts", "at", ["failure"], strict=True, width=6 * _HOUR).select("event_id", "failure")


@query("clicks_in_windows", """SELECT c.event_id AS click, s.event_id AS opened FROM events c JOIN events s ON c.user_id = s.user_id AND c.event_type = 'click' AND s.event_type = 'signup'
WHERE c.ts >= s.ts AND c.ts < s.ts + to_hours(CAST(s.event_id % 300 + 1 AS INT))""")
def clicks_in_windows(t):
    """Clicks inside the windows that the user's signups opened, of one hour to over twelve days."""
    return temporal.interval_join(_of(t, "click", click="event_id", at="ts"), _windows(t, "signup", "opened", "since", "until", 300), ["user_id"], "at", "since", "until").select("click", "opened")


@query("overlapping_windows", """SELECT a.event_id AS opened, b.event_id AS trouble FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'error'
WHERE a.ts < b.ts + to_hours(CAST(b.event_id % 9 + 1 AS INT)) AND b.ts < a.ts + to_hours(CAST(a.event_id % 60 + 1 AS INT))""")
def overlapping_windows(t):
    """Pairs of a signup's window and a time of trouble of the same user that share a moment."""
    opened, trouble = _windows(t, "signup", "opened", "since", "until", 60), _windows(t, "error", "trouble", "begin", "over", 9)
    return temporal.overlap_join(opened, trouble, ["user_id"], ("since", "until"), ("begin", "over")).select("opened", "trouble")
