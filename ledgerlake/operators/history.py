"""Run history: latest events and summaries of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.rules import json_zero, result_status, safe_block, task_type, timestamp_of
from ..functions.text import blank, tolerant_int

_OUTCOMES = (("downloaded", "n_downloaded"), ("skipped", "n_present"), ("duplicate", "n_duplicate"), ("blocked", "n_blocked"), ("failed", "n_failed"))


def described(events: DataFrame) -> DataFrame:
    """Events with their normal ``task`` and ``result``."""
    return events.withColumns({"task": task_type(F.col("taskType")), "result": result_status(F.col("resultStatus"), F.col("crawlExitCode"), F.col("downloadExitCode"), F.col("listingFailures"))})


def latest(events: DataFrame, order: str = "line_no", by: list[str] | None = None) -> DataFrame:
    """The last event by line, overall or by some columns; a partial maximum, no window."""
    rest = [c for c in events.columns if c != order and c not in (by or [])]
    agg = F.max(F.struct(order, *rest)).alias("m")
    one = events.groupBy(*by).agg(agg) if by else events.agg(agg).filter("m is not null")
    return one.select(*(by or []), "m.*").select(*events.columns)


def latest_task_event(events: DataFrame, task: str | None = None, results: tuple[str, ...] | None = None) -> DataFrame:
    """The last event with a timestamp, of one task and with one of some results where they are given."""
    e = described(events).filter(~blank(F.col("timestamp")))
    e = e if task is None else e.filter(F.col("task") == task)
    return latest(e if results is None else e.filter(F.col("result").isin(*results)))


def good_day(day: Column) -> Column:
    """Whether a described event is a run of ``day`` that asked for downloads and ended well: both exit codes 0 and the result a success."""
    ended = json_zero(F.col("crawlExitCode")) & json_zero(F.col("downloadExitCode")) & F.coalesce(F.col("downloadRequested"), F.lit(False))
    return ended & (F.col("result") == "success") & F.coalesce(F.to_date(timestamp_of(F.col("timestamp"))) == day, F.lit(False))


def latest_success_of_day(events: DataFrame, day: str) -> DataFrame:
    return latest(described(events).filter(good_day(F.to_date(F.lit(day)))))


def latest_manual_crawl(events: DataFrame) -> DataFrame:
    """Last manual crawl that tells about the credential: a clean exit, or a failure seen by a detector of version 2 on.

    Exit codes and versions count as numbers only; events without a timestamp are passed over.
    """
    version = F.col("authDetectorVersion")
    new = F.coalesce(version.rlike(r"\A-?\d+\z") & (version.try_cast("decimal(38,0)") >= 2), F.lit(False))
    seen = F.coalesce(F.col("authFailure"), F.lit(False)) & new
    e = described(events).filter(~blank(F.col("timestamp")))
    return latest(e.filter((F.col("task") == "crawl") & (F.col("trigger") == "manual") & (json_zero(F.col("crawlExitCode")) | seen)))


def outcome_counts(results: DataFrame) -> DataFrame:
    """Counters of a manifest: outcomes, bytes of downloads, retries."""
    s, retries = F.col("status"), tolerant_int(F.col("autoRetries"))
    return results.agg(
        *[F.count_if(s == k).alias(n) for k, n in _OUTCOMES],
        F.coalesce(F.sum(F.when(s == "downloaded", F.greatest(F.lit(0).cast("long"), tolerant_int(F.col("bytes"))))), F.lit(0)).alias("bytes_downloaded"),
        F.coalesce(F.sum(retries), F.lit(0)).alias("n_retries"),
        F.count_if(retries > 0).alias("n_retried"),
        F.count_if((retries > 0) & s.isin("downloaded", "skipped", "duplicate")).alias("n_recovered"),
    )


def blocked_keys(failures: DataFrame, manifest: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Distinct keys blocked by the resolver or the manifest; blank keys don't count."""
    a = failures.filter(safe_block(F.col("kind"), F.col("error"), settings)).select(F.col("viewkey").alias("key"))
    b = manifest.filter("status = 'blocked'").select(F.col("viewkey").alias("key"))
    return a.union(b).filter(~blank(F.col("key"))).distinct()


def failure_counts(failures: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows, not keys, of failures that block nothing, and challenges met."""
    safe = safe_block(F.col("kind"), F.col("error"), settings)
    return failures.agg(F.count_if(~safe).alias("n_unsafe"), F.count_if(F.col("kind") == "auth_challenge").alias("n_challenges"), F.coalesce(F.bool_or(F.col("kind") == "auth_challenge"), F.lit(False)).alias("challenged"))


def error_kinds(failures: DataFrame) -> DataFrame:
    return failures.agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def current_manifest(manifest: DataFrame, download_requested: bool, queue: DataFrame) -> DataFrame:
    """The manifest if this run asked for downloads and had a queue, else no rows."""
    return manifest if download_requested and not queue.isEmpty() else manifest.limit(0)


def newest(tables: list[tuple[float, DataFrame]]) -> DataFrame:
    """The table with the greatest time; the first of equals."""
    best = max(range(len(tables)), key=lambda k: (tables[k][0], -k))
    return tables[best][1]


def union_of(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
