"""The status snapshot: alerts, stages and run status by rules over one row of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings

#: Facts that the rules read; missing ones count as 0, false or blank.
FACTS = {
    "has_snapshot": "boolean", "age_hours": "double", "active": "boolean", "event_task": "string", "event_result": "string",
    "listing_failures": "long", "event_listing_failures": "long", "n_items": "long", "raw_links": "long", "n_resolved": "long", "n_downloaded": "long",
    "n_blocked": "long", "n_ignored": "long", "n_mismatch": "long", "n_unavailable": "long", "n_current_errors": "long", "n_backlog": "long",
    "n_partials": "long", "n_manifest_failures": "long", "event_raw_links": "long", "event_unique": "long", "event_new": "long", "event_retry": "long",
    "today_listing_failures": "long", "event_blocked": "long", "event_failed": "long", "event_downloaded": "long", "event_present": "long", "no_work": "boolean", "today_success": "boolean",
}


def facts(df: DataFrame) -> DataFrame:
    """``df`` with every fact present, typed and not null."""
    zero = {"long": 0, "double": 0.0, "boolean": False, "string": ""}
    have = set(df.columns)
    cols = []
    for name, kind in FACTS.items():
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        cols.append((value if name == "age_hours" else F.coalesce(value, F.lit(zero[kind]).cast(kind))).alias(name))
    return df.select(*cols, *[c for c in df.columns if c not in FACTS])


def _alert(when: Column, ord_: int, level: str, scope: str, code: str, n: Column, detail: Column | None = None) -> Column:
    fields = (F.lit(ord_).alias("ord"), F.lit(level).alias("level"), F.lit(scope).alias("scope"), F.lit(code).alias("code"), n.cast("long").alias("n"))
    return F.when(when, F.struct(*fields, (F.lit("") if detail is None else detail).alias("detail")))


def blocked_reasons() -> Column:
    """How many blocks there are of each reason, the unclassified last; reasons without any are left out."""
    counts = (("mismatch", F.col("n_mismatch")), ("unavailable", F.col("n_unavailable")), ("unclassified", unclassified()))
    return F.array_join(F.array_compact(F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"))) for name, n in counts])), ", ")


def alerts_of(settings: Settings = DEFAULT) -> Column:
    """Alerts in order as an array; a notice that all is well only where there is none."""
    c = F.col
    stale = c("has_snapshot") & (c("age_hours") > settings.stale_hours)
    rules = [
        _alert(c("event_result") == "failed", 1, "error", "run", "run_failed", c("event_listing_failures")),
        _alert(~c("has_snapshot"), 2, "error", "run", "snapshot_missing", F.lit(0)),
        _alert(F.coalesce(stale, F.lit(False)), 3, "warning", "run", "snapshot_stale", F.floor(F.coalesce("age_hours", F.lit(0.0)))),
        _alert(c("listing_failures") > 0, 4, "warning", "run", "listing_failures", c("listing_failures")),
        _alert(c("n_blocked") > 0, 5, "success", "run", "blocked_skipped", c("n_blocked"), blocked_reasons()),
        _alert(c("n_current_errors") > 0, 6, "warning", "task", "unresolved_now", c("n_current_errors")),
        _alert(c("n_backlog") > 0, 7, "info", "backlog", "backlog", c("n_backlog")),
        _alert(c("n_ignored") > 0, 8, "info", "backlog", "ignored", c("n_ignored")),
        _alert((c("n_partials") > 0) & ~c("active"), 9, "warning", "run", "partials_left", c("n_partials")),
        _alert(c("n_manifest_failures") > 0, 10, "error", "run", "downloads_failed", c("n_manifest_failures")),
    ]
    found = F.array_compact(F.array(*rules))
    clear = F.array(_alert(F.lit(True), 11, "success", "run", "all_clear", F.lit(0)))
    return F.when(F.size(found) > 0, found).otherwise(clear)


def unclassified() -> Column:
    return F.greatest(F.lit(0), F.col("n_blocked") - F.col("n_mismatch") - F.col("n_unavailable"))


def run_status() -> Column:
    """active, ready or attention; reads the column ``alerts``."""
    c = F.col
    attention = F.exists(c("alerts"), lambda a: (a["scope"] != "backlog") & a["level"].isin("warning", "error"))
    handled = (c("n_items") == 0) | (c("n_downloaded") + c("n_blocked") + c("n_ignored") == c("n_items"))
    ready = ((c("event_task") == "crawl") & (c("event_result") == "success") & ~attention) | ((c("event_result") == "success") & ~attention & handled) | ((c("event_result") == "none") & (c("n_items") > 0) & handled & ~attention)
    return F.when(c("active"), F.lit("active")).when(ready, F.lit("ready")).otherwise(F.lit("attention"))


def completed_today() -> Column:
    """A property of today's successful run, not of the latest one: its own listing failures count."""
    c = F.col
    return c("today_success") & (c("today_listing_failures") == 0) & ~c("active") & (c("n_partials") == 0) & (c("n_current_errors") == 0) & (c("n_manifest_failures") == 0)


def _stage(ord_: int, name: str, status: Column | str, value: Column) -> Column:
    return F.struct(F.lit(ord_).alias("ord"), F.lit(name).alias("name"), (F.lit(status) if isinstance(status, str) else status).alias("status"), value.cast("long").alias("value"))


def stages_of() -> Column:
    """Four stages in one of four forms: failed crawl, nothing to do, crawl, inventory."""
    c, zero = F.col, F.lit(0)
    tried = c("event_new") + c("event_retry")
    parsed = F.greatest(zero, tried - c("event_blocked") - c("event_failed"))
    stored = c("event_downloaded") + c("event_present")
    att, wait, done = F.lit("attention"), F.lit("waiting"), F.lit("done")
    failed = F.array(
        _stage(1, "listing", "attention", c("event_raw_links")),
        _stage(2, "dedupe", F.when(c("event_raw_links") > 0, done).otherwise(wait), c("event_unique")),
        _stage(3, "resolve", F.when(tried > 0, att).otherwise(wait), parsed),
        _stage(4, "store", F.when(stored > 0, att).otherwise(wait), stored),
    )
    idle = F.array(_stage(1, "listing", "done", c("event_raw_links")), _stage(2, "dedupe", "done", c("event_unique")), _stage(3, "resolve", "done", zero), _stage(4, "store", "done", zero))
    state = F.when((c("event_result") == "attention") | (c("event_failed") > 0), att).otherwise(done)
    crawl = F.array(
        _stage(1, "listing", F.when(c("event_listing_failures") > 0, att).otherwise(done), c("event_raw_links")),
        _stage(2, "dedupe", "done", c("event_unique")),
        _stage(3, "resolve", state, parsed),
        _stage(4, "store", state, stored),
    )
    active = F.lit("active")
    resolved, stored_all = c("n_resolved") + c("n_blocked") + c("n_ignored"), c("n_downloaded") + c("n_blocked") + c("n_ignored")
    some = c("n_items") > 0
    inventory = F.array(
        _stage(1, "listing", F.when(c("active"), active).when(c("raw_links") > 0, done).otherwise(wait), c("raw_links")),
        _stage(2, "dedupe", F.when(c("active"), active).when(some, done).otherwise(wait), c("n_items")),
        _stage(3, "resolve", F.when(c("active"), active).when(some & (resolved == c("n_items")), done).otherwise(att), c("n_resolved")),
        _stage(4, "store", F.when(some & (stored_all == c("n_items")), done).when(c("active"), active).when(c("n_partials") > 0, att).otherwise(wait), c("n_downloaded")),
    )
    is_crawl = c("event_task") == "crawl"
    return F.when(is_crawl & (c("event_result") == "failed") & ~c("active"), failed).when(c("no_work"), idle).when(is_crawl & c("event_result").isin("success", "attention"), crawl).otherwise(inventory)


def snapshot(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Facts with ``alerts``, ``stages``, ``run_status`` and ``completed_today``."""
    # Alerts are computed once; a generator keeps them from being repeated inside the status.
    base = facts(df)
    held = base.select(*base.columns, F.inline(F.array(F.struct(alerts_of(settings).alias("alerts")))))
    return held.withColumns({"stages": stages_of(), "run_status": run_status(), "completed_today": completed_today()})


def shown_progress(current: DataFrame, last: DataFrame) -> DataFrame:
    """The gauge in work if there is one, else the last archived one."""
    live = current.withColumn("shown", F.lit("current"))
    old = last.filter(F.col("stage").isin("complete", "failed", "cancelled") & (F.col("total") > 0)).withColumn("shown", F.lit("last"))
    both = live.unionByName(old, allowMissingColumns=True).withColumn("_o", F.when(F.col("shown") == "current", 0).otherwise(1))
    return both.orderBy("_o").limit(1).drop("_o")
