"""The status snapshot straight from ledgers: inventory, outcome ledgers, directories, manifests, history and gauges.

Keys of all ledgers are united with a bit each and joined to the inventory once; what is left are global
aggregates, one row each, which are united and folded into the row of facts that the rules of
:mod:`.snapshot` read. Only that row and lists with a stated limit are small; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.rules import archived_progress, coerced_progress, hours_since, manifest_block_kind, safe_block
from ..functions.text import blank, counter, first_present, html_unescape, percent, present
from ..functions.urls import extension_label
from ..operators import history, inventory, ledger
from ..sources.ledgers import stem
from .snapshot import snapshot


@dataclass(frozen=True)
class Ledgers:
    """What a snapshot is made of; ``snapshot_at`` and ``has_snapshot`` tell of the inventory's own file."""

    items: DataFrame  # ord, key, title, media_url
    success: DataFrame  # key
    ignored: DataFrame  # key
    files: DataFrame  # path, size_bytes, modified_at
    partials: DataFrame  # path, size_bytes
    history: DataFrame  # run events
    downloads: DataFrame  # key, date, bytes
    failures: DataFrame  # ord, viewkey, kind, error
    listing_failures: DataFrame
    manifests: tuple[tuple[float, DataFrame], ...]  # time of writing; ord, viewkey, status, kind, error
    gauges: DataFrame | None = None  # key, bytes_done, bytes_total
    progress: DataFrame | None = None  # of: crawl, download, archived; stage, done, total, failed
    metadata: dict = field(default_factory=dict)
    has_snapshot: bool = True
    snapshot_at: str | None = None
    active: bool = False
    task: str | None = None
    phase: str | None = None
    started_at: str | None = None


def beside(*ones: DataFrame) -> DataFrame:
    """One row of the columns of tables with one row each."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ones)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def titles(items: DataFrame, untitled: str = "untitled") -> DataFrame:
    """(key, title): decoded titles; items without one get a fixed name."""
    return items.select("key", first_present(html_unescape(F.col("title")), F.lit(untitled)).alias("title"))


def with_title(rows: DataFrame, items: DataFrame, fallback: str) -> DataFrame:
    """``rows`` (key, ...) with the ``name`` of their item, or the column ``fallback`` where the inventory has none."""
    return rows.join(titles(items), "key", "left").withColumn("name", F.coalesce("title", fallback)).drop("title")


def recent_files(files: DataFrame, items: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The last files, newest first, under their items' titles; files without an item under their own names."""
    named = files.select(stem(F.col("path")).alias("key"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "size_bytes", "modified_at")
    last = named.orderBy(F.desc("modified_at"), "path").limit(settings.recent_files)
    return with_title(last, items, "file_name").select("name", "file_name", "size_bytes", "modified_at")


def manifest_rows(manifests: tuple[tuple[float, DataFrame], ...], settings: Settings = DEFAULT) -> DataFrame:
    """Rows of all manifests with their ``block`` kind; ``place`` orders them, ``newest`` marks those of the last one that has rows."""
    if not manifests:
        raise ValueError("at least one manifest, if without rows")
    tagged = [rows.select(F.lit(k).alias("of"), F.lit(float(at)).alias("at"), F.col("ord").cast("long").alias("ord"), *[F.col(c).cast("string").alias(c) for c in ("viewkey", "status", "kind", "error")]) for k, (at, rows) in enumerate(manifests)]
    rows = reduce(DataFrame.unionByName, tagged)
    rows = rows.select("*", F.struct("of", "ord").alias("place"), manifest_block_kind(F.col("status"), F.col("kind"), F.col("error"), settings).alias("block"))
    last = rows.agg(F.max(F.struct("at", (-F.col("of")).alias("of")))["of"].alias("last")).select((-F.col("last")).alias("of"), F.lit(True).alias("newest"))
    return rows.join(last, "of", "left").withColumn("newest", F.coalesce("newest", F.lit(False)))


def marked_items(given: Ledgers, manifest: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The inventory with a boolean for each state; ``now`` marks what the resolver's failures name."""
    keyed = given.failures.filter(~blank(F.col("viewkey"))).withColumnRenamed("viewkey", "key")
    resolver = keyed.filter(safe_block(F.col("kind"), F.col("error"), settings))
    blocks = manifest.filter(F.col("block").isNotNull() & ~blank(F.col("viewkey"))).select(F.col("viewkey").alias("key"))
    stored = given.files.select(stem(F.col("path")).alias("key"))
    return inventory.states(given.items, given.success, stored, given.ignored, resolver.select("key"), blocks, keyed.select("key"))


def event_facts(events: DataFrame, day: Column) -> DataFrame:
    """One row with the last event, the last of each task, the last crawl that gave data and the good run of ``day``."""
    e = history.described(events).filter(~blank(F.col("timestamp")))
    is_crawl = F.col("task") == "crawl"
    short = F.struct("line_no", "timestamp", "raw")
    return e.agg(
        F.max(F.struct("line_no", "timestamp", "startedAt", "durationSeconds", "task", "result", "raw")).alias("last"),
        F.max(F.when(is_crawl, short)).alias("crawl"),
        F.max(F.when(F.col("task") == "repair", short)).alias("repair"),
        F.max(F.when(is_crawl & F.col("result").isin("success", "attention"), short)).alias("complete"),
        F.max(F.when(history.good_day(day), short)).alias("today"),
    )


def facts_of(given: Ledgers, now: str, settings: Settings = DEFAULT) -> DataFrame:
    """One row of facts, more than the rules need: the counters of overview and result are among them."""
    at = F.lit(now).cast("timestamp")
    day = F.to_date(at)
    zero = F.lit(0).cast("long")
    manifest = manifest_rows(given.manifests, settings)
    items = marked_items(given, manifest, settings)
    n = lambda when, name: F.count_if(when).alias(name)
    c = F.col
    counted = items.agg(
        F.count(F.lit(1)).alias("n_listed"), n(c("resolved"), "n_resolved"), n(c("unresolved"), "n_unresolved"), n(c("ignored"), "n_ignored"), n(c("blocked"), "n_blocked"),
        n(c("completed") & ~c("ignored"), "n_downloaded"), n(c("unresolved") & c("now"), "n_failed_now"), n(c("current_error"), "n_errors_now"),
    )
    failures = given.failures.select("ord", F.col("viewkey").alias("key"), "kind", "error")
    confirmed = manifest.filter("block is not null").select(c("place").alias("ord"), c("viewkey").alias("key"), c("block").alias("kind"))
    kinds = inventory.blocked_kinds(failures, confirmed, items.filter("blocked"), settings).agg(n(c("kind") == "media_mismatch", "n_mismatch"), n(c("kind") == "media_unavailable", "n_unavailable"))

    key = F.coalesce("viewkey", F.lit("")).alias("key")
    blocks = confirmed.filter(~blank(c("key"))).select("key").distinct()
    failed = manifest.filter("newest and status = 'failed'").select(key).join(blocks, "key", "left_anti")
    settled = items.filter("completed or blocked").select("key")
    lost = failed.join(settled, "key", "left_anti").agg(F.count(F.lit(1)).alias("n_manifest_failures"))

    is_today = F.to_date("modified_at") == day
    files = given.files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size_bytes"), zero).alias("file_bytes"), n(is_today, "n_files_today"), F.coalesce(F.sum(F.when(is_today, c("size_bytes"))), zero).alias("file_bytes_today"))
    got = given.downloads.agg(F.count(F.lit(1)).alias("n_ingested"), F.coalesce(F.sum("bytes"), zero).alias("ingested_bytes"), n(c("date") == day, "n_ingested_today"), F.coalesce(F.sum(F.when(c("date") == day, c("bytes"))), zero).alias("ingested_bytes_today"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = beside(
        counted, kinds, lost, files, got, count(given.partials, "n_partials"), count(given.listing_failures, "listing_failures"),
        count(blocks, "n_manifest_blocked"), count(failed, "n_true_failures"), event_facts(given.history, day),
    )

    meta = {k: int(given.metadata.get(k) or 0) for k in ("unique_videos", "raw_detail_links", "duplicates_removed", "known_videos_skipped")}
    unique = F.lit(meta["unique_videos"]).cast("long") if meta["unique_videos"] else c("n_listed")
    row = row.select("*", unique.alias("n_items"), F.coalesce("last.task", F.lit("crawl")).alias("event_task"), F.coalesce("last.result", F.lit("none")).alias("event_result"))
    raw = F.lit(meta["raw_detail_links"]).cast("long") if meta["raw_detail_links"] else c("n_items")
    row = row.withColumn("raw_links", raw)
    duplicates = F.lit(meta["duplicates_removed"]).cast("long") if meta["duplicates_removed"] else F.greatest(zero, c("raw_links") - c("n_items"))
    event = lambda name, fallback=0: counter(c("last.raw"), name, fallback)
    is_crawl = c("event_task") == "crawl"
    gave = is_crawl & c("event_result").isin("success", "attention")
    fields = F.coalesce(F.json_object_keys("last.raw"), F.array().cast("array<string>"))
    told = F.array_contains(fields, "newVideos") & F.array_contains(fields, "retryVideos")
    row = row.withColumns({
        "duplicates": duplicates, "no_work": is_crawl & (c("event_result") == "success") & told & (event("newVideos") == 0) & (event("retryVideos") == 0),
        "n_current_errors": F.when(gave, c("n_errors_now")).otherwise(zero), "n_backlog": c("n_unresolved") - F.when(gave, c("n_failed_now")).otherwise(zero),
    })
    handled = c("n_downloaded") + c("n_blocked") + c("n_ignored")
    since = F.coalesce(present(c("complete.timestamp")), F.lit(given.snapshot_at).cast("string"))
    return row.select(
        "*", F.lit(given.has_snapshot).alias("has_snapshot"), F.lit(given.active).alias("active"), hours_since(since, at).alias("age_hours"), c("today").isNotNull().alias("today_success"),
        counter(c("today.raw"), "listingFailures").alias("today_listing_failures"), event("listingFailures").alias("event_listing_failures"),
        event("rawLinks", c("raw_links")).alias("event_raw_links"), event("uniqueVideos", c("n_items")).alias("event_unique"), event("skippedVideos", meta["known_videos_skipped"]).alias("event_skipped"),
        *[event(name).alias(to) for name, to in (("newVideos", "event_new"), ("retryVideos", "event_retry"), ("blockedVideos", "event_blocked"), ("failedVideos", "event_failed"), ("downloadedVideos", "event_downloaded"), ("alreadyPresentVideos", "event_present"), ("duplicateVideos", "event_duplicate"), ("downloadedBytes", "event_bytes"), ("autoRetryAttempts", "event_retries"), ("autoRetriedVideos", "event_retried"), ("autoRecoveredVideos", "event_recovered"))],
        event("ignoredVideos", F.when(c("no_work"), c("n_ignored")).otherwise(zero)).alias("event_ignored"), event("blockedVideos", c("n_blocked")).alias("shown_blocked"),
        event("listingFailures", F.when(is_crawl, c("listing_failures")).otherwise(zero)).alias("shown_listing_failures"),
        F.greatest(zero, c("n_items") - handled).alias("n_pending"),
        F.when(c("n_items") > 0, percent(c("n_downloaded"), F.greatest(F.lit(1).cast("long"), c("n_items") - c("n_ignored")))).otherwise(0.0).alias("download_rate"),
        F.coalesce(present(c("crawl.timestamp")), F.lit(given.snapshot_at).cast("string")).alias("latest_crawl_at"), c("repair.timestamp").alias("latest_repair_at"),
        F.coalesce("last.startedAt", "last.timestamp").alias("event_started_at"), c("last.timestamp").alias("event_finished_at"), c("last.durationSeconds").alias("event_seconds"), c("today.timestamp").alias("today_at"),
    ).drop("last", "crawl", "repair", "complete", "today", "n_errors_now", "n_failed_now")


def shown(row: DataFrame, given: Ledgers) -> DataFrame:
    """The row of a snapshot with the progress to show: of the task in work, else the last one archived.

    A failed gauge of downloads counts as complete where all its failures are confirmed blocks.
    """
    kind = "of string, stage string, done long, total long, failed long"
    gauges = given.progress if given.progress is not None else row.sparkSession.createDataFrame([], kind)
    one = lambda of: gauges.filter(F.col("of") == of).agg(F.max(F.struct("stage", "done", "total", "failed")).alias(of))
    row = beside(row, one("crawl"), one("download"), one("archived"))
    ended = ("failed", "cancelled")

    def told(of: str) -> Column:
        g = F.col(of)
        state = coerced_progress(g["stage"], F.coalesce(g["failed"], F.lit(0)), F.col("n_true_failures"), F.col("n_manifest_blocked"))
        return F.when(g.isNotNull(), F.struct(state["stage"].alias("stage"), g["done"].alias("done"), g["total"].alias("total"), state["failed"].cast("long").alias("failed")))

    crawl = F.struct(F.col("crawl")["stage"].alias("stage"), F.col("crawl")["done"].alias("done"), F.col("crawl")["total"].alias("total"), F.lit(0).cast("long").alias("failed"))
    none = F.struct(F.lit(given.phase or "crawling").alias("stage"), *[F.lit(0).cast("long").alias(k) for k in ("done", "total", "failed")])
    live = F.when(F.col("crawl").isNotNull() & ~F.coalesce(F.col("crawl")["stage"].isin(*ended), F.lit(False)), crawl)
    live = live.when(F.col("download").isNotNull() & ~F.coalesce(F.col("download")["stage"].isin("complete", *ended), F.lit(False)), told("download")).otherwise(none)
    last = F.when(F.coalesce(archived_progress(F.col("download")["stage"], F.col("download")["total"]), F.lit(False)), told("download"))
    last = last.when(F.coalesce(F.col("archived")["stage"].isin("complete", *ended), F.lit(False)), told("archived"))
    return row.withColumn("progress", F.when(F.lit(given.active), live).otherwise(last)).drop("crawl", "download", "archived")


def partial_keys(partials: DataFrame) -> DataFrame:
    """(key, size_bytes, file_name) of files that end in ``.part`` behind their own extension."""
    name = F.element_at(F.split("path", "/"), -1)
    return partials.select(stem(F.regexp_replace(name, r"\.part\z", "")).alias("key"), "size_bytes", name.alias("file_name"))


def snapshot_of(given: Ledgers, now: str, settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """The snapshot (one row) and its lists: daily, types, recent, active, pending."""
    facts = shown(facts_of(given, now, settings), given)
    items = marked_items(given, manifest_rows(given.manifests, settings), settings)
    partials = partial_keys(given.partials)
    none = given.items.sparkSession.createDataFrame([], "key string, bytes_done long, bytes_total long")
    gauges = given.gauges if given.gauges is not None else none
    open_ = items.filter("resolved and not completed and not ignored")
    resumable = partials.join(open_.select("key"), "key", "left_semi")
    waiting = open_.join(partials.select("key").unionByName(gauges.select("key")).distinct(), "key", "left_anti")
    at_work = inventory.active_downloads(partials, gauges, given.active)
    return {
        "snapshot": snapshot(facts, settings),
        "daily": ledger.day_trend(given.downloads, now[:10], settings.history_days),
        "types": given.files.groupBy(extension_label(F.col("path")).alias("name")).agg(F.count(F.lit(1)).alias("count")),
        "recent": recent_files(given.files, given.items, settings),
        "active": with_title(at_work, given.items, "key"),
        "pending": with_title(inventory.pending_list(resumable, waiting, settings.pending_rows, given.active), given.items, "key"),
    }
