"""A run's event from what it left behind, and the bounds of a run's arguments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.rules import repair_result, run_result, safe_block
from ..functions.text import blank, tolerant_int
from .ledger_snapshot import beside

# Least and greatest value of each argument.
BOUNDS = {
    "pages": (1, 20), "delay": (0.5, 60), "timeout": (1, 120), "listing_concurrency": (1, 5), "resolve_concurrency": (1, 16), "media_rechecks": (1, 3), "retries": (0, 10),
    "limit": (0, None), "download_delay": (0, 60), "max_bytes": (1 << 20, None), "concurrency": (1, 16), "refresh_retries": (0, 5), "route_probe_bytes": (64 << 10, 16 << 20), "route_probe_timeout": (1, 30),
}


def out_of_bounds(name: Column, value: Column) -> Column:
    """Whether an argument lies outside its bounds; unknown names and missing numbers do."""
    out = F.lit(True)
    for known, (low, high) in BOUNDS.items():
        inside = (value >= low) if high is None else value.between(low, high)
        out = F.when(name == known, ~F.coalesce(inside, F.lit(False))).otherwise(out)
    return out


def check_arguments(**given: float) -> None:
    for name, value in given.items():
        low, high = BOUNDS[name]
        if value < low or (high is not None and value > high):
            raise ValueError(f"{name} must lie between {low} and {high}" if high is not None else f"{name} must be at least {low}")


@dataclass(frozen=True)
class Run:
    """What is known of a run beside its rows. ``progress`` holds the crawl's last gauge, which stands in for the
    metadata of the queue where the crawl failed."""

    crawl_exit: int
    download_exit: int | None
    download_requested: bool
    trigger: str
    started_at: str
    finished_at: str
    pages: int = 0
    sources: int = 0
    metadata: dict | None = None
    progress: dict | None = None


def summarise_run(run: Run, manifest: DataFrame, failures: DataFrame, listing_failures: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One event row of a run. All its rows are counted in one aggregate.

    ``manifest``: viewkey, status, bytes, autoRetries; ``failures``: viewkey, kind, error; ``listing_failures``: kind.
    """
    nothing = F.lit(None).cast("string")

    def tagged(df: DataFrame, tag: str) -> DataFrame:
        have = set(df.columns)
        return df.select(F.lit(tag).alias("of"), *[(F.col(c).cast("string") if c in have else nothing).alias(c) for c in ("viewkey", "status", "kind", "error", "bytes", "autoRetries")])

    rows = tagged(manifest, "manifest").unionByName(tagged(failures, "failure")).unionByName(tagged(listing_failures, "listing"))
    is_manifest, is_failure, is_listing = (F.col("of") == k for k in ("manifest", "failure", "listing"))
    s, retries = F.col("status"), tolerant_int(F.col("autoRetries"))
    safe = safe_block(F.col("kind"), F.col("error"), settings)
    blocked = ((is_failure & safe) | (is_manifest & (s == "blocked"))) & ~blank(F.col("viewkey"))
    good = is_manifest & s.isin("downloaded", "skipped", "duplicate")
    zero = F.lit(0).cast("long")
    counted = rows.agg(
        *[F.count_if(is_manifest & (s == k)).alias(n) for k, n in (("downloaded", "downloadedVideos"), ("skipped", "alreadyPresentVideos"), ("duplicate", "duplicateVideos"), ("failed", "manifest_failed"))],
        F.count_if(is_failure & ~safe).alias("resolver_failed"),
        F.count_distinct(F.when(blocked, F.col("viewkey"))).alias("blockedVideos"),
        F.count_if(is_listing).alias("listing_rows"),
        F.count_if((is_failure | is_listing) & (F.col("kind") == "auth_challenge")).alias("authChallenges"),
        F.coalesce(F.sum(F.when(is_manifest & (s == "downloaded"), tolerant_int(F.col("bytes")))), zero).alias("downloadedBytes"),
        F.coalesce(F.sum(F.when(is_manifest, retries)), zero).alias("autoRetryAttempts"),
        F.count_if(is_manifest & (retries > 0)).alias("autoRetriedVideos"),
        F.count_if(good & (retries > 0)).alias("autoRecoveredVideos"),
    )
    meta, progress, lost = run.metadata or {}, run.progress or {}, run.crawl_exit != 0

    def number(name: str, gauge: str | None = None) -> Column:
        value = progress.get(gauge) if lost and gauge else meta.get(name)
        return F.lit(int(value or 0)).cast("long")

    listing = F.lit(int(progress["listingFailures"])).cast("long") if lost and progress.get("listingFailures") else F.col("listing_rows")
    auth = F.lit(bool(progress.get("authFailure"))) | (F.col("authChallenges") > 0)
    status = run_result(F.lit(run.crawl_exit), F.lit(run.download_exit).cast("int"), listing, F.col("resolver_failed"), auth.cast("int"))
    seconds = F.round(F.to_timestamp(F.lit(run.finished_at)).cast("double") - F.to_timestamp(F.lit(run.started_at)).cast("double"), 1)
    return counted.select(
        F.lit(run.finished_at).alias("timestamp"), F.lit(run.started_at).alias("startedAt"), seconds.alias("durationSeconds"), F.lit("crawl").alias("taskType"), F.lit(run.trigger).alias("trigger"),
        auth.alias("authFailure"), "authChallenges", F.lit(settings.detector_version).alias("authDetectorVersion"), status.alias("resultStatus"), F.lit(run.crawl_exit).alias("crawlExitCode"), F.lit(run.download_exit).cast("int").alias("downloadExitCode"), F.lit(run.download_requested).alias("downloadRequested"),
        F.lit(run.pages).alias("pages"), F.lit(run.sources).alias("sources"), listing.alias("listingFailures"),
        number("raw_detail_links", "rawLinks").alias("rawLinks"), number("unique_videos", "uniqueVideos").alias("uniqueVideos"), number("known_videos_skipped", "skippedVideos").alias("skippedVideos"),
        number("new_videos").alias("newVideos"), number("retry_videos").alias("retryVideos"), number("detail_pages_requested").alias("detailPagesRequested"), number("ignored_videos").alias("ignoredVideos"),
        "downloadedVideos", "alreadyPresentVideos", "duplicateVideos", "blockedVideos", (F.col("manifest_failed") + F.col("resolver_failed")).alias("failedVideos"),
        "downloadedBytes", "autoRetryAttempts", "autoRetriedVideos", "autoRecoveredVideos",
    )


def repair_event(run: Run, attempted: DataFrame, manifest: DataFrame, failures: DataFrame, items: DataFrame, ignored: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One event row of a repair: candidates tried, what became of them, and whether anything but safe blocks is left.

    ``attempted``: key; ``manifest``: viewkey, status, bytes, autoRetries; ``failures``: viewkey, kind, error;
    ``items`` and ``ignored``: key. Resolver failures that may be skipped for good and blocked downloads count as
    keys, all other failures as rows.
    """
    said = summarise_run(run, manifest, failures, failures.limit(0).select("kind"), settings)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    tried, passed = count(attempted, "n_tried"), count(items.select("key").join(ignored.select("key").distinct(), "key", "left_semi"), "n_ignored")
    left = failures.agg(F.count_if(~safe_block(F.col("kind"), F.col("error"), settings)).alias("n_unresolved"))
    failed = manifest.agg(F.count_if(F.col("status") == "failed").alias("n_failed"))
    row = beside(said, tried, passed, left, failed)
    exit_code = F.lit(run.download_exit).cast("int")
    result = repair_result(F.coalesce(exit_code, F.lit(-1)), F.col("n_unresolved"), F.col("n_failed"))
    zero = F.lit(0).cast("long")
    return row.select(
        "timestamp", "startedAt", "durationSeconds", F.lit("repair").alias("taskType"), result.alias("resultStatus"), F.when(result == "success", 0).otherwise(1).alias("crawlExitCode"), exit_code.alias("downloadExitCode"), F.lit(False).alias("downloadRequested"),
        F.col("n_tried").alias("rawLinks"), F.col("n_tried").alias("uniqueVideos"), F.col("n_ignored").alias("skippedVideos"), F.col("n_ignored").alias("ignoredVideos"), zero.alias("newVideos"), F.col("n_tried").alias("retryVideos"),
        "downloadedVideos", "alreadyPresentVideos", "duplicateVideos", "blockedVideos", "failedVideos", "downloadedBytes", "autoRetryAttempts", "autoRetriedVideos", "autoRecoveredVideos",
    )
