"""Decision rules over single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from .text import blank, tolerant_int
from .urls import asset_id


def consistent_asset(asset: Column, thumbnail_url: Column) -> Column:
    """Whether a record's asset is the one that its thumbnail shows."""
    return ~blank(asset) & (asset == asset_id(thumbnail_url))


def card_score(asset: Column, thumbnail_url: Column, tracking_class: Column, title: Column, duration: Column, settings: Settings = DEFAULT) -> Column:
    w = settings.score_weights
    parts = ((consistent_asset(asset, thumbnail_url), "consistent"), (tracking_class == settings.preferred_class, "preferred"), (~blank(title), "title"), (~blank(thumbnail_url), "thumbnail"), (~blank(duration), "duration"))
    out = F.lit(0)
    for flag, name in parts:
        out = out + F.when(flag, w[name]).otherwise(0)
    return out


def timestamp_of(text: Column) -> Column:
    """ISO text with either form of offset; null if it does not parse."""
    return F.try_to_timestamp(text)


def epoch_of(text: Column) -> Column:
    return F.unix_timestamp(timestamp_of(text))


def hours_since(text: Column, now: Column) -> Column:
    """Age in hours, not below 0; null for bad times."""
    hours = (F.unix_timestamp(now) - epoch_of(text)) / 3600.0
    return F.when(hours.isNotNull(), F.greatest(F.lit(0.0), hours))


def stale(text: Column, now: Column, max_seconds: Column) -> Column:
    return F.coalesce((F.unix_timestamp(now) - epoch_of(text)) > max_seconds, F.lit(True))


LOG_NAME = r"\A(?:repair-)?download-(\d{8})-(\d{6})\.log\z"


def log_time(file_name: Column) -> Column:
    """Time in a result log's name, in the session's zone; null for other names."""
    return F.try_to_timestamp(F.concat(F.regexp_extract(file_name, LOG_NAME, 1), F.regexp_extract(file_name, LOG_NAME, 2)), F.lit("yyyyMMddHHmmss"))


def day_label(day: Column) -> Column:
    return F.date_format(day, "MM/dd")


def task_type(explicit: Column) -> Column:
    return F.when(explicit.isin("crawl", "repair"), explicit).otherwise(F.lit("crawl"))


def json_zero(x: Column) -> Column:
    """Whether a value given as JSON text equals 0: a number or ``false``, not a text of digits."""
    number = x.rlike(r"\A-?\d") & (x.try_cast("double") == 0)
    return F.coalesce(number | (x == "false"), F.lit(False))


def result_status(explicit: Column, crawl_exit: Column, download_exit: Column, listing_failures: Column) -> Column:
    """Explicit status, else by exit codes, given as JSON text: failures of pages leave a good run as attention."""
    fine = json_zero(crawl_exit) & (download_exit.isNull() | json_zero(download_exit))
    derived = F.when(fine, F.when(tolerant_int(listing_failures) > 0, F.lit("attention")).otherwise(F.lit("success"))).otherwise(F.lit("failed"))
    return F.when(explicit.isin("success", "attention", "failed"), explicit).otherwise(derived)


def run_result(crawl_exit: Column, download_exit: Column, listing_failures: Column, resolve_failures: Column, challenges: Column) -> Column:
    """Status of a run from what it counted."""
    failed = (crawl_exit != 0) | (F.coalesce(download_exit, F.lit(0)) != 0)
    return F.when(failed, F.lit("failed")).when((listing_failures > 0) | (resolve_failures > 0) | (challenges > 0), F.lit("attention")).otherwise(F.lit("success"))


def repair_result(download_exit: Column, unresolved: Column, failed: Column) -> Column:
    return F.when((download_exit == 0) & (unresolved == 0) & (failed == 0), F.lit("success")).otherwise(F.lit("failed"))


#: Kinds by the class of error that ended a download.
CAUSES = {"challenge": "auth_challenge", "mismatch": "media_mismatch", "unavailable": "media_unavailable"}


def failure_kind(cause: Column, error: Column, settings: Settings = DEFAULT) -> Column:
    """Kind of a download's failure: by the class of its cause, else by the phrase of older texts."""
    out = F.when(F.contains(F.coalesce(error, F.lit("")), F.lit(settings.mismatch_phrase)), F.lit("media_mismatch")).otherwise(F.lit("download_error"))
    for name, kind in CAUSES.items():
        out = F.when(cause == name, F.lit(kind)).otherwise(out)
    return out


def blocked_kind(kind: Column, error: Column, settings: Settings = DEFAULT) -> Column:
    """Safe kind of a row: its own, else a mismatch by the text that older rows have, else null."""
    by_text = F.coalesce(F.contains(error, F.lit(settings.mismatch_phrase)), F.lit(False))
    return F.when(kind.isin(*settings.safe_kinds), kind).when(by_text, F.lit("media_mismatch"))


def safe_block(kind: Column, error: Column, settings: Settings = DEFAULT) -> Column:
    """A failure that may be skipped for good: by kind, or by the text that older rows have."""
    return F.coalesce(kind.isin(*settings.safe_kinds), F.lit(False)) | F.coalesce(error.contains(settings.mismatch_phrase), F.lit(False))


def manifest_block_kind(status: Column, kind: Column, error: Column, settings: Settings = DEFAULT) -> Column:
    """Kind under which a manifest row blocks its key, else null: failed rows only for a mismatch."""
    found = blocked_kind(kind, error, settings)
    return F.when((status == "blocked") | ((status == "failed") & (found == "media_mismatch")), found)


def challenge_page(html: Column, settings: Settings = DEFAULT) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    out = F.lit(False)
    for mark in settings.challenge_marks:
        out = out | low.contains(mark)
    return out


def identity_mismatch(expected: Column, observed: Column) -> Column:
    """An expected asset that is not among those observed; missing evidence is no mismatch."""
    return ~blank(expected) & (F.size(observed) > 0) & ~F.array_contains(observed, expected)


def blocked_only(failed: Column, blocked: Column, true_failures: Column) -> Column:
    """Whether a repair left nothing behind but safe blocks."""
    return (blocked > 0) & (true_failures == 0) & (failed <= blocked)


def block_predates(confirmed_at: Column, credential_at: Column) -> Column:
    """Whether a block is older than the credential: an unknown block time counts as older, a blank credential as never."""
    return F.when(blank(credential_at) | epoch_of(credential_at).isNull(), F.lit(False)).otherwise(F.coalesce(epoch_of(confirmed_at) < epoch_of(credential_at), F.lit(True)))


def queue_class(ignored: Column, success: Column, seen: Column, has_media: Column, has_file: Column, new_only: bool = False, has_listing: bool = True) -> Column:
    """What happens to an item, in order of precedence."""
    out = F.when(ignored, F.lit("ignored")).when(success, F.lit("skip"))
    if new_only:
        out = out.when(seen, F.lit("skip"))
    out = out.when(~has_media & seen, F.lit("retry")).when(~has_media, F.lit("new"))
    if has_listing:
        return out.when(~seen & has_file, F.lit("skip")).when(~seen, F.lit("new")).when(~has_file, F.lit("retry")).otherwise(F.lit("skip"))
    return out.when(~seen, F.lit("new")).otherwise(F.lit("skip"))


def coerced_progress(stage: Column, failed: Column, true_failures: Column, blocked: Column) -> Column:
    """(stage, failed): a failed stage is complete when every failure was a safe block."""
    fine = (stage == "failed") & (failed > 0) & (true_failures == 0) & (failed <= blocked)
    return F.struct(F.when(fine, F.lit("complete")).otherwise(F.coalesce(stage, F.lit("downloading"))).alias("stage"), F.when(fine, F.lit(0)).otherwise(failed).alias("failed"))


def archived_progress(stage: Column, total: Column) -> Column:
    """Whether a gauge may become the last progress shown."""
    return stage.isin("complete", "failed", "cancelled") & (total > 0)
