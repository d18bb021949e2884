"""Queue selection: history backfill, ledger joins, classification, repair candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.rules import block_predates, queue_class, safe_block
from ..functions.text import blank, first_present
from ..functions.urls import asset_id
from .inventory import bit_flags
from .ranking import first_per

_BACKFILL = ("title", "thumbnail_url", "duration", "media_url", "resolved_at")


def flag(df: DataFrame, keys: DataFrame, name: str, on: str = "key") -> DataFrame:
    """``df`` with a boolean column: whether its key is among ``keys``."""
    return df.join(keys.select(F.col("key").alias(on)).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def backfilled(items: DataFrame, history: DataFrame) -> DataFrame:
    """Blank fields filled from history; assets are not. ``seen`` says whether history has the key."""
    old = history.select("key", *[F.col(c).alias(f"_h_{c}") for c in _BACKFILL], F.lit(True).alias("seen"))
    out = items.join(old, "key", "left")
    return out.withColumns({c: first_present(F.col(c), F.col(f"_h_{c}")) for c in _BACKFILL} | {"seen": F.coalesce("seen", F.lit(False))}).drop(*[f"_h_{c}" for c in _BACKFILL])


def classified(items: DataFrame, history: DataFrame, success: DataFrame, ignored: DataFrame, files: DataFrame | None, new_only: bool = False) -> DataFrame:
    """Items with ``queue_class``; ignored ones lose their media fields after the backfill."""
    sets = [(ignored, "is_ignored"), (success, "is_success")]
    out = bit_flags(backfilled(items, history), sets + ([(files, "has_file")] if files is not None else []))
    out = out if files is not None else out.withColumn("has_file", F.lit(False))
    state = queue_class(F.col("is_ignored"), F.col("is_success"), F.col("seen"), ~blank(F.col("media_url")), F.col("has_file"), new_only, files is not None)
    cleared = {c: F.when(F.col("is_ignored"), F.lit("")).otherwise(F.col(c)) for c in ("media_url", "resolved_at")}
    return out.withColumn("queue_class", state).withColumns(cleared)


def queue_counts(rows: DataFrame) -> DataFrame:
    """Items by what happens to them; ignored ones also count as skipped."""
    c = F.col("queue_class")
    return rows.agg(*[F.count_if(c.isin(*k)).alias(n) for k, n in ((("new",), "n_new"), (("retry",), "n_retry"), (("skip", "ignored"), "n_skipped"), (("ignored",), "n_ignored"))])


def matching_blocks(items: DataFrame, blocked: DataFrame, success: DataFrame, credential_at: str = "", settings: Settings = DEFAULT) -> DataFrame:
    """Blocks that still hold for listed items: same asset as far as known, not older than the credential, no success.

    The listed asset is that of the thumbnail; the time of a block is when it was last seen, or first.
    Kinds that are not safe read as a mismatch, and blank texts as the usual one.
    """
    b = blocked.alias("b")
    i = items.select("key", asset_id(F.col("thumbnail_url")).alias("listed_asset"))
    differ = ~blank(F.col("listed_asset")) & ~blank(F.col("b.expected_asset")) & (F.col("listed_asset") != F.col("b.expected_asset"))
    older = block_predates(first_present(F.col("b.last_seen_at"), F.col("b.first_seen_at")), F.lit(credential_at))
    kind = F.when(F.col("b.kind").isin(*settings.safe_kinds), F.col("b.kind")).otherwise(F.lit("media_mismatch"))
    named = {"kind": kind, "error": first_present(F.col("b.error"), F.lit(settings.unavailable_text))}
    out = i.join(b, (i["key"] == F.col("b.key")) & ~differ & ~older).select(*[named.get(c, F.col(f"b.{c}")).alias(c) for c in blocked.columns], "listed_asset")
    return out.join(success.select("key"), "key", "left_anti")


def pruned_blocks(blocked: DataFrame, success: DataFrame) -> DataFrame:
    return blocked.join(success.select("key"), "key", "left_anti")


def repair_candidates(items: DataFrame, completed: DataFrame, blocked: DataFrame, retryable: DataFrame, ignored: DataFrame) -> DataFrame:
    """Items with a key that are not done, blocked for good or ignored, first row of each key."""
    shut = blocked.select("key").join(retryable.select("key"), "key", "left_anti")
    out = items.filter(~blank(F.col("key")))
    for keys in (completed, shut, ignored):
        out = out.join(keys.select("key"), "key", "left_anti")
    return first_per(out, ["key"], ["ord"])


def union_media(items: DataFrame, resolved: DataFrame, safe_failed: DataFrame) -> DataFrame:
    """Media fields after an outcome: blocked ones cleared, resolved ones replaced."""
    new = resolved.select("key", F.col("media_url").alias("_m"), F.col("resolved_at").alias("_r"))
    out = flag(items.join(new, "key", "left"), safe_failed, "_cleared")
    for c, n in (("media_url", "_m"), ("resolved_at", "_r")):
        out = out.withColumn(c, F.when(F.col("_cleared"), F.lit("")).otherwise(first_present(F.col(n), F.col(c))))
    return out.drop("_m", "_r", "_cleared")


def safe_failures(failures: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return failures.filter(safe_block(F.col("kind"), F.col("error"), settings))
