"""Set algebra over the inventory in one pass, counters and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.rules import blocked_kind
from ..functions.text import blank

STATES = ("completed", "ignored", "resolved", "unresolved", "blocked", "current_error", "backlog")


def bit_flags(items: DataFrame, sets: list[tuple[DataFrame, str]]) -> DataFrame:
    """``items`` with a boolean for each key set: the sets are united with a bit each, summed up by key and joined once."""
    bits = [keys.select("key", F.lit(1 << k).alias("bit")) for k, (keys, _) in enumerate(sets)]
    one = bits[0]
    for other in bits[1:]:
        one = one.unionByName(other)
    mask = F.coalesce("_mask", F.lit(0))
    out = items.join(one.groupBy("key").agg(F.bit_or("bit").alias("_mask")), "key", "left")
    return out.withColumns({name: mask.bitwiseAND(F.lit(1 << k)) > 0 for k, (_, name) in enumerate(sets)}).drop("_mask")


def states(items: DataFrame, success: DataFrame, files: DataFrame, ignored: DataFrame, resolver_blocked: DataFrame, manifest_blocked: DataFrame, attempted_now: DataFrame | None = None) -> DataFrame:
    """Items with a boolean for each set they are in; blocked ones that were not tried now are still backlog."""
    sets = [(success, "in_success"), (files, "has_file"), (ignored, "is_ignored"), (resolver_blocked, "by_resolver"), (manifest_blocked, "by_manifest")]
    out = bit_flags(items, sets + ([(attempted_now, "now")] if attempted_now is not None else []))
    out = out if attempted_now is not None else out.withColumn("now", F.lit(False))
    c = F.col
    out = out.withColumn("completed", c("in_success") | c("has_file"))
    out = out.withColumn("resolved", (~blank(c("media_url")) | c("completed")) & ~c("is_ignored"))
    out = out.withColumn("unresolved", ~c("resolved") & ~c("is_ignored"))
    out = out.withColumn("blocked", (c("unresolved") & c("by_resolver")) | (c("by_manifest") & ~c("is_ignored")))
    open_ = c("unresolved") & ~c("blocked")
    return out.withColumns({"current_error": open_ & c("now"), "backlog": c("unresolved") & ~c("now"), "ignored": c("is_ignored")})


def overview(marked: DataFrame) -> DataFrame:
    """Counters of the inventory; a key both blocked and complete is taken off once by the floor of 0."""
    n = {s: F.count_if(F.col(s)) for s in STATES}
    done = F.count_if(F.col("completed") & ~F.col("is_ignored"))
    total = F.count(F.lit(1))
    pending = F.greatest(F.lit(0).cast("long"), total - done - n["blocked"] - n["ignored"])
    share = F.when(total > 0, F.round(100.0 * done / F.greatest(F.lit(1), total - n["ignored"]), 1)).otherwise(F.lit(0.0))
    return marked.agg(total.alias("n_items"), done.alias("n_downloaded"), *[v.alias(f"n_{s}") for s, v in n.items() if s != "completed"], pending.alias("n_pending"), share.alias("percent"))


def link_counts(cards: DataFrame, source: str = "source_idx") -> DataFrame:
    """Raw links, distinct keys and duplicates by source and overall (null source)."""
    out = cards.groupBy(source, "key").agg(F.count(F.lit(1)).alias("n"))
    per = out.groupBy(source).agg(F.sum("n").alias("raw_links"), F.count(F.lit(1)).alias("unique_items"))
    whole = out.groupBy("key").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_links"), F.count(F.lit(1)).alias("unique_items"))
    both = per.unionByName(whole.withColumn(source, F.lit(None).cast(dict(per.dtypes)[source])))
    return both.withColumn("duplicates", F.col("raw_links") - F.col("unique_items"))


def pending_list(partials: DataFrame, waiting: DataFrame, n: int, busy: bool = False) -> DataFrame:
    """What can be resumed (when idle, by name), then what waits in inventory order; ``n`` rows."""
    a = partials.select(F.lit(0).alias("section"), F.col("key"), F.lit(0).cast("long").alias("ord")).filter(F.lit(not busy))
    b = waiting.select(F.lit(1).alias("section"), F.col("key"), F.col("ord").cast("long").alias("ord"))
    return a.unionByName(b).orderBy("section", "ord", "key").limit(n)


def active_downloads(partials: DataFrame, progress: DataFrame, active: bool = True) -> DataFrame:
    """Partial files and gauges by key, whichever side has it, while a task is active; else no rows.

    Bytes are the gauge's, or the file's where the gauge has none; without a total there is no share.
    """
    p = partials.select("key", F.col("size_bytes").alias("partial_bytes"))
    g = progress.select("key", "bytes_done", "bytes_total")
    out = p.join(g, "key", "full_outer").filter(F.lit(active))
    done = F.coalesce(F.nullif("bytes_done", F.lit(0)), "partial_bytes", F.lit(0))
    share = F.round(100.0 * done / F.nullif("bytes_total", F.lit(0)), 1)
    return out.select("key", done.alias("bytes_done"), F.coalesce("bytes_total", F.lit(0)).alias("bytes_total"), share.alias("percent"))


def blocked_kinds(failures: DataFrame, manifest_kinds: DataFrame, blocked: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Kind of each blocked key: the resolver's first safe one, else the manifest's last, else unclassified.

    ``failures``: ord, key, kind, error; the phrase in a text stands for a mismatch.
    """
    safe = failures.withColumn("kind", blocked_kind(F.col("kind"), F.col("error"), settings))
    r = safe.filter("kind is not null").groupBy("key").agg(F.min(F.struct("ord", "kind"))["kind"].alias("rk"))
    m = manifest_kinds.filter("kind is not null").groupBy("key").agg(F.max(F.struct("ord", "kind"))["kind"].alias("mk"))
    return blocked.select("key").join(r, "key", "left").join(m, "key", "left").select("key", F.coalesce("rk", "mk", F.lit("unclassified")).alias("kind"))
