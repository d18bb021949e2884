"""Durable ledgers: upserts that keep first times, insert-if-absent, replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import first_present, valid_key
from ..functions.urls import asset_id
from .ranking import first_by_aggregate


def blocked_upsert(ledger: DataFrame, items: DataFrame, failures: DataFrame, now: str, settings: Settings = DEFAULT) -> DataFrame:
    """Blocks by key after safe failures of listed items: the first time stays, all else follows the last failure.

    ``failures``: ord, key, kind, error. Other kinds, unlisted and invalid keys change nothing. The expected asset is
    that of the item's thumbnail now, blank too; of a key listed twice the last row by ``ord`` counts.
    """
    safe = failures.filter(F.col("kind").isin(*settings.safe_kinds) & valid_key(F.col("key"), settings))
    last = safe.groupBy("key").agg(F.max(F.struct("ord", "kind", "error")).alias("n"))
    place = F.col("ord") if "ord" in items.columns else F.lit(0)
    listed = items.select("key", F.struct(place.alias("ord"), asset_id(F.col("thumbnail_url")).alias("asset")).alias("m")).groupBy("key").agg(F.max("m")["asset"].alias("n_asset"))
    new = last.join(listed, "key").select("key", "n_asset", first_present(F.col("n.error"), F.lit(settings.unavailable_text)).alias("n_error"), F.col("n.kind").alias("n_kind"), F.lit(True).alias("fresh"))
    old = ledger.select("key", *[F.col(c).alias(f"o_{c}") for c in ("expected_asset", "error", "kind", "first_seen_at", "last_seen_at")])
    out = old.join(new, "key", "full_outer")

    def pick(n: Column, o: str) -> Column:
        return F.when(F.col("fresh"), n).otherwise(F.col(f"o_{o}")).alias(o)

    at = F.lit(now)
    return out.select("key", pick(F.col("n_asset"), "expected_asset"), pick(F.col("n_error"), "error"), pick(F.col("n_kind"), "kind"), pick(first_present(F.col("o_first_seen_at"), at), "first_seen_at"), pick(at, "last_seen_at"))


def history_upsert(archive: DataFrame, current: DataFrame, current_wins: bool = True) -> DataFrame:
    """Archive and current rows by key, whole rows, blanks included; which side wins is a parameter."""
    cols = [c for c in archive.columns if c != "key"]
    a = archive.select("key", F.struct(*cols).alias("a"))
    c = current.select("key", F.struct(*cols).alias("c"))
    order = ("c", "a") if current_wins else ("a", "c")
    return a.join(c, "key", "full_outer").select("key", F.coalesce(*order).alias("r")).select("key", "r.*")


def first_success(results: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key, date, at, bytes): the first successful outcome of each key; what the ledger has never changes.

    ``results``: key, status, at, bytes and the ordinals file_name, line_no. Minima are partial, so
    a key with many outcomes is no burden.
    """
    good = results.filter(F.col("status") == "downloaded").withColumn("bytes", F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("bytes").try_cast("long"), F.lit(0))))
    first = first_by_aggregate(good, ["key"], ["file_name", "line_no"], ["at", "bytes"])
    new = first.select("key", F.to_date("at").alias("date"), "at", "bytes")
    return new if known is None else known.select("key", "date", "at", "bytes").unionByName(new.join(known.select("key"), "key", "left_anti"))


def day_trend(ledger: DataFrame, last_day: str, days: int = 14) -> DataFrame:
    """One row a day up to ``last_day``: number and bytes of first successes, zeros filled."""
    spark = ledger.sparkSession
    end = F.to_date(F.lit(last_day))
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("date"))
    per = ledger.filter(F.col("date").between(F.date_sub(end, days - 1), end)).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    zero = F.lit(0).cast("long")
    return spine.join(per, "date", "left").select("date", F.date_format("date", "MM/dd").alias("label"), F.coalesce("n", zero).alias("items"), F.coalesce("b", zero).alias("bytes"))


def updated_snapshot(items: DataFrame, attempted: DataFrame, old_failures: DataFrame, new_failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with the fields of attempted ones replaced, and failures with those of attempted keys replaced."""
    new = attempted.select("key", F.col("media_url").alias("_m"), F.col("resolved_at").alias("_r"))
    rows = items.join(new, "key", "left").withColumn("media_url", F.coalesce("_m", "media_url")).withColumn("resolved_at", F.coalesce("_r", "resolved_at")).drop("_m", "_r")
    failures = old_failures.join(attempted.select(F.col("key").alias("viewkey")), "viewkey", "left_anti").unionByName(new_failures, allowMissingColumns=True)
    return rows, failures
