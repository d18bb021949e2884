"""Deduplication: best card, ordered merge, asset and content identity, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.rules import card_score, consistent_asset
from ..functions.text import blank, valid_key
from ..functions.urls import asset_id
from .ranking import best_per, first_by_aggregate


def best_cards(cards: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One card a page and key; ``first_ord`` is where the key appeared first."""
    from pyspark.sql import Window

    score = card_score(F.col("asset_id"), F.col("thumbnail_url"), F.col("tracking_class"), F.col("title"), F.col("duration"), settings)
    keys = ["source_idx", "page", "key"]
    seen = cards.withColumns({"score": score, "first_ord": F.min("card_ord").over(Window.partitionBy(*keys))})
    return best_per(seen, keys, "score", ["card_ord"])


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


_STATE = ("canonical_url", "title", "thumbnail_url", "duration", "media_url", "resolved_at", "asset_id")


def _folded(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The fold of a key's records in order, from a fixed number of partial minima a key.

    Read one after the other, the current record is replaced by the first consistent one unless it is consistent
    itself by then; blanks are filled from the other side. So the outcome hangs on few records: the first, the
    first with each field, and the first consistent one. What was filled together before that is consistent or not
    by the first asset and the first thumbnail; if it is, nothing is replaced. No list of a key's records is made.
    """
    one = F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in _STATE], F.coalesce("source_pages", F.array().cast("array<int>")).alias("source_pages"))
    seen = rows.select(*keys, *order, one.alias("_r")).withColumn("_ok", consistent_asset(F.col("_r.asset_id"), F.col("_r.thumbnail_url")))
    found = [F.min(F.when(~_blank(F.col(f"_r.{c}")), F.col("_r"))).alias(f"_f_{c}") for c in _STATE if c != "canonical_url"]
    ends = [F.min("_r").alias("_first"), F.min(F.when(F.col("_ok"), F.col("_r"))).alias("_whole"), F.collect_set("_r.source_pages").alias("_pages"), F.min(F.struct(*order)).alias("_at")]
    summed = seen.groupBy(*keys).agg(*found, *ends)
    whole, asset, thumb = F.col("_whole"), F.col("_f_asset_id"), F.col("_f_thumbnail_url")
    filled_first = (asset < whole) & (thumb < whole) & consistent_asset(asset["asset_id"], thumb["thumbnail_url"])
    replaced = whole.isNotNull() & ~F.coalesce(filled_first, F.lit(False))

    def outcome(c: str) -> Column:
        if c == "canonical_url":
            return F.when(F.col("_new"), whole[c]).otherwise(F.col("_first")[c])
        first = F.coalesce(F.col(f"_f_{c}")[c], F.lit(""))
        return F.when(F.col("_new") & ~_blank(whole[c]), whole[c]).otherwise(first)

    pages = F.array_sort(F.array_distinct(F.flatten("_pages"))).alias("source_pages")
    return summed.withColumn("_new", replaced).select(*keys, *[outcome(c).alias(c) for c in _STATE], pages, *[F.col(f"_at.{c}").alias(c) for c in order])


def merge_items(videos: DataFrame) -> DataFrame:
    """Items by key: folded in page order inside each source, then over the sources in order.

    ``videos``: source_idx, page, first_ord, key, the item's fields, source_pages. A hot key moves a few records a
    task and its distinct pages, not its appearances. Null fields are blank, null pages none; records of one place
    go by their fields. The order columns of the result are the key's first place.
    """
    inside = _folded(videos, ["source_idx", "key"], ["page", "first_ord"])
    return _folded(inside, ["key"], ["source_idx", "page", "first_ord"])


def asset_duplicates(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items under other keys whose asset a finished item already holds; both must be consistent."""
    own = done.filter(consistent_asset(F.col("asset_id"), F.col("thumbnail_url"))).select(F.col("asset_id").alias("_a"), F.col("key").alias("_k")).groupBy("_a").agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
    fits = items.filter(consistent_asset(F.col("asset_id"), F.col("thumbnail_url")))
    return fits.join(own, (fits["asset_id"] == F.col("_a")) & ((F.col("_lo") != fits["key"]) | (F.col("_hi") != fits["key"])), "left_semi")


def content_claims(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each result with ``owner`` of its hash and ``is_duplicate``: the ledger's key, else the first by ``ord``."""
    first = first_by_aggregate(results, ["hash"], ["ord"], ["key"]).select("hash", F.col("key").alias("first_key"))
    known = ledger.select("hash", F.col("key").alias("known_key")).groupBy("hash").agg(F.min("known_key").alias("known_key"))
    out = results.join(first, "hash", "left").join(known, "hash", "left").withColumn("owner", F.coalesce("known_key", "first_key"))
    return out.drop("first_key", "known_key").withColumn("is_duplicate", F.col("owner") != F.col("key"))


def asset_owners(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Items with the owner of their asset; a duplicate where it is another key."""
    out = items.join(assets.select(F.col("asset").alias("asset_id"), F.col("key").alias("owner")), "asset_id", "left")
    return out.withColumn("is_duplicate", F.coalesce(F.col("owner") != F.col("key"), F.lit(False)))


def adopted_assets(assets: DataFrame, adoptions: DataFrame) -> DataFrame:
    """(asset, key) after adoptions (ord, asset, key): the last one of an asset gives its owner; blanks change nothing."""
    last = adoptions.filter(~blank(F.col("asset")) & ~blank(F.col("key"))).groupBy("asset").agg(F.max(F.struct("ord", "key"))["key"].alias("new"))
    return assets.join(last, "asset", "full_outer").select("asset", F.coalesce("new", "key").alias("key"))


def asset_backfill(hashes: DataFrame, logged: DataFrame, assets: DataFrame) -> DataFrame:
    """New (asset, key): of logged assets whose key has one hash alone and that nobody owns; the first row wins."""
    single = hashes.groupBy("key").agg(F.count_distinct("hash").alias("n")).filter("n = 1").select("key")
    rows = logged.filter(F.col("asset").rlike(r"\A\d+\z")).join(single, "key", "left_semi").join(assets, "asset", "left_anti")
    return first_by_aggregate(rows, ["asset"], ["ord"], ["key"]).select("asset", "key")


def hash_multiplicity(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.count_distinct("hash").alias("n_hashes"))


def greedy_queue(rows: DataFrame, settled, key: str = "key", url: str = "url", order: str = "ord") -> DataFrame:
    """Rows whose key and URL no earlier accepted row has.

    Each round accepts the rows that are first of both their key and their URL among the undecided,
    and rejects what shares with them; rounds follow chains of conflicts, not rows. ``settled``
    writes a round's rows to where all executors read them.
    """
    left, accepted = settled(rows), None
    while True:
        by_key = left.groupBy(key).agg(F.min(order).alias("_fk"))
        by_url = left.groupBy(url).agg(F.min(order).alias("_fu"))
        marked = left.join(by_key, key).join(by_url, url)
        now = settled(marked.filter((F.col(order) == F.col("_fk")) & (F.col(order) == F.col("_fu"))).select(*rows.columns))
        accepted = now if accepted is None else accepted.unionByName(now)
        left = settled(left.join(now.select(key), key, "left_anti").join(now.select(url), url, "left_anti").select(*rows.columns))
        if left.isEmpty():
            return accepted


def valid_queue(rows: DataFrame, settled, settings: Settings = DEFAULT) -> DataFrame:
    """Queue rows with a valid key and a URL, deduplicated in order."""
    return greedy_queue(rows.filter(valid_key(F.col("key"), settings) & ~blank(F.col("url"))), settled)


def with_asset(items: DataFrame) -> DataFrame:
    return items.withColumn("thumbnail_asset", asset_id(F.col("thumbnail_url")))
