"""Identity of contents: documents by hash, assets, queues, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe, ledger, queueing, ranking
from ..sources import ledgers as src
from .registry import query


def hashed(t):
    return t("documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "source", "lang", "n_chars")


_H = "SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS key, sha256(coalesce(text, '')) AS hash, source, lang, n_chars FROM documents"


@query("content_hash_dedupe", f"SELECT hash, min(ord) AS ord, count(*) AS n FROM ({_H}) GROUP BY hash")
def content_hash_dedupe(t):
    return hashed(t).groupBy("hash").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))


@query("content_owner", f"""WITH h AS ({_H}), l AS (SELECT hash, min(key) AS known FROM h WHERE ord % 7 = 3 GROUP BY hash), f AS (SELECT hash, min_by(key, ord) AS first FROM h GROUP BY hash)
SELECT key, coalesce(known, first) AS owner, coalesce(known, first) <> key AS is_duplicate FROM h LEFT JOIN f USING (hash) LEFT JOIN l USING (hash)""")
def content_owner(t):
    h = hashed(t)
    return dedupe.content_claims(h.select("ord", "key", "hash"), h.filter("ord % 7 = 3").select("hash", "key")).select("key", "owner", "is_duplicate")


@query("hash_multiplicity", f"SELECT source AS key, count(DISTINCT hash) AS n_hashes FROM ({_H}) GROUP BY source")
def hash_multiplicity(t):
    return dedupe.hash_multiplicity(hashed(t).select(F.col("source").alias("key"), "hash"))


_ITEM = "SELECT CAST(doc_id AS VARCHAR) AS key, CAST(n_chars AS VARCHAR) AS asset, doc_id % 4 <> 1 AS consistent, doc_id FROM documents"


@query("asset_semi_join", f"SELECT key FROM ({_ITEM}) i WHERE consistent AND EXISTS (SELECT 1 FROM ({_ITEM}) d WHERE d.doc_id % 5 = 0 AND d.consistent AND d.asset = i.asset AND d.key <> i.key)")
def asset_semi_join(t):
    n = F.col("n_chars").cast("string")
    thumb = F.when(F.col("doc_id") % 4 != 1, F.concat(F.lit("https://t.example/"), n, F.lit(".jpg"))).otherwise("https://t.example/0.jpg")
    i = t("documents").select(F.col("doc_id").cast("string").alias("key"), n.alias("asset_id"), thumb.alias("thumbnail_url"), "doc_id")
    return dedupe.asset_duplicates(i, i.filter("doc_id % 5 = 0")).select("key")


@query("asset_owner_lookup", f"""WITH i AS ({_ITEM}), o AS (SELECT asset, min(key) AS owner FROM i GROUP BY asset) SELECT key, owner, owner <> key AS is_duplicate FROM i JOIN o USING (asset)""")
def asset_owner_lookup(t):
    i = t("documents").select(F.col("doc_id").cast("string").alias("key"), F.col("n_chars").cast("string").alias("asset_id"))
    own = i.groupBy(F.col("asset_id").alias("asset")).agg(F.min("key").alias("key"))
    return dedupe.asset_owners(i, own).select("key", "owner", "is_duplicate")


@query("asset_backfill", f"""WITH h AS ({_H}), one AS (SELECT n_chars AS k FROM h GROUP BY n_chars HAVING count(DISTINCT hash) = 1), r AS (SELECT CAST(ord % 300 AS VARCHAR) AS asset, ord, n_chars FROM h WHERE n_chars IN (SELECT k FROM one) AND ord % 300 % 11 <> 0)
SELECT asset, CAST(min_by(n_chars, ord) AS VARCHAR) AS key FROM r GROUP BY asset""")
def asset_backfill(t):
    h = hashed(t)
    hashes = h.select(F.col("n_chars").cast("string").alias("key"), "hash")
    logged = h.select((F.col("ord") % 300).cast("string").alias("asset"), F.col("n_chars").cast("string").alias("key"), "ord")
    owned = h.select((F.col("ord") % 300).alias("a")).distinct().filter("a % 11 = 0").select(F.col("a").cast("string").alias("asset"))
    return dedupe.asset_backfill(hashes, logged, owned)


_QUEUE = "SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id AS ord, 'key-' || (n_chars % 701) AS key, 'u' || (doc_id % 509) AS url FROM documents WHERE n_chars % 701 >= 10"


@query("queue_greedy_dedupe", f"""WITH RECURSIVE q AS ({_QUEUE}), g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ks, CAST([] AS VARCHAR[]) AS us, false AS ok
UNION ALL SELECT q.i, CASE WHEN list_contains(ks, key) OR list_contains(us, url) THEN ks ELSE list_append(ks, key) END, CASE WHEN list_contains(ks, key) OR list_contains(us, url) THEN us ELSE list_append(us, url) END, NOT (list_contains(ks, key) OR list_contains(us, url)) FROM g JOIN q ON q.i = g.i + 1)
SELECT q.ord, q.key, q.url FROM g JOIN q ON q.i = g.i WHERE g.ok""")
def queue_greedy_dedupe(t):
    """Rows accepted in order unless an accepted one has their key or address; tests hold it against a loop."""
    from ..operators.fixpoint import settled_in_shared_folder

    q = t("documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("key-"), (F.col("n_chars") % 701).cast("string")).alias("key"), F.concat(F.lit("u"), (F.col("doc_id") % 509).cast("string")).alias("url"))
    return dedupe.valid_queue(q, settled_in_shared_folder)


@query("queue_limit", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY n_chars) ORDER BY doc_id LIMIT 40")
def queue_limit(t):
    """The first 40 of a deduplicated queue: the limit is the feature."""
    return ranking.top(t("documents").groupBy("n_chars").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), 40, F.col("doc_id"))


@query("snapshot_identity", "SELECT source, count(*) AS n, count(DISTINCT sha256(coalesce(text, ''))) AS distinct_texts FROM documents GROUP BY source")
def snapshot_identity(t):
    d = hashed(t)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("distinct_texts"))


@query("table_digest")
def table_digest(t):
    """Identity of a table's rows in any order."""
    return src.digest(t("documents"), "n_chars")


@query("retention_7", "SELECT day FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) ORDER BY day DESC LIMIT 7")
def retention_7(t):
    return ranking.retained(t("events").select(F.to_date("ts").alias("day")).distinct(), 7, F.desc("day"))


@query("csv_export", "SELECT CAST(doc_id AS VARCHAR) AS key, '' AS canonical_url, coalesce(source, '') AS title, '' AS thumbnail_url, '' AS duration, '1,' || doc_id AS source_pages, '' AS media_url, '' AS resolved_at FROM documents")
def csv_export(t):
    blank = F.lit(None).cast("string")
    d = t("documents").select(F.col("doc_id").cast("string").alias("key"), blank.alias("canonical_url"), F.col("source").alias("title"), blank.alias("thumbnail_url"), blank.alias("duration"), F.array(F.lit(1).cast("long"), F.col("doc_id")).alias("source_pages"), blank.alias("media_url"), blank.alias("resolved_at"), F.lit("x").alias("asset_id"))
    return src.csv_rows(d)


@query("key_list_merge", "SELECT DISTINCT 'item-key-' || (doc_id % 900) AS key FROM documents WHERE doc_id % 3 <> 1")
def key_list_merge(t):
    k = t("documents").select(F.concat(F.lit("item-key-"), (F.col("doc_id") % 900).cast("string")).alias("key"), "doc_id")
    return src.merged_keys(k.filter("doc_id % 3 = 0"), k.filter("doc_id % 3 = 2").union(k.limit(1).selectExpr("'bad'", "doc_id")))


@query("media_update", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS media_url FROM documents""")
def media_update(t):
    i = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.lit("old").alias("media_url"), F.lit("t").alias("resolved_at"))
    new = i.filter("doc_id % 3 = 0").select("key", F.lit("new").alias("media_url"), F.lit("u").alias("resolved_at"))
    return queueing.union_media(i, new, i.filter("doc_id % 5 = 0")).select("doc_id", "media_url")


@query("snapshot_update", """SELECT CAST(doc_id AS VARCHAR) AS viewkey, CASE WHEN doc_id % 4 = 0 THEN 'fresh' ELSE 'stale' END AS error FROM documents WHERE doc_id % 2 = 0 AND (doc_id % 4 = 2 OR doc_id % 8 = 0)""")
def snapshot_update(t):
    i = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.lit("m").alias("media_url"), F.lit("t").alias("resolved_at"))
    old = i.filter("doc_id % 2 = 0").select(F.col("key").alias("viewkey"), F.lit("stale").alias("error"))
    new = i.filter("doc_id % 8 = 0").select(F.col("key").alias("viewkey"), F.lit("fresh").alias("error"))
    return ledger.updated_snapshot(i, i.filter("doc_id % 4 = 0"), old, new)[1]


@query("snapshot_update_items", "SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN '' WHEN doc_id % 4 = 0 THEN 'fresh' ELSE 'm' END AS media_url, CASE WHEN doc_id % 4 = 0 THEN 'u' ELSE 't' END AS resolved_at FROM documents")
def snapshot_update_items(t):
    """Fields of attempted items are replaced, blanks included."""
    i = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.lit("m").alias("media_url"), F.lit("t").alias("resolved_at"))
    tried = i.filter("doc_id % 4 = 0").select("key", F.when(F.col("doc_id") % 8 == 0, "").otherwise("fresh").alias("media_url"), F.lit("u").alias("resolved_at"))
    none = i.limit(0).select(F.col("key").alias("viewkey"), F.lit("").alias("error"))
    return ledger.updated_snapshot(i, tried, none, none)[0].select("doc_id", "media_url", "resolved_at")
