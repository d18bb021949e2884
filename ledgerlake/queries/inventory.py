"""Queues, blocks and set algebra: ``documents`` as items, ``labels`` as ledgers, ``orders`` as inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import inventory, ledger, queueing, ranking
from .registry import query

# Quality 1 stands for success, toxic 1 for ignored, a label at all for history, even ids for files.
_I = """SELECT d.doc_id, coalesce(l.toxic = 1, false) AS ignored, coalesce(l.quality = 1, false) AS success, l.doc_id IS NOT NULL AS seen, d.n_chars % 3 > 0 AS media, d.doc_id % 2 = 0 AS file FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def items(t):
    media = F.when(F.col("n_chars") % 3 > 0, "m").otherwise("")
    blank = F.lit("")
    return t("documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), blank.alias("title"), blank.alias("thumbnail_url"), blank.alias("duration"), media.alias("media_url"), F.when(media != "", "2024-01-01T00:00:00Z").otherwise("").alias("resolved_at"), F.col("n_chars").cast("string").alias("asset_id"))


def keys(df):
    return df.select(F.col("doc_id").cast("string").alias("key"))


def history(t):
    blank = F.lit("")
    return keys(t("labels")).select("key", blank.alias("title"), blank.alias("thumbnail_url"), blank.alias("duration"), blank.alias("media_url"), blank.alias("resolved_at"))


def classified(t, **how):
    lab = t("labels")
    files = keys(t("documents").filter("doc_id % 2 = 0"))
    return queueing.classified(items(t), history(t), keys(lab.filter("quality = 1")), keys(lab.filter("toxic = 1")), files, **how)


_CLASS = "CASE WHEN ignored THEN 'ignored' WHEN success THEN 'skip' {} WHEN NOT media AND seen THEN 'retry' WHEN NOT media THEN 'new' WHEN NOT seen AND file THEN 'skip' WHEN NOT seen THEN 'new' WHEN NOT file THEN 'retry' ELSE 'skip' END"


@query("queue_classification", f"SELECT doc_id, {_CLASS.format('')} AS queue_class FROM ({_I})")
def queue_classification(t):
    return classified(t).select("doc_id", "queue_class")


@query("queue_new_only", f"SELECT doc_id, {_CLASS.format(chr(32) + 'WHEN seen THEN ' + chr(39) + 'skip' + chr(39))} AS queue_class FROM ({_I})")
def queue_new_only(t):
    return classified(t, new_only=True).select("doc_id", "queue_class")


@query("queue_counts", f"SELECT count(*) FILTER (WHERE c = 'new') AS n_new, count(*) FILTER (WHERE c = 'retry') AS n_retry, count(*) FILTER (WHERE c IN ('skip', 'ignored')) AS n_skipped, count(*) FILTER (WHERE c = 'ignored') AS n_ignored FROM (SELECT {_CLASS.format('')} AS c FROM ({_I}))")
def queue_counts(t):
    return queueing.queue_counts(classified(t))


@query("history_backfill", "SELECT d.doc_id, CASE WHEN d.n_chars % 3 > 0 THEN 'm' WHEN l.doc_id IS NOT NULL THEN 'old' || l.quality ELSE '' END AS media_url, l.doc_id IS NOT NULL AS seen FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def history_backfill(t):
    blank = F.lit("")
    h = t("labels").select(F.col("doc_id").cast("string").alias("key"), blank.alias("title"), blank.alias("thumbnail_url"), blank.alias("duration"), F.concat(F.lit("old"), F.col("quality").cast("string")).alias("media_url"), blank.alias("resolved_at"))
    return queueing.backfilled(items(t), h).select("doc_id", "media_url", "seen")


@query("blocked_match_residual", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'media_unavailable' ELSE 'media_mismatch' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 'media is not available' ELSE 'why' END AS error
FROM orders WHERE o_orderkey % 10 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_custkey % 2 = o_orderkey % 2) AND (o_orderkey % 7 = 0 OR o_orderdate >= TIMESTAMP '1995-06-17 00:00:00') AND o_orderkey % 21 <> 0""")
def blocked_match_residual(t):
    """Items and blocks by order: assets that are blank or differ, times that only the first sight tells, unsafe
    kinds and blank texts."""
    n, at = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    late, early = F.lit("2030-01-01T00:00:00Z"), F.lit("1980-01-01T00:00:00Z")
    o = t("orders").select(
        n.cast("string").alias("key"), F.when(n % 3 == 0, "").otherwise((n % 2 + 1).cast("string")).alias("expected_asset"), F.when(n % 4 == 0, "").otherwise("why").alias("error"),
        F.when(n % 6 == 0, "media_unavailable").when(n % 6 == 1, "media_mismatch").when(n % 6 == 2, "request_error").otherwise("").alias("kind"),
        F.when(n % 21 == 0, early).when(n % 7 == 0, late).otherwise(early).alias("first_seen_at"), F.when(n % 7 == 0, "").otherwise(at).alias("last_seen_at"), n,
    )
    thumb = F.when(n % 5 == 0, "https://t.example/none.jpg").otherwise(F.concat(F.lit("https://t.example/a/"), (F.col("o_custkey") % 2 + 1).cast("string"), F.lit(".jpg?x")))
    listed = t("orders").select(n.cast("string").alias("key"), thumb.alias("thumbnail_url"))
    done = o.filter("o_orderkey % 10 = 0").select("key")
    return queueing.matching_blocks(listed, o, done, "1995-06-17T00:00:00Z").select("o_orderkey", "kind", "error")


@query("blocked_prune", "SELECT doc_id FROM labels WHERE toxic = 1 AND quality <> 1")
def blocked_prune(t):
    lab = t("labels").withColumn("key", F.col("doc_id").cast("string"))
    return queueing.pruned_blocks(lab.filter("toxic = 1"), lab.filter("quality = 1").select("key")).select("doc_id")


@query("blocked_upsert", """WITH f AS (SELECT 'item-' || doc_id AS key, doc_id, CASE WHEN doc_id % 12 = 0 THEN 'media_unavailable' ELSE 'media_mismatch' END AS kind FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 2 AND doc_id % 8 <> 1),
o AS (SELECT 'item-' || doc_id AS key, CASE WHEN quality = 1 THEN 'old' ELSE '' END AS first FROM labels)
SELECT coalesce(o.key, f.key) AS key, CASE WHEN f.key IS NULL THEN '7' WHEN doc_id % 9 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS expected_asset, CASE WHEN f.key IS NULL THEN 'e' WHEN doc_id % 5 = 0 THEN 'media is not available' ELSE 'new' END AS error,
coalesce(f.kind, 'media_mismatch') AS kind, CASE WHEN f.key IS NULL THEN first WHEN coalesce(first, '') = '' THEN 'now' ELSE first END AS first_seen_at, CASE WHEN f.key IS NULL THEN first ELSE 'now' END AS last_seen_at FROM o FULL JOIN f ON f.key = o.key""")
def blocked_upsert(t):
    """Failures of unsafe kinds and of unlisted keys change nothing; a blank asset replaces the old one; of two
    failures of a key the last counts, of two listed rows too: earlier ones show a greater asset."""
    key = F.concat(F.lit("item-"), F.col("doc_id").cast("string")).alias("key")
    first = F.when(F.col("quality") == 1, "old").otherwise("")
    old = t("labels").select(key, F.lit("7").alias("expected_asset"), F.lit("e").alias("error"), F.lit("media_mismatch").alias("kind"), first.alias("first_seen_at"), first.alias("last_seen_at"))
    n = F.col("doc_id")
    listed = t("documents").filter("doc_id % 8 <> 1").select(key, F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("https://t.example/"), n.cast("string"), F.lit(".jpg"))).alias("thumbnail_url"), F.lit(2).alias("ord"))
    listed = listed.unionByName(listed.select("key", F.lit("https://t.example/99999999999.jpg").alias("thumbnail_url"), F.lit(1).alias("ord")))
    failed = t("documents").filter("doc_id % 3 = 0")
    last = failed.select(F.lit(2).alias("ord"), key, F.when(n % 4 == 2, "request_error").when(n % 12 == 0, "media_unavailable").otherwise("media_mismatch").alias("kind"), F.when(n % 5 == 0, "").otherwise("new").alias("error"))
    before = failed.filter("doc_id % 4 <> 2").select(F.lit(1).alias("ord"), key, F.lit("media_unavailable").alias("kind"), F.lit("earlier").alias("error"))
    return ledger.blocked_upsert(old, listed, last.unionByName(before), "now")


def keys_with(df, *cols):
    return df.select(F.col("doc_id").cast("string").alias("key"), *cols)


@query("history_upsert", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN d.source ELSE 'label' END AS v FROM (SELECT doc_id, source FROM documents WHERE doc_id % 4 > 0) d FULL JOIN labels l ON l.doc_id = d.doc_id")
def history_upsert(t):
    a = keys_with(t("labels"), F.lit("label").alias("v"))
    c = keys_with(t("documents").filter("doc_id % 4 > 0"), F.col("source").alias("v"))
    return ledger.history_upsert(a, c).select(F.col("key").cast("long").alias("doc_id"), "v")


@query("repair_candidates", f"""WITH i AS ({_I}), k AS (SELECT CAST(doc_id % 500 AS VARCHAR) AS key, min(doc_id) AS doc_id FROM documents WHERE doc_id % 13 <> 0 GROUP BY 1),
l AS (SELECT CAST(doc_id % 500 AS VARCHAR) AS key, * FROM labels) SELECT doc_id FROM k WHERE key NOT IN (SELECT key FROM l WHERE quality = 1 AND doc_id % 3 = 0) AND key NOT IN (SELECT key FROM l WHERE toxic = 1)
AND key NOT IN (SELECT key FROM l WHERE quality = 0 AND key NOT IN (SELECT key FROM l WHERE doc_id % 7 = 0))""")
def repair_candidates(t):
    """Short keys, keys that repeat and blank ones, with and without media: the first row of each stays unless done, ignored or blocked."""
    lab = t("labels")
    short = (F.col("doc_id") % 500).cast("string")
    i = items(t).withColumns({"key": F.when(F.col("doc_id") % 13 == 0, "").otherwise(short), "ord": F.col("doc_id")})
    k = lambda df: df.select(short.alias("key"))
    return queueing.repair_candidates(i, k(lab.filter("quality = 1 and doc_id % 3 = 0")), k(lab.filter("quality = 0")), k(lab.filter("doc_id % 7 = 0")), k(lab.filter("toxic = 1"))).select("doc_id")


def marked(t):
    lab = t("labels")
    docs = t("documents")
    return inventory.states(items(t), keys(lab.filter("quality = 1")), keys(docs.filter("doc_id % 5 = 0")), keys(lab.filter("toxic = 1")), keys(docs.filter("doc_id % 3 = 0")), keys(docs.filter("doc_id % 11 = 0")), keys(docs.filter("doc_id % 2 = 0")))


_S = f"""SELECT *, NOT resolved AND NOT ignored AS unresolved, (NOT resolved AND NOT ignored AND doc_id % 3 = 0) OR (doc_id % 11 = 0 AND NOT ignored) AS blocked FROM (
SELECT doc_id, success OR doc_id % 5 = 0 AS completed, ignored, (media OR success OR doc_id % 5 = 0) AND NOT ignored AS resolved FROM ({_I}))"""


@query("inventory_set_algebra", f"SELECT doc_id, completed, ignored, resolved, unresolved, blocked, unresolved AND NOT blocked AND doc_id % 2 = 0 AS current_error, unresolved AND doc_id % 2 <> 0 AS backlog FROM ({_S})")
def inventory_set_algebra(t):
    return marked(t).select("doc_id", *inventory.STATES)


@query("inventory_overview", f"""SELECT n_items, n_downloaded, n_ignored, n_resolved, n_unresolved, n_blocked, n_current_error, n_backlog, greatest(0, n_items - n_downloaded - n_blocked - n_ignored) AS n_pending, CAST(round(100.0 * n_downloaded / greatest(1, n_items - n_ignored), 1) AS DOUBLE) AS percent FROM (
SELECT count(*) AS n_items, count(*) FILTER (WHERE completed AND NOT ignored) AS n_downloaded, count(*) FILTER (WHERE ignored) AS n_ignored, count(*) FILTER (WHERE resolved) AS n_resolved, count(*) FILTER (WHERE unresolved) AS n_unresolved, count(*) FILTER (WHERE blocked) AS n_blocked,
count(*) FILTER (WHERE unresolved AND NOT blocked AND doc_id % 2 = 0) AS n_current_error, count(*) FILTER (WHERE unresolved AND doc_id % 2 <> 0) AS n_backlog FROM ({_S}))""")
def inventory_overview(t):
    return inventory.overview(marked(t))


_FAILURES = """SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'request_error' WHEN 'view' THEN 'media_unavailable' WHEN 'click' THEN '' WHEN 'signup' THEN 'media_mismatch' END AS kind, event_id % 11 = 0 AS phrase FROM events"""


@query("blocked_kind_resolution", f"""WITH f AS (SELECT user_id, event_id, CASE WHEN kind IN ('media_mismatch', 'media_unavailable') THEN kind WHEN phrase THEN 'media_mismatch' END AS k FROM ({_FAILURES}) WHERE event_id % 2 = 0),
r AS (SELECT user_id, arg_min(k, event_id) AS k FROM f WHERE k IS NOT NULL GROUP BY user_id), m AS (SELECT user_id, arg_max(CASE WHEN event_id % 2 = 1 THEN 'media_unavailable' ELSE 'media_mismatch' END, event_id) AS k FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT CAST(c.c_custkey AS VARCHAR) AS key, coalesce(r.k, m.k, 'unclassified') AS kind FROM customer c LEFT JOIN r ON r.user_id = c.c_custkey LEFT JOIN m ON m.user_id = c.c_custkey""")
def blocked_kind_resolution(t):
    """Customers as blocked keys: unsafe kinds count only where their text has the phrase; the resolver's first safe
    kind goes before the manifest's last."""
    e = t("events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("ord"), "event_type")
    kind = F.when(F.col("event_type") == "error", "request_error").when(F.col("event_type") == "view", "media_unavailable").when(F.col("event_type") == "click", "").when(F.col("event_type") == "signup", "media_mismatch")
    error = F.when(F.col("ord") % 11 == 0, "file does not match the listing").otherwise("other")
    m = e.filter("event_type = 'purchase'").select("key", "ord", F.when(F.col("ord") % 2 == 1, "media_unavailable").otherwise("media_mismatch").alias("kind"))
    return inventory.blocked_kinds(e.filter("ord % 2 = 0").select("key", "ord", kind.alias("kind"), error.alias("error")), m, t("customer").select(F.col("c_custkey").cast("string").alias("key")))


@query("recent_top12", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 12")
def recent_top12(t):
    """The twelve newest orders: a report's limit."""
    return ranking.top(t("orders"), 12, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("pending_cap50", "SELECT section, key, ord FROM (SELECT CAST(0 AS INT) AS section, CAST(o_orderkey AS VARCHAR) AS key, CAST(0 AS BIGINT) AS ord FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) > (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - INTERVAL 30 DAY UNION ALL SELECT CAST(1 AS INT), CAST(o_orderkey AS VARCHAR), o_orderkey FROM orders WHERE o_orderstatus = 'O') ORDER BY section, ord, key LIMIT 50")
def pending_cap50(t):
    """Fifty rows, the listing's limit: urgent orders in process of the last month by name, then open orders in order."""
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("ord"), "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    last = o.agg(F.date_sub(F.max("day"), 30).alias("_last"))
    partial = o.filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").join(F.broadcast(last), F.col("day") > F.col("_last"))  # one row
    return inventory.pending_list(partial, o.filter("o_orderstatus = 'O'"), 50)


@query("pending_busy_cap50", "SELECT CAST(1 AS INT) AS section, CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS ord FROM orders WHERE o_orderstatus = 'O' ORDER BY ord LIMIT 50")
def pending_busy_cap50(t):
    """The same listing while a task runs: nothing is resumable then."""
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    return inventory.pending_list(o.filter("o_orderstatus = 'P'"), o.filter("o_orderstatus = 'O'"), 50, busy=True)


@query("identity_check", "SELECT o_orderkey, o_orderstatus <> 'P' AND o_orderstatus NOT IN ('F', substr(o_orderpriority, 1, 1)) AS mismatch FROM orders")
def identity_check(t):
    expected = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return t("orders").select("o_orderkey", rules.identity_mismatch(expected, F.array(F.lit("F"), F.substring("o_orderpriority", 1, 1))).alias("mismatch"))


@query("title_lookup", "SELECT o.o_orderkey, coalesce(c.c_name, CAST(o.o_orderkey AS VARCHAR)) AS title FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey")
def title_lookup(t):
    c = t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t("orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.col("o_orderkey").cast("string")).alias("title"))


@query("cube_status", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_status(t):
    """Extension: counts over all combinations of two columns."""
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("revenue_by_segment", "SELECT c_mktsegment, n_name, count(*) AS n, CAST(round(sum(l_extendedprice * (1 - l_discount)), 0) AS BIGINT) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY 1, 2")
def revenue_by_segment(t):
    """Extension: a star join; dimensions are joined by size, the large sides by their key."""
    l = t("lineitem").filter("l_returnflag = 'R'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = t("orders").select("o_orderkey", "o_custkey")
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 0).cast("long").alias("revenue"))
