"""Readers and writers over files that the queries write first: ledgers, logs, snapshots, queues, backups."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import dedupe, history
from ..operators.fixpoint import settled_in_shared_folder
from ..plans import runs
from ..plans.engine import Engine
from ..sources import backup as backup_
from ..sources import documents
from ..sources import ledgers as src
from ..sources import pages as pages_
from ..sources import store
from .events import CASE, status
from .pages import ANCHORS
from .registry import query
from .streams import shared_place


def place(df):
    """(session, new shared folder)."""
    spark = df.sparkSession
    return spark, shared_place(spark)


def text_of(c):
    return F.col(c).cast("string")


def item_key(n, bad):
    """A key of the configured shape, but for each ``bad``-th row."""
    return F.when(F.col(n) % bad == 0, F.concat(F.lit("no key "), text_of(n))).otherwise(F.concat(F.lit("item-key-"), text_of(n)))


# ---- ledgers


@query("blocked_ledger_file", "SELECT 'item-key-' || doc_id AS key, CAST(doc_id AS VARCHAR) AS expected_asset, 'e' || quality AS error, CASE WHEN toxic = 1 THEN 'media_mismatch' ELSE 'media_unavailable' END AS kind, 'first' AS first_seen_at, CASE WHEN quality = 1 THEN 'last' ELSE '' END AS last_seen_at FROM labels WHERE doc_id % 6 <> 0")
def blocked_ledger_file(t):
    """Written as one document and read again; keys of another shape are left out."""
    lab = t("labels")
    spark, folder = place(lab)
    rows = lab.select(item_key("doc_id", 6).alias("key"), text_of("doc_id").alias("expectedAsset"), F.concat(F.lit("e"), text_of("quality")).alias("error"), F.when(F.col("toxic") == 1, "media_mismatch").otherwise("media_unavailable").alias("kind"), F.lit("first").alias("firstSeenAt"), F.when(F.col("quality") == 1, "last").otherwise("").alias("lastSeenAt"))
    src.write_document(src.ledger_document(rows), f"{folder}/blocked.json")
    return src.blocked_ledger(spark, f"{folder}/blocked.json")


@query("ignored_ledger_file", "SELECT 'map' AS form, 'item-key-' || s_suppkey AS key FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT 'list', 'item-key-' || s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT 'objects', 'item-key-' || s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0")
def ignored_ledger_file(t):
    """The three forms of the list of ignored keys."""
    s = t("supplier").select(item_key("s_suppkey", 5).alias("key"))
    spark, folder = place(s)
    src.write_document(src.ledger_document(s.withColumn("reason", F.lit("r"))), f"{folder}/map.json")
    listed = F.sort_array(F.collect_list("key"))
    src.write_document(s.agg(F.to_json(F.struct(listed.alias("items")))), f"{folder}/list.json")
    src.write_document(s.agg(F.to_json(F.struct(F.transform(listed, lambda k: F.struct(k.alias("viewkey"))).alias("items")))), f"{folder}/objects.json")
    parts = [src.ignored_keys(spark, f"{folder}/{form}.json").select(F.lit(form).alias("form"), "key") for form in ("map", "list", "objects")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("content_ledger_file", "SELECT 'hash' AS part, sha256(s_name) AS id, CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey END AS bytes FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 'asset', CAST(s_suppkey AS VARCHAR), 'k' || s_suppkey, CAST(0 AS BIGINT) FROM supplier WHERE s_suppkey % 7 <> 0")
def content_ledger_file(t):
    """Hashes and assets of a content document; broken hashes and assets are left out, broken sizes are 0."""
    s = t("supplier")
    spark, folder = place(s)
    n = F.col("s_suppkey")
    h = F.when(n % 4 == 0, F.concat(F.lit("short"), text_of("s_suppkey"))).otherwise(F.sha2("s_name", 256))
    entry = F.struct(text_of("s_suppkey").alias("viewkey"), F.when(n % 3 == 0, "many").otherwise(text_of("s_suppkey")).alias("bytes"), F.lit("").alias("recordedAt"))
    asset = F.when(n % 7 == 0, F.concat(F.lit("x"), text_of("s_suppkey"))).otherwise(text_of("s_suppkey"))
    of = lambda k, v: F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v))))
    doc = s.agg(F.to_json(F.struct(F.lit(2).alias("version"), of(h, entry).alias("hashes"), of(asset, F.concat(F.lit("k"), text_of("s_suppkey"))).alias("mediaAssets"))))
    src.write_document(doc, f"{folder}/content.json")
    hashes, assets = src.content_ledger(spark, f"{folder}/content.json")
    return hashes.select(F.lit("hash").alias("part"), F.col("hash").alias("id"), "key", "bytes").unionByName(assets.select(F.lit("asset").alias("part"), F.col("asset").alias("id"), "key", F.lit(0).cast("long").alias("bytes")))


@query("ledger_rows_file", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_nationkey AS n FROM customer WHERE c_custkey % 2 = 0")
def ledger_rows_file(t):
    """A ledger of any size, replaced as a whole: only what was written last is there."""
    c = t("customer").select(text_of("c_custkey").alias("key"), F.col("c_nationkey").alias("n"), "c_custkey")
    spark, folder = place(c)
    src.write_ledger(c.drop("c_custkey"), f"{folder}/rows")
    src.write_ledger(c.filter("c_custkey % 2 = 0").drop("c_custkey"), f"{folder}/rows")
    return spark.read.schema("key string, n int").json(f"{folder}/rows")


@query("ledger_entries_file", "SELECT 'item-key-' || o_orderkey AS key, CAST(row_number() OVER (ORDER BY 'item-key-' || o_orderkey) - 1 AS BIGINT) AS ord, CAST(o_custkey AS BIGINT) AS n, o_orderpriority || ', {\"' AS note FROM orders")
def ledger_entries_file(t):
    """A document read entry by entry, as large ones are: places, names and values, whatever commas and brackets the texts hold."""
    o = t("orders").select(F.concat(F.lit("item-key-"), text_of("o_orderkey")).alias("key"), F.col("o_custkey").cast("long").alias("n"), F.concat("o_orderpriority", F.lit(', {"')).alias("note"))
    spark, folder = place(o)
    src.write_ledger_document(o, f"{folder}/ledger.json")
    rows = documents.entries(spark, f"{folder}/ledger.json", "items")
    return rows.select(F.col("name").alias("key"), "ord", F.from_json("value", "n long, note string").alias("v")).select("key", "ord", "v.*")


@query("key_list_file", "SELECT DISTINCT 'item-key-' || (c_custkey % 700) AS key FROM customer")
def key_list_file(t):
    """Keys with blanks around them, blank lines and repeats."""
    k = t("customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise(""), F.lit("item-key-"), (F.col("c_custkey") % 700).cast("string"), F.lit(" ")).alias("key"))
    spark, folder = place(k)
    src.write_keys(k.unionByName(k.limit(3).select(F.lit("").alias("key"))), f"{folder}/keys")
    return src.key_list(spark, f"{folder}/keys")


@query("sorted_keys", "SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT 'item-key-' || (c_custkey % 90) AS key FROM customer)")
def sorted_keys(t):
    """A merged key list as it is written: in order, each key at its place."""
    k = t("customer").select(F.concat(F.lit("item-key-"), (F.col("c_custkey") % 90).cast("string")).alias("key"))
    spark, folder = place(k)
    store.one_file(src.merged_keys(k, k.limit(0)).select("key", F.col("key").alias("o")), f"{folder}/keys.txt", ["o"])
    return src.lines(spark, f"{folder}/keys.txt").select(F.col("line").alias("key"), F.col("line_no").alias("place"))


# ---- logs


def logs(t, bad, line):
    """A log file for each day of the events, in order of ``event_id``; each ``bad``-th line is noise."""
    e = t("events").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    spark, folder = place(e)
    value = F.when(F.col("event_id") % bad == 0, "noise, not a row").otherwise(line).alias("value")
    ordered = e.repartition("day").sortWithinPartitions("day", "event_id").select("day", value)
    ordered.write.partitionBy("day").text(f"{folder}/raw")
    for day in store.children(spark, f"{folder}/raw"):  # a folder for each day
        for k, part in enumerate(n for n in store.children(spark, f"{folder}/raw/{day}") if n.startswith("part-")):
            store.move(spark, f"{folder}/raw/{day}/{part}", f"{folder}/logs/download-{day.split('=')[1]}-{k:06d}.log")
    store.put(spark, f"{folder}/logs/other.log", '{"viewkey": "z", "status": "downloaded"}\n')
    return spark, f"{folder}/logs"


_LINE = "CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS BIGINT)"


@query("result_log_files", f"""SELECT * FROM (SELECT event_id, 'download-' || strftime(ts, '%Y%m%d') || '-000000.log' AS file_name, {_LINE} AS line_no, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS logged_at, CAST(user_id AS VARCHAR) AS viewkey, {CASE} AS status, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS bytes FROM events) WHERE event_id % 50 <> 0""")
def result_log_files(t):
    """All events as result logs, a file a day; noise and files of other names are passed over, lines keep their numbers."""
    row = F.to_json(F.struct(text_of("user_id").alias("viewkey"), status().alias("status"), F.floor("value").cast("long").alias("bytes"), F.col("event_id").alias("n")))
    log = src.result_log(*logs(t, 50, row))
    return log.select(F.get_json_object("raw", "$.n").cast("long").alias("event_id"), "file_name", "line_no", F.col("logged_at").cast("timestamp_ntz").alias("logged_at"), "viewkey", "status", "bytes")


@query("content_from_logs", f"""SELECT hash, arg_min(key, o) AS key, arg_min(bytes, o) AS bytes FROM (SELECT sha256(props) AS hash, CAST(user_id AS VARCHAR) AS key, CAST(floor(value) AS BIGINT) AS bytes, (CAST(ts AS DATE) - DATE '2000-01-01') * 1000000000 + event_id AS o FROM events WHERE event_id % 50 <> 0 AND event_id % 3 = 0 AND user_id % 7 <> 0) GROUP BY hash""")
def content_from_logs(t):
    """A content ledger from the logs: the first row of each whole hash with a key."""
    h = F.when(F.col("event_id") % 3 == 0, F.sha2("props", 256)).when(F.col("event_id") % 3 == 1, "").otherwise(F.upper(F.sha2("props", 256)))
    key = F.when(F.col("user_id") % 7 == 0, "").otherwise(text_of("user_id"))
    row = F.to_json(F.struct(key.alias("viewkey"), F.lit("downloaded").alias("status"), F.floor("value").cast("long").alias("bytes"), h.alias("sha256")))
    return src.content_from_logs(src.result_log(*logs(t, 50, row))).select("hash", "key", "bytes")


_DAYS = "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1"


@query("run_history_file", f"SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS BIGINT) AS line_no, CASE WHEN n % 2 = 0 THEN 'repair' END AS taskType, CAST(e AS VARCHAR) AS failedVideos, strftime(day, '%Y-%m-%d') AS timestamp FROM ({_DAYS}) QUALIFY e % 5 <> 0")
def run_history_file(t):
    """One event a day, appended in order; broken lines are left out but counted."""
    d = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    spark, folder = place(d)
    row = F.to_json(F.struct(text_of("day").alias("timestamp"), F.when(F.col("n") % 2 == 0, "repair").alias("taskType"), F.col("e").alias("failedVideos")))
    store.one_file(d.select(F.when(F.col("e") % 5 == 0, F.concat(F.lit("{"), row)).otherwise(row).alias("line"), "day"), f"{folder}/runs.jsonl", ["day"])
    return src.run_history(spark, f"{folder}/runs.jsonl").select("line_no", "taskType", "failedVideos", "timestamp")


@query("event_append", "SELECT event_type AS task, 2 * count(*) AS n FROM events GROUP BY 1")
def event_append(t):
    """Rows appended twice are there twice."""
    e = t("events").select("event_type", "event_id")
    spark, folder = place(e)
    src.append_events(e, f"{folder}/runs")
    src.append_events(e, f"{folder}/runs")
    return spark.read.schema("event_type string, event_id long").json(f"{folder}/runs").groupBy(F.col("event_type").alias("task")).agg(F.count(F.lit(1)).alias("n"))


@query("tolerant_json", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_id % 6 IN (2, 4, 5)")
def tolerant_json(t):
    """Of broken objects, bare values, arrays and objects, only the objects are rows."""
    n = F.col("event_id") % 6
    line = F.when(n == 0, F.concat(F.lit("{"), F.col("props"))).when(n == 1, "17").when(n == 3, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.col("props"))
    return src.tolerant_json(t("events").select("event_id", line.alias("line")), "k long").select("event_id", "row.k")


@query("json_default", "SELECT 'missing' AS file, 'default' AS found UNION ALL SELECT 'broken', 'default' UNION ALL SELECT 'whole', CAST(count(*) AS VARCHAR) FROM region")
def json_default(t):
    """A missing or broken document reads as the default."""
    r = t("region")
    spark, folder = place(r)
    store.put(spark, f"{folder}/broken.json", '{"n": ')
    src.write_document(r.agg(F.to_json(F.struct(F.count(F.lit(1)).cast("string").alias("n")))), f"{folder}/whole.json")
    return spark.createDataFrame([(name, src.json_document(spark, f"{folder}/{name}.json", {"n": "default"})["n"]) for name in ("missing", "broken", "whole")], "file string, found string")


# ---- directories


_EXT = "CASE n_nationkey % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'MKV' WHEN 2 THEN 'txt' ELSE 'mp4.part' END"


def media_files(t):
    n = t("nation").select("n_nationkey", "n_name")
    spark, folder = place(n)
    for r in n.collect():  # 25 rows
        ext = ("mp4", "MKV", "txt", "mp4.part")[r.n_nationkey % 4]
        store.put(spark, f"{folder}/{'sub/' if r.n_nationkey % 3 else ''}item-key-{r.n_nationkey}.{ext}", "x" * (len(r.n_name) if r.n_nationkey % 5 else 0))
    return spark, folder


@query("directory_files", f"SELECT 'item-key-' || n_nationkey AS key, CAST(length(n_name) AS BIGINT) AS size_bytes, lower({_EXT}) AS extension FROM nation WHERE n_nationkey % 4 < 2 AND n_nationkey % 5 <> 0")
def directory_files(t):
    """Media files of a folder and below: size and extension; contents are not read, empty files don't count."""
    return src.directory(*media_files(t)).select(src.stem(F.col("path")).alias("key"), "size_bytes", "extension")


@query("directory_keys", "SELECT 'item-key-' || n_nationkey AS key FROM nation WHERE n_nationkey % 4 < 2 AND n_nationkey % 5 <> 0")
def directory_keys(t):
    return src.file_keys(src.directory(*media_files(t)))


@query("directory_partials", "SELECT 'item-key-' || n_nationkey || '.mp4' AS name, CAST(length(n_name) AS BIGINT) AS size_bytes FROM nation WHERE n_nationkey % 4 = 3 AND n_nationkey % 5 <> 0")
def directory_partials(t):
    return src.partial_files(*media_files(t)).select(src.stem(F.col("path")).alias("name"), "size_bytes")


# ---- snapshots and queues


@query("snapshot_file", "SELECT 'item-key-' || s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS title, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '1,' || s_suppkey END AS pages, 'm' AS media_url, s_suppkey AS ord FROM supplier WHERE s_suppkey % 8 <> 0")
def snapshot_file(t):
    """A snapshot document, written and read; keys of another shape are left out, nulls read as blanks."""
    s = t("supplier")
    spark, folder = place(s)
    n, blank = F.col("s_suppkey"), F.lit(None).cast("string")
    pages = F.when(n % 3 > 0, F.array(F.lit(1), n.cast("int")))
    items = s.select(n.alias("ord"), item_key("s_suppkey", 8).alias("key"), blank.alias("canonical_url"), F.when(n % 2 == 0, F.col("s_name")).alias("title"), blank.alias("thumbnail_url"), blank.alias("duration"), F.lit("m").alias("media_url"), blank.alias("resolved_at"), blank.alias("asset_id"), pages.alias("source_pages"))
    src.write_document(src.snapshot_document(items, {"unique_videos": 1}), f"{folder}/snapshot.json")
    back = src.snapshot_items(spark, f"{folder}/snapshot.json")
    return back.select("key", "title", F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ",").alias("pages"), "media_url", "ord")


@query("snapshot_types", "SELECT 'item-key-' || n_nationkey AS key, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey || ',1' ELSE '' END AS pages FROM nation")
def snapshot_types(t):
    """Pages that are no whole numbers, entries that are no objects, and an earlier row of each key."""
    n = t("nation").select("n_nationkey", "n_name")
    spark, folder = place(n)
    rows = n.collect()  # 25 rows
    videos = [{"viewkey": f"item-key-{r.n_nationkey}", "title": "old", "source_pages": [7]} for r in rows] + [1, "x", None, [], {"key": "item-key-1"}, {"viewkey": "short"}]
    videos += [{"viewkey": f"item-key-{r.n_nationkey}", "title": r.n_name, "source_pages": [r.n_nationkey, "2", 2.5, None, True] if r.n_nationkey % 2 == 0 else "3"} for r in rows]
    store.put(spark, f"{folder}/snapshot.json", json.dumps({"metadata": {}, "videos": videos}))
    return src.snapshot_items(spark, f"{folder}/snapshot.json").select("key", "title", F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("queue_file", "SELECT 'k' || (s_suppkey % 60) AS key, min(s_suppkey) AS ord FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 60 <> 0 GROUP BY 1")
def queue_file(t):
    """A queue document: rows without key or address are passed over, of equal keys and addresses the first stays."""
    s = t("supplier")
    spark, folder = place(s)
    n = F.col("s_suppkey")
    key = F.when(n % 60 == 0, "").otherwise(F.concat(F.lit("k"), (n % 60).cast("string")))
    url = F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("https://m.example/"), (n % 60).cast("string"), F.lit(".mp4")))
    video = F.struct(key.alias("viewkey"), url.alias("media_url"), F.when(n % 2 == 0, "https://lists.example/view?key=x").otherwise("").alias("canonical_url"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(n.alias("o"), video.alias("v")))), lambda x: x["v"])
    src.write_document(s.agg(F.to_json(F.struct(listed.alias("videos")))), f"{folder}/queue.json")
    return dedupe.greedy_queue(src.queue_items(spark, f"{folder}/queue.json"), settled_in_shared_folder).select("key", "ord")


@query("queue_problems", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'key' WHEN s_suppkey % 5 = 1 THEN 'address' WHEN s_suppkey % 5 = 2 THEN 'page' END AS problem FROM supplier")
def queue_problems(t):
    n = F.col("s_suppkey")
    bad = t("supplier").select(n, F.when(n % 5 == 0, "a b").otherwise("k_1-é").alias("key"), F.when(n % 5 == 1, F.when(n % 2 == 0, "http://m.example/1.mp4").otherwise("https://10.1.1.1/1.mp4")).otherwise("https://m.example/1.mp4").alias("url"), F.when(n % 5 == 2, "https://other.example/").when(n % 5 == 3, "").otherwise("https://lists.example/view").alias("canonical_url"))
    return bad.select("s_suppkey", src.queue_problem().alias("problem"))


@query("config_sources", "SELECT CAST(r_regionkey AS INT) AS ord, lower(r_name) AS name, 'https://lists.example/list?a=' || r_regionkey || '&category=' || lower(r_name) AS url, CAST(3 AS INT) AS pages FROM region")
def config_sources(t):
    """A deployment's sources: names from the category, addresses in one form; each page count is checked."""
    r = t("region")
    spark, folder = place(r)
    rows = [{"name": "", "url": f"https://LISTS.example:443/list?category={x.r_name.lower()}&a={x.r_regionkey}#top"} for x in r.orderBy("r_regionkey").collect()]  # 5 rows
    store.put(spark, f"{folder}/sources.json", json.dumps({"pagesPerSource": 3, "sources": rows}))
    return src.sources(spark, f"{folder}/sources.json")


@query("config_problems", "SELECT 'none' AS changed, false AS refused UNION ALL SELECT 'pages', true UNION ALL SELECT 'truth', true UNION ALL SELECT 'empty', true UNION ALL SELECT 'host', true UNION ALL SELECT 'duplicate', true UNION ALL SELECT 'many', true")
def config_problems(t):
    """What a list of sources is refused for."""
    spark = t("region").sparkSession
    one = {"name": "a", "url": "https://lists.example/list?a=1&b=2"}
    cases = {
        "none": {"pagesPerSource": 20, "sources": [one]}, "pages": {"pagesPerSource": 21, "sources": [one]}, "truth": {"pagesPerSource": True, "sources": [one]}, "empty": {"pagesPerSource": 1, "sources": []},
        "host": {"pagesPerSource": 1, "sources": [{"url": "https://other.example/list"}]}, "duplicate": {"pagesPerSource": 1, "sources": [one, {"name": "b", "url": "https://lists.example/list?b=2&a=1#x"}]}, "many": {"pagesPerSource": 1, "sources": [{"url": f"https://lists.example/list?a={k}"} for k in range(21)]},
    }

    def refused(config):
        try:
            src.checked_sources(spark, config)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(k, refused(c)) for k, c in cases.items()], "changed string, refused boolean")


@query("manifest_in_order", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS place, s_name AS name FROM supplier")
def manifest_in_order(t):
    """Results in the order of the queue, whatever the order they came in."""
    s = t("supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name")).orderBy(F.desc("name"))
    spark, folder = place(s)
    store.one_file(src.manifest(s).select("name", "ord"), f"{folder}/manifest.txt", ["ord"])
    return src.lines(spark, f"{folder}/manifest.txt").select(F.col("line_no").alias("place"), F.col("line").alias("name"))


# ---- publication and backup


@query("publish_suppressed", "SELECT CAST(1 AS INT) AS step, true AS wrote, count(*) AS n FROM nation UNION ALL SELECT 2, false, count(*) FROM nation UNION ALL SELECT 3, true, count(*) FROM nation WHERE n_regionkey = 1")
def publish_suppressed(t):
    """A table is written, not written again where only the time differs, and written where a row does."""
    n = t("nation").select("n_nationkey", "n_regionkey", F.lit("now").alias("generated_at"))
    spark, folder = place(n)
    out = []
    for step, rows in enumerate((n, n.withColumn("generated_at", F.lit("later")), n.filter("n_regionkey = 1")), 1):
        out.append((step, src.publish(rows, f"{folder}/snapshot"), spark.read.schema(n.schema).json(f"{folder}/snapshot").count()))
    return spark.createDataFrame(out, "step int, wrote boolean, n long")


@query("backup_versions", "SELECT lpad(CAST(k AS VARCHAR), 2, '0') AS version, (SELECT count(*) FROM region) + k AS changed FROM (SELECT unnest([4, 5, 6, 7, 8, 9, 10]) AS k)")
def backup_versions(t):
    """Ten changes and as many backups without a change: the newest seven versions stay, each with its own content."""
    r = t("region").select("r_regionkey", "r_name")
    spark, folder = place(r)
    n = r.count()
    for k in range(1, 11):
        store.put(spark, f"{folder}/live.txt", "x\n" * (n + k))
        for stamp in (f"{k:02d}", f"{k:02d}-again"):
            backup_.backup(spark, {"live": f"{folder}/live.txt"}, f"{folder}/kept", stamp)
    rows = []
    for stamp in backup_.versions(spark, f"{folder}/kept"):
        backup_.restore(spark, f"{folder}/kept", {"live": f"{folder}/back.txt"}, stamp)
        rows.append((stamp, spark.read.text(f"{folder}/back.txt").count()))
    return spark.createDataFrame(rows, "version string, changed long")


@query("backup_restore", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_nationkey AS n FROM customer")
def backup_restore(t):
    """A ledger folder is kept, lost, and restored row by row with sizes and hashes checked."""
    c = t("customer").select(text_of("c_custkey").alias("key"), F.col("c_nationkey").alias("n"))
    spark, folder = place(c)
    src.write_ledger(c, f"{folder}/ledger")
    backup_.backup(spark, {"ledger": f"{folder}/ledger"}, f"{folder}/kept", "1")
    src.write_ledger(c.limit(1), f"{folder}/ledger")
    store.delete(spark, f"{folder}/ledger")
    backup_.restore(spark, f"{folder}/kept", {"ledger": f"{folder}/ledger"})
    return spark.read.schema("key string, n int").json(f"{folder}/ledger")


# ---- functions and rules without a query of their own so far


@query("overlay_id", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE CAST(page_id AS VARCHAR) END AS overlay FROM pages")
def overlay_id(t):
    n = F.col("page_id")
    element = F.when(n % 3 == 0, F.concat(F.lit("thumb_x"), text_of("page_id"))).when(n % 3 == 1, F.concat(F.lit("big-thumb_"), text_of("page_id"))).otherwise(F.concat(F.lit("thumb_"), text_of("page_id"), F.lit(" thumb_9")))
    return t("pages").select("page_id", urls.overlay_id(element).alias("overlay"))


@query("url_join", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://a.example/x/y/n' || page_id WHEN 1 THEN 'https://a.example/n' || page_id WHEN 2 THEN 'https://b.example/n' || page_id WHEN 3 THEN 'https://a.example/x/n' || page_id ELSE 'https://a.example/x/y/z?n=' || page_id END AS url FROM pages")
def url_join(t):
    n, s = F.col("page_id") % 5, text_of("page_id")
    link = F.when(n == 0, F.concat(F.lit("n"), s)).when(n == 1, F.concat(F.lit("/n"), s)).when(n == 2, F.concat(F.lit("//b.example/n"), s)).when(n == 3, F.concat(F.lit("../n"), s)).otherwise(F.concat(F.lit("?n="), s))
    return t("pages").select("page_id", urls.url_join(F.lit("https://a.example/x/y/z?q=1#f"), link).alias("url"))


@query("choose_media", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://m/' || page_id || '?SIG=1&e=2' WHEN 1 THEN 'https://m/' || page_id || '.mp4?st=1' WHEN 2 THEN 'https://m/' || page_id || '.webm' ELSE '' END AS url FROM pages")
def choose_media(t):
    """Most signature parameters first, then a playable extension, then the first of the list."""
    n, u = F.col("page_id") % 4, lambda tail: F.concat(F.lit("https://m/"), text_of("page_id"), F.lit(tail))
    found = F.when(n == 0, F.array(u(".mp4?sig=1&sig=2"), u("?SIG=1&e=2"), u(".mp4?sig=1&q=2"))).when(n == 1, F.array(u("?st=1"), u(".mp4?st=1"), u(".m4v?f=1"))).when(n == 2, F.array(u(".mov"), u(".webm"), u(".mp4"))).otherwise(F.array().cast("array<string>"))
    return t("pages").select("page_id", urls.choose_media(found).alias("url"))


@query("player_media", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://m.example/' || page_id || '.mp4,https://m.example/b.webm' WHEN 1 THEN 'https://m.example/' || page_id || '.mp4?a=1&b=2' END AS media FROM pages WHERE page_id % 3 < 2")
def player_media(t):
    """Tags go before bare addresses; comments, plain hosts and private ones give nothing."""
    s = text_of("page_id")
    body = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<!-- <video src="https://m.example/no.mp4"> --><video src="https://m.example/'), s, F.lit('.mp4"><source src="https://m.example/b.webm"></video> https://m.example/c.mp4')))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("<p>'https://m.example/"), s, F.lit(".mp4?a=1&amp;b=2' <!-- https://m.example/no.mp4 --></p>")))
        .otherwise(F.lit("http://m.example/a.mp4 https://10.0.0.1/a.mp4 https://localhost/a.mp4 https://m.example/a.txt"))
    )
    return pages_.player_media(t("pages").select("page_id", body.alias("html"))).select("page_id", F.array_join("media", ",").alias("media")).filter("media <> ''")


@query("accepted_media", "SELECT page_id, page_id % 5 = 0 AS ok FROM pages")
def accepted_media(t):
    n, s = F.col("page_id") % 5, text_of("page_id")
    u = F.when(n == 0, F.concat(F.lit("HTTPS://m.example/"), s, F.lit(".MP4?x"))).when(n == 1, F.concat(F.lit("http://m.example/"), s, F.lit(".mp4"))).when(n == 2, F.concat(F.lit("https://m.example/"), s, F.lit(".txt"))).when(n == 3, F.concat(F.lit("https://192.168.0.1/"), s, F.lit(".mp4"))).otherwise(F.concat(F.lit("https://m.example/mp4"), s))
    return t("pages").select("page_id", urls.accepted_media(u).alias("ok"))


@query("format_bytes", "SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', round(b / 1024, 1)) || ' KB' ELSE printf('%.1f', round(b / 1048576, 1)) || ' MB' END AS size FROM (SELECT o_orderkey, (o_orderkey % 37) * (o_orderkey % 37) * 512 AS b FROM orders)")
def format_bytes(t):
    n = (F.col("o_orderkey") % 37) * (F.col("o_orderkey") % 37) * 512
    return t("orders").select("o_orderkey", text.format_bytes(n).alias("size"))


@query("format_duration", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS shown FROM (SELECT o_orderkey, o_orderkey * 7 % 20000 AS s FROM orders)")
def format_duration(t):
    return t("orders").select("o_orderkey", text.format_duration(F.col("o_orderkey") * 7 % 20000).alias("shown"))


@query("agent_label", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Edge' WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Chrome' WHEN 3 THEN 'Safari' ELSE 'Other' END AS label FROM events")
def agent_label(t):
    """The first family that matches: agents name more than one."""
    n = F.col("event_id") % 5
    agent = F.when(n == 0, "X Chrome/1 Safari/2 Edg/3").when(n == 1, "X Firefox/9").when(n == 2, "X Chrome/1 Safari/2").when(n == 3, "X Safari/2").otherwise("curl/8")
    return t("events").select("event_id", text.agent_label(agent).alias("label"))


@query("content_range", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS start, CASE WHEN event_id % 3 = 0 THEN event_id + 9 END AS \"end\", CASE WHEN event_id % 3 < 2 THEN event_id * 2 END AS total FROM events")
def content_range(t):
    n, s = F.col("event_id"), text_of("event_id")
    value = F.when(n % 3 == 0, F.concat(F.lit("bytes "), s, F.lit("-"), (n + 9).cast("string"), F.lit("/"), (n * 2).cast("string"))).when(n % 3 == 1, F.concat(F.lit(" bytes */"), (n * 2).cast("string"))).otherwise(F.concat(F.lit("items "), s))
    return t("events").select("event_id", text.content_range(value).alias("r")).select("event_id", "r.*")


@query("blocked_only_repairs", "SELECT day, b > 0 AND t = 0 AND f <= b AS blocked_only FROM (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'signup') % 3 AS b, count(*) FILTER (WHERE event_type = 'error') % 2 AS t, count(*) FILTER (WHERE event_type = 'click') % 4 AS f FROM events GROUP BY 1)")
def blocked_only_repairs(t):
    """Days whose repair left nothing but safe blocks."""
    day = t("events").groupBy(F.to_date("ts").alias("day")).agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("signup", "error", "click")])
    return day.select("day", rules.blocked_only(F.col("click") % 4, F.col("signup") % 3, F.col("error") % 2).alias("blocked_only"))


@query("current_manifest", "SELECT 'both' AS of, count(*) AS n FROM nation UNION ALL SELECT 'no request', 0 UNION ALL SELECT 'no queue', 0")
def current_manifest(t):
    """A manifest counts only where downloads were asked for and there was a queue."""
    n = t("nation")
    cases = {"both": (True, n), "no request": (False, n), "no queue": (True, n.limit(0))}
    out = None
    for name, (asked, queue) in cases.items():
        one = history.current_manifest(n, asked, queue).agg(F.lit(name).alias("of"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("latest_manual_crawl", "SELECT max(event_id) AS event_id FROM events WHERE user_id % 2 = 0 AND event_type <> 'view' AND event_id % 4 <> 0 AND (event_id % 7 = 0 OR (event_id % 3 = 0 AND event_id % 5 IN (1, 2)))")
def latest_manual_crawl(t):
    """The last manual crawl that tells of the credential: a clean exit, or a failure that a detector of version 2 on
    saw; versions and exit codes that are texts don't count, nor do truth values as versions, fields of inner objects
    and events without a timestamp."""
    n = F.col("event_id")
    version = F.when(n % 5 == 0, "1").when(n % 5 == 1, "2").when(n % 5 == 2, "3").when(n % 5 == 3, '"2"').otherwise("true")
    raw = F.concat(
        F.lit('{"trigger":"'), F.when(F.col("user_id") % 2 == 0, "manual").otherwise("daily"), F.lit('","taskType":'), F.when(F.col("event_type") == "view", '"repair"').otherwise("null"),
        F.lit(',"crawlExitCode":'), F.when(n % 7 == 0, "0").when(n % 7 == 1, '"0"').otherwise("1"), F.lit(',"inner":{"crawlExitCode":0,"authDetectorVersion":"2"}'),
        F.when(n % 4 == 0, "").otherwise(',"timestamp":"2024-01-01T00:00:00Z"'), F.lit(',"authFailure":'), F.when(n % 3 == 0, "true").otherwise("false"), F.lit(',"authDetectorVersion":'), version, F.lit("}"),
    )
    e = src.run_events(t("events").select(n.alias("line_no"), raw.alias("line")))
    return history.latest_manual_crawl(e).select(F.col("line_no").alias("event_id"))


@query("argument_bounds", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NOT (v BETWEEN 1 AND 20) WHEN 1 THEN NOT (v / 10.0 BETWEEN 0.5 AND 60) WHEN 2 THEN v < 0 ELSE true END AS refused FROM (SELECT o_orderkey, o_orderkey % 900 - 100 AS v FROM orders)")
def argument_bounds(t):
    n, v = F.col("o_orderkey"), (F.col("o_orderkey") % 900 - 100).cast("double")
    name = F.when(n % 4 == 0, "pages").when(n % 4 == 1, "delay").when(n % 4 == 2, "limit").otherwise("unknown")
    return t("orders").select(n, runs.out_of_bounds(name, F.when(n % 4 == 1, v / 10).otherwise(v)).alias("refused"))


@query("error_kinds", "SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events")
def error_kinds(t):
    return history.error_kinds(t("events").select(F.col("event_type").alias("kind"))).select(F.array_join("kinds", ",").alias("kinds"))


@query("stale_links", "SELECT event_id, event_id % 4 = 3 OR date_diff('second', ts, TIMESTAMP '2024-02-01 00:00:00') > 864000 AS stale FROM events")
def stale_links(t):
    """Links older than ten days, and those whose time can't be read."""
    at = F.when(F.col("event_id") % 4 == 3, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t("events").select("event_id", rules.stale(at, F.lit("2024-02-01T00:00:00Z").cast("timestamp"), F.lit(864000)).alias("stale"))


@query("adopted_assets", "SELECT coalesce(o.asset, n.asset) AS asset, coalesce(n.key, o.key) AS key FROM (SELECT CAST(doc_id AS VARCHAR) AS asset, 'old' AS key FROM labels) o FULL JOIN (SELECT CAST(doc_id % 300 AS VARCHAR) AS asset, CAST(max(doc_id) AS VARCHAR) AS key FROM documents WHERE doc_id % 300 > 0 AND doc_id % 5 > 0 GROUP BY doc_id % 300) n ON n.asset = o.asset")
def adopted_assets(t):
    """Adoptions re-point an asset at its last adopter; blank assets and keys change nothing."""
    d = t("documents").select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 300 == 0, "").otherwise((F.col("doc_id") % 300).cast("string")).alias("asset"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(text_of("doc_id")).alias("key"))
    return dedupe.adopted_assets(t("labels").select(text_of("doc_id").alias("asset"), F.lit("old").alias("key")), d)


@query("newest_of_retained", "SELECT day FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) ORDER BY day DESC LIMIT 7")
def newest_of_retained(t):
    """The versions that stay, by the engine's own limit."""
    return Engine().retain(t("events").select(F.to_date("ts").alias("day")).distinct(), F.desc("day"))


# ---- whole tasks


@query("run_summary", f"""SELECT 'crawl' AS "taskType", 'attention' AS "resultStatus", count(*) FILTER (WHERE m AND s = 'downloaded') AS "downloadedVideos", count(*) FILTER (WHERE m AND s = 'skipped') AS "alreadyPresentVideos", count(*) FILTER (WHERE m AND s = 'duplicate') AS "duplicateVideos",
(SELECT count(DISTINCT user_id) FROM events WHERE user_id % 50 > 0 AND ((event_id % 2 = 0 AND event_type = 'signup') OR (event_id % 2 = 1 AND (event_type = 'click' OR event_id % 9 = 0)))) AS "blockedVideos",
count(*) FILTER (WHERE m AND s = 'failed') + count(*) FILTER (WHERE NOT m AND NOT (event_type = 'click' OR event_id % 9 = 0)) AS "failedVideos", (SELECT count(*) FROM nation) AS "listingFailures",
count(*) FILTER (WHERE NOT m AND event_type = 'error') + (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS "authChallenges", CAST(sum(CASE WHEN m AND s = 'downloaded' THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS "downloadedBytes",
CAST(sum(CASE WHEN m THEN k ELSE 0 END) AS BIGINT) AS "autoRetryAttempts", count(*) FILTER (WHERE m AND k > 0) AS "autoRetriedVideos", count(*) FILTER (WHERE m AND k > 0 AND s IN ('downloaded', 'skipped', 'duplicate')) AS "autoRecoveredVideos", CAST(7 AS BIGINT) AS "uniqueVideos", CAST(90.0 AS DOUBLE) AS "durationSeconds"
FROM (SELECT *, event_id % 2 = 0 AS m, {CASE} AS s, event_id % 4 AS k FROM events)""")
def run_summary(t):
    """One event of a run: even events are its manifest, odd ones its failures, nations its listing failures."""
    e, key = t("events"), F.when(F.col("user_id") % 50 == 0, "").otherwise(text_of("user_id")).alias("viewkey")
    manifest = e.filter("event_id % 2 = 0").select(key, status().alias("status"), F.floor("value").cast("long").cast("string").alias("bytes"), (F.col("event_id") % 4).cast("string").alias("autoRetries"))
    kind = F.when(F.col("event_type") == "click", "media_unavailable").when(F.col("event_type") == "error", "auth_challenge").otherwise("request_error")
    failures = e.filter("event_id % 2 = 1").select(key, kind.alias("kind"), F.when(F.col("event_id") % 9 == 0, "it does not match the listing").otherwise("x").alias("error"))
    listing = t("nation").select(F.when(F.col("n_regionkey") == 2, "auth_challenge").otherwise("timeout").alias("kind"))
    run = runs.Run(0, 0, True, "manual", "2024-01-01T00:00:00Z", "2024-01-01T00:01:30Z", 2, 9, {"unique_videos": 7})
    out = Engine().summarise_run(run, manifest, failures, listing)
    return out.select("taskType", "resultStatus", "downloadedVideos", "alreadyPresentVideos", "duplicateVideos", "blockedVideos", "failedVideos", "listingFailures", "authChallenges", "downloadedBytes", "autoRetryAttempts", "autoRetriedVideos", "autoRecoveredVideos", "uniqueVideos", "durationSeconds")


@query("engine_inventory", f"""WITH k AS (SELECT DISTINCT regexp_replace(href, '^/', '') AS key FROM ({ANCHORS}) WHERE regexp_matches(regexp_replace(href, '^/', ''), '^[A-Za-z0-9_-]{{6,64}}$'))
SELECT key, CASE WHEN length(key) % 5 = 0 THEN 'ignored' WHEN length(key) % 5 = 1 THEN 'skip' WHEN length(key) % 5 = 2 THEN 'retry' ELSE 'new' END AS queue_class FROM k""")
def engine_inventory(t):
    """Pages to a classified queue: by the length of their keys some are ignored, done, or seen without media."""
    html = F.regexp_replace("html", '<a href="/', '<a href="/view?key=')
    p = t("pages").select(F.lit(0).alias("source_idx"), F.col("page_id").cast("int").alias("page"), F.lit("https://lists.example/list").alias("base_url"), html.alias("html"))
    engine = Engine()
    keys = settled_in_shared_folder(engine.cards(p).select("key").distinct())
    of = lambda n: keys.filter(F.length("key") % 5 == n)
    blank = F.lit("")
    seen = of(2).select("key", *[blank.alias(c) for c in ("title", "thumbnail_url", "duration", "media_url", "resolved_at", "asset_id")])
    none = keys.limit(0).select("key", *[blank.alias(c) for c in ("expected_asset", "error", "kind", "first_seen_at", "last_seen_at")])
    return engine.build_inventory(p, seen, of(1), none, of(0), keys.limit(0))["queue"].select("key", "queue_class")


@query("engine_outcomes", f"""WITH r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS key, {CASE} AS status, sha256(props) AS hash FROM events), f AS (SELECT hash, arg_min(key, event_id) AS owner FROM r WHERE status = 'downloaded' GROUP BY hash)
SELECT 'claims' AS ledger, count(*) AS n FROM r JOIN f USING (hash) WHERE status = 'downloaded' AND f.owner <> r.key UNION ALL SELECT 'success', count(DISTINCT key) FROM r WHERE status IN ('downloaded', 'skipped', 'duplicate')
UNION ALL SELECT 'blocked', count(DISTINCT c_custkey) FROM customer WHERE 'item-key-' || c_custkey IN (SELECT 'item-key-' || user_id FROM events WHERE event_type = 'signup')""")
def engine_outcomes(t):
    """Outcomes into ledgers: how many claims are duplicates, how many keys succeeded, how many are blocked."""
    e = t("events")
    key = F.concat(F.lit("item-key-"), text_of("user_id"))
    results = e.select(F.col("event_id").alias("ord"), text_of("user_id").alias("key"), status().alias("status"), F.sha2("props", 256).alias("sha256"), F.lit("0").alias("bytes"), F.lit("0").alias("autoRetries"))
    failures = e.select(F.col("event_id").alias("ord"), key.alias("key"), F.when(F.col("event_type") == "signup", "media_mismatch").otherwise("request_error").alias("kind"), F.lit("").alias("error"))
    items = t("customer").select(F.concat(F.lit("item-key-"), text_of("c_custkey")).alias("key"), F.lit("").alias("thumbnail_url"))
    empty = results.limit(0).select("key", *[F.lit("").alias(c) for c in ("expected_asset", "error", "kind", "first_seen_at", "last_seen_at")])
    out = Engine().apply_outcomes(items, results, failures, empty, results.limit(0).select("key"), results.limit(0).select(F.col("sha256").alias("hash"), "key"), "now")
    count = lambda name, df: df.agg(F.lit(name).alias("ledger"), F.count(F.lit(1)).alias("n"))
    return count("claims", out["claims"].filter("is_duplicate")).unionByName(count("success", out["success"])).unionByName(count("blocked", out["blocked"]))


@query("engine_identity", "SELECT true AS same_in_any_order, false AS same_with_a_row_more, true AS same_without_the_time, count(*) AS n FROM customer")
def engine_identity(t):
    """A table's identity: the order of rows does not matter, a row more does, an ignored column does not."""
    c = t("customer").select("c_custkey", "c_name", F.lit("now").alias("at"))
    engine = Engine()
    one, two, three, four = (engine.identity(df, "at").first() for df in (c, c.orderBy(F.desc("c_name")), c.unionByName(c.limit(1)), c.withColumn("at", F.lit("later"))))
    return c.sparkSession.createDataFrame([(one == two, one == three, one == four, one.n)], "same_in_any_order boolean, same_with_a_row_more boolean, same_without_the_time boolean, n long")
