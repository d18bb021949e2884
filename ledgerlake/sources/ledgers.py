"""Readers and writers of ledgers, logs, queues, settings and directories."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import DEFAULT, Settings
from ..functions.text import blank, valid_key
from ..functions.urls import extension, host, normalized_source, public_host, source_name
from ..functions.rules import LOG_NAME, log_time
from ..operators.ranking import last_per
from . import documents, store

#: Documents of more bytes than this are read entry by entry, by many tasks; smaller ones in one row.
LARGE = 64 << 20


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line_no, line) of text files, blank lines left out.

    Files are read in splits; the lines of each split are counted first, and a line's number is that of its
    place in the split after all splits before it in its file.
    """
    from pyspark.sql import Window

    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = raw.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = raw.join(splits.select("file", "at", (before - F.col("first")).alias("shift")), ["file", "at"])
    return numbered.select(F.element_at(F.split("file", "/"), -1).alias("file_name"), (F.col("id") + F.col("shift")).alias("line_no"), "line").filter(F.trim("line") != "")


def json_document(spark: SparkSession, path: str, default: dict | list | None = None):
    """One small JSON document as Python values; the default where it is missing or broken."""
    if not store.exists(spark, path):
        return default
    rows = _whole(spark, path).collect()  # one file
    try:
        return json.loads(rows[0][0])
    except (IndexError, ValueError):
        return default


def tolerant_json(rows: DataFrame, schema, column: str = "line") -> DataFrame:
    """Rows whose text is a JSON object, parsed beside it; other lines are left out."""
    kind = F.coalesce(F.try_parse_json(column).isNotNull(), F.lit(False)) & F.ltrim(F.col(column)).startswith("{")
    return rows.filter(kind).withColumn("row", F.from_json(column, schema))


def result_log(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of result logs, in order of file name and line: (file_name, line_no, logged_at, raw, fields...)."""
    named = lines(spark, path).filter(F.col("file_name").rlike(LOG_NAME))
    return tolerant_json(named, schemas.RESULTS).select("file_name", "line_no", log_time(F.col("file_name")).alias("logged_at"), F.col("line").alias("raw"), "row.*")


def run_history(spark: SparkSession, path: str) -> DataFrame:
    """Run events with their line numbers and raw lines; broken lines are left out."""
    return run_events(lines(spark, path))


def run_events(rows: DataFrame) -> DataFrame:
    """Run events of ``rows`` (line_no, line). Fields whose type matters stay JSON text: 0 and "0" differ, null is null."""
    whole = F.try_parse_json("line")
    typed = {c: F.nullif(F.to_json(F.try_variant_get(whole, f"$.{c}", "variant")), F.lit("null")) for c in schemas.JSON_TEXT}
    events = tolerant_json(rows, schemas.RUN_EVENTS).select("line_no", "line", "row.*").withColumns(typed)
    return events.select("line_no", F.col("line").alias("raw"), *schemas.RUN_EVENTS.names)


def key_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("key")).filter("key <> ''").distinct()


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def snapshot_items(spark: SparkSession, path: str, settings: Settings = DEFAULT) -> DataFrame:
    """Items of a snapshot or archive document: valid keys only, the last of a key wins.

    Entries that are no objects are passed over, missing fields are blank, and of pages only whole numbers stay
    (truth values count as 1 and 0). A missing file has no items; a file that is no JSON raises.
    """
    empty = spark.createDataFrame([], "ord long, " + ", ".join(f"{c} string" for c in _ITEM[:-1]) + ", source_pages array<int>")
    if not store.exists(spark, path):
        return empty
    rows = _videos(spark, path).select("ord", *[_text("v", settings.key_field if c == "key" else c).alias(c) for c in _ITEM[:-1]], _ints("v", "source_pages").alias("source_pages"))
    return last_per(rows.filter(valid_key(F.col("key"), settings)), ["key"], ["ord"])


_ITEM = ("key", "canonical_url", "title", "thumbnail_url", "duration", "media_url", "resolved_at", "asset_id", "source_pages")


def _videos(spark: SparkSession, path: str) -> DataFrame:
    """(ord, v) of the objects in the list ``videos`` of a document, as variants."""
    if store.size(spark, path) > LARGE:
        rows = documents.entries(spark, path, "videos").select("ord", F.parse_json("value").alias("v"))
        return rows.filter(F.schema_of_variant("v").startswith("OBJECT"))
    doc = _whole(spark, path).select(F.parse_json("value").alias("d"))
    listed = doc.select(F.try_variant_get("d", "$.videos", "array<variant>").alias("videos"))
    rows = listed.select(F.posexplode("videos").alias("ord", "v")).select(F.col("ord").cast("long").alias("ord"), "v")
    return rows.filter(F.schema_of_variant("v").startswith("OBJECT"))


def _text(v: str, field: str) -> Column:
    """A field as text; blank for missing, null and empty values."""
    return F.coalesce(F.try_variant_get(v, f"$.{field}", "string"), F.lit(""))


def _ints(v: str, field: str) -> Column:
    found = F.coalesce(F.try_variant_get(v, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))
    kinds = F.filter(found, lambda x: F.schema_of_variant(x).isin("BIGINT", "BOOLEAN"))
    return F.transform(kinds, lambda x: F.coalesce(F.try_variant_get(x, "$", "int"), F.try_variant_get(x, "$", "boolean").cast("int")))


def queue_items(spark: SparkSession, path: str, settings: Settings = DEFAULT) -> DataFrame:
    """(ord, key, url, canonical_url, thumbnail_url, resolved_at) of a queue document, not yet deduplicated.

    Rows without key or address are passed over. Keys with other signs or over 64 of them, addresses that are not
    public https and item pages outside the settings' hosts raise, as does a document without a list.
    """
    doc = _whole(spark, path).select(F.parse_json("value").alias("d"))
    if doc.filter(F.try_variant_get("d", "$.videos", "array<variant>").isNotNull()).isEmpty():
        raise ValueError("a queue has a list of videos")
    rows = _videos(spark, path).select("ord", _text("v", settings.key_field).alias("key"), _text("v", "media_url").alias("url"), *[_text("v", c).alias(c) for c in ("canonical_url", "thumbnail_url", "resolved_at")])
    rows = rows.filter(~blank(F.col("key")) & ~blank(F.col("url")))
    return rows.withColumn("key", F.when(queue_problem(settings).isNull(), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("queue row "), F.col("ord").cast("string"), F.lit(": "), queue_problem(settings)))))


def queue_problem(settings: Settings = DEFAULT) -> Column:
    """Why a queue row can't be taken, else null. Reads key, url and canonical_url."""
    page = F.col("canonical_url")
    return (
        F.when(~F.col("key").rlike(r"\A[\p{L}\p{N}_-]{1,64}\z"), F.lit("key"))
        .when(~F.lower("url").startswith("https://") | ~public_host(host(F.col("url"))), F.lit("address"))
        .when(~blank(page) & (~F.lower(page).startswith("https://") | ~host(page).isin(*settings.hosts)), F.lit("page"))
    )


def ledger_map(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, fields...) of a ``{"items": {key: {...}}}`` document."""
    if store.size(spark, path) > LARGE:
        return _members(spark, path, "items", value_schema, "key")
    doc = _whole(spark, path).select(F.from_json("value", f"items MAP<STRING, STRUCT<{value_schema}>>").alias("d"))
    return doc.select(F.explode("d.items").alias("key", "v")).select("key", "v.*")


def _members(spark: SparkSession, path: str, member: str, value_schema: str, key: str) -> DataFrame:
    """(key, fields...) of a container of a large document; of repeated names the last counts."""
    named = documents.entries(spark, path, member).filter("name is not null")
    last = named.groupBy("name").agg(F.max(F.struct("ord", "value"))["value"].alias("value"))
    return last.select(F.col("name").alias(key), F.from_json("value", f"STRUCT<{value_schema}>").alias("v")).select(key, "v.*")


def blocked_ledger(spark: SparkSession, path: str, settings: Settings = DEFAULT) -> DataFrame:
    rows = ledger_map(spark, path, "expectedAsset: STRING, error: STRING, kind: STRING, firstSeenAt: STRING, lastSeenAt: STRING")
    named = rows.toDF("key", "expected_asset", "error", "kind", "first_seen_at", "last_seen_at")
    return named.filter(valid_key(F.col("key"), settings))


def ignored_keys(spark: SparkSession, path: str, settings: Settings = DEFAULT) -> DataFrame:
    """Keys of either form: a map by key, or a list of keys or of objects with ``viewkey``."""
    if store.size(spark, path) > LARGE:
        rows = documents.entries(spark, path, "items").withColumn("v", F.parse_json("value"))
        listed = F.coalesce(F.try_variant_get("v", "$.viewkey", "string"), F.try_variant_get("v", "$", "string"))
        return rows.select(F.coalesce("name", listed).alias("key")).filter(valid_key(F.col("key"), settings)).distinct()
    raw = _whole(spark, path).select(F.get_json_object("value", "$.items").alias("items"))
    as_map = raw.filter(F.ltrim("items").startswith("{")).select(F.explode(F.json_object_keys("items")).alias("key"))
    listed = raw.filter(F.ltrim("items").startswith("[")).select(F.explode(F.from_json("items", "array<string>")).alias("x"))
    as_list = listed.select(F.coalesce(F.get_json_object("x", "$.viewkey"), F.col("x")).alias("key"))
    return as_map.union(as_list).filter(valid_key(F.col("key"), settings)).distinct()


def content_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hashes, assets) of a content document; only 64-digit hashes and numeric assets count."""
    if store.size(spark, path) > LARGE:
        rows = _members(spark, path, "hashes", "viewkey: STRING, bytes: STRING, recordedAt: STRING", "hash")
        assets = documents.entries(spark, path, "mediaAssets").groupBy(F.col("name").alias("asset")).agg(F.max(F.struct("ord", "value"))["value"].alias("value"))
        assets = assets.select("asset", F.try_variant_get(F.parse_json("value"), "$", "string").alias("key"))
    else:
        doc = _whole(spark, path).select(F.from_json("value", "hashes MAP<STRING, STRUCT<viewkey: STRING, bytes: STRING, recordedAt: STRING>>, mediaAssets MAP<STRING, STRING>").alias("d"))
        rows = doc.select(F.explode("d.hashes").alias("hash", "v")).select("hash", "v.*")
        assets = doc.select(F.explode("d.mediaAssets").alias("asset", "key"))
    hashes = rows.select("hash", F.col("viewkey").alias("key"), F.coalesce(F.col("bytes").try_cast("long"), F.lit(0)).alias("bytes"), F.col("recordedAt").alias("recorded_at"))
    return hashes.filter(F.col("hash").rlike(r"\A[0-9a-f]{64}\z")), assets.filter(F.col("asset").rlike(r"\A\d+\z"))


def content_from_logs(results: DataFrame) -> DataFrame:
    """(hash, key, bytes, recorded_at) that result logs tell of, where there is no content document yet: the first
    row of each whole hash, in order of file and line. ``results``: from :func:`result_log`."""
    good = results.filter(F.col("sha256").rlike(r"\A[0-9a-f]{64}\z") & ~blank(F.col("viewkey")))
    first = good.groupBy(F.col("sha256").alias("hash")).agg(F.min(F.struct("file_name", "line_no", "viewkey", "bytes", "raw")).alias("m"))
    return first.select("hash", F.col("m.viewkey").alias("key"), F.coalesce(F.col("m.bytes").try_cast("long"), F.lit(0)).alias("bytes"), F.coalesce(F.get_json_object("m.raw", "$.recordedAt"), F.lit("")).alias("recorded_at"))


def directory(spark: SparkSession, path: str, settings: Settings = DEFAULT, recursive: bool = True) -> DataFrame:
    """(path, size_bytes, modified_at, extension) of media files; contents are not read, empty files not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ext = extension(F.col("path"))
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), ext.alias("extension")).filter(F.col("extension").isin(*settings.media_extensions))


def partial_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.part").load(path).select("path", F.col("length").alias("size_bytes"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?\z", 1)


def file_keys(files: DataFrame, settings: Settings | None = DEFAULT) -> DataFrame:
    """Keys that non-empty files stand for; without settings no key is checked."""
    keys = files.filter("size_bytes > 0").select(stem(F.col("path")).alias("key")).distinct()
    return keys.filter(valid_key(F.col("key"), settings)) if settings else keys


def sources(spark: SparkSession, path: str, settings: Settings = DEFAULT) -> DataFrame:
    """Configured sources (ord, name, url, pages); raises for bad or duplicate sources or page counts."""
    text = _whole(spark, path).first()[0]  # one small document
    return checked_sources(spark, json.loads(text), settings)


def checked_sources(spark: SparkSession, config: dict, settings: Settings = DEFAULT) -> DataFrame:
    pages, rows = config.get("pagesPerSource"), config.get("sources")
    if not isinstance(pages, int) or isinstance(pages, bool) or not 1 <= pages <= settings.max_pages:
        raise ValueError("pages per source out of range")
    if not isinstance(rows, list) or not rows or len(rows) > settings.max_sources:
        raise ValueError("number of sources out of range")
    df = spark.createDataFrame([(k, str((r or {}).get("name") or ""), str((r or {}).get("url") or "")) for k, r in enumerate(rows)], "ord int, name string, url string")
    from ..functions.urls import listing_problem

    df = df.select("ord", source_name(F.col("name"), F.col("url")).alias("name"), normalized_source(F.col("url")).alias("url"), listing_problem(F.col("url"), settings).alias("problem"))
    bad = df.withColumn("n", F.count(F.lit(1)).over(_by("url"))).filter("problem is not null or n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"source {bad[0].ord}: {bad[0].problem or 'duplicate'}")
    return df.select("ord", "name", "url", F.lit(pages).alias("pages"))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


# ---- writers


CSV_COLUMNS = ("key", "canonical_url", "title", "thumbnail_url", "duration", "source_pages", "media_url", "resolved_at")


def csv_rows(items: DataFrame) -> DataFrame:
    """The fixed projection of the CSV export; pages joined by commas."""
    return items.select(*[F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ",").alias(c) if c == "source_pages" else F.coalesce(F.col(c), F.lit("")).alias(c) for c in CSV_COLUMNS])


def write_csv(items: DataFrame, path: str) -> None:
    csv_rows(items).write.mode("overwrite").option("header", "true").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a row, in a new folder that then takes the place of the old one."""
    store.replace_with(rows, path)


def snapshot_document(items: DataFrame, metadata: dict, settings: Settings = DEFAULT) -> DataFrame:
    """One row with the snapshot document of an inventory of one deployment, in order of ``ord``. Large inventories
    go by :func:`write_json`, row by row."""
    entry = F.struct(F.col("key").alias(settings.key_field), *[F.coalesce(F.col(c), F.lit("")).alias(c) if c != "source_pages" else F.col(c) for c in _ITEM[1:]])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("v")))), lambda x: x["v"])
    meta = F.parse_json(F.lit(json.dumps(metadata)))
    return items.agg(F.to_json(F.struct(meta.alias("metadata"), listed.alias("videos"))).alias("document"))


def write_document(one: DataFrame, path: str) -> None:
    """The document of a one-row table as one file, replaced as a whole."""
    store.put(one.sparkSession, path, one.first()[0] + "\n")


def write_ledger(rows: DataFrame, path: str) -> None:
    """A ledger of any size: one JSON object a row, the folder replaced as a whole."""
    store.replace_with(rows, path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def merged_keys(known: DataFrame, new: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Sorted union of key lists without invalid keys."""
    return known.select("key").union(new.select("key")).filter(valid_key(F.col("key"), settings)).distinct().orderBy("key")


def write_keys(keys: DataFrame, path: str) -> None:
    store.replace_with(keys.select("key"), path, "text")


def ledger_document(rows: DataFrame, key: str = "key", version: int = 1) -> DataFrame:
    """One row with the JSON document of a small ledger, for exchange; large ones go by :func:`write_ledger`."""
    value = F.struct(*[c for c in rows.columns if c != key])
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), value))))
    return rows.agg(F.to_json(F.struct(F.lit(version).alias("version"), entries.alias("items"))).alias("document"))


def write_ledger_document(rows: DataFrame, path: str, key: str = "key", version: int = 1) -> None:
    """The document of :func:`ledger_document` for a ledger of any size, the folder replaced as a whole.

    Its part files, one behind the other, are the document; many tasks write them, an entry a line, in order of keys
    (a key that comes twice has two entries, in order of their values). :mod:`.documents` reads it.
    """
    member = F.to_json(F.create_map(F.col(key), F.struct(*[c for c in rows.columns if c != key])))
    entry = rows.select(F.lit(False).alias("last"), F.col(key).alias("key"), F.substring(member, F.lit(2), F.char_length(member) - 2).alias("text"))
    end = rows.sparkSession.range(1).select(F.lit(True).alias("last"), F.lit("").alias("key"), F.lit("}}").alias("text"))
    order = ("last", "key", "text")
    ordered = entry.unionByName(end).repartitionByRange(*order).sortWithinPartitions(*order)
    first = F.monotonically_increasing_id() == 0
    before = F.when(first, F.lit(f'{{"version":{version},"items":{{')).when(F.col("last"), "").otherwise(",")
    store.replace_with(ordered.select(F.concat(before, "text").alias("value")), path, "text")


def manifest(results: DataFrame) -> DataFrame:
    """Results in the order of the queue."""
    return results.orderBy("ord")


def digest(rows: DataFrame, *without: str) -> DataFrame:
    """(n, digest): identity of a table's rows in any order. Sums of row hashes, so nothing is collected."""
    body = F.to_json(F.struct(*sorted(c for c in rows.columns if c not in without)))
    h = F.conv(F.substring(F.sha2(body, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    g = F.conv(F.substring(F.sha2(body, 256), 16, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(h).cast("string"), F.sum(g).cast("string")), 256).alias("digest"))


def publish(rows: DataFrame, path: str, ignoring: tuple[str, ...] = ("generated_at",)) -> bool:
    """Writes unless what is there equals ``rows`` apart from the ignored columns; says whether it wrote."""
    spark = rows.sparkSession
    new = digest(rows, *ignoring).first()
    try:
        old = digest(spark.read.schema(rows.schema).json(path), *ignoring).first()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = None
    if old == new:
        return False
    write_json(rows, path)
    return True
