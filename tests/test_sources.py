import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources import ledgers as src
from ledgerlake.sources import pages as pg

BASE = "https://lists.example/list"


def card(key, cls="visible", title="t", img="/1.jpg", extra=""):
    return f'<a href="/view?key={key}&c={cls}"><img src="{img}"><span class="title">{title}</span><span class="duration">1:00</span>{extra}</a>'


def test_cards():
    one = pg.cards_of(card("xyz98765", title=" real   title ", extra='<i id="thumb_42"></i>'), BASE)
    assert one == [{"key": "xyz98765", "href": "https://lists.example/view?key=xyz98765&c=visible", "tracking_class": "visible", "title": "real title", "thumbnail_url": "https://lists.example/1.jpg", "duration": "1:00", "asset_id": "42"}]
    assert pg.cards_of(card("abcdefg", title="A girl&amp;#39;s &amp;quot;day&amp;quot;"), BASE)[0]["title"] == 'A girl\'s "day"'
    lost = '<a href="/view?key=first123"><span class="title">x</span>' + card("second12")
    assert [c["key"] for c in pg.cards_of(lost, BASE)] == ["second12"]
    assert pg.cards_of('<a href="/view?key=first123"><b>', BASE) == [] and pg.cards_of(None, None) == []
    inner = pg.cards_of('<a href="/view?key=first123"><span class="title">one<br>two</span> three</a>', BASE)[0]
    assert inner["title"] == "onetwo three"  # a void element inside keeps the capture open
    assert pg.cards_of('<a href="/view?key=first123"><img></a>', BASE)[0]["thumbnail_url"] == BASE
    assert pg.cards_of('<a href="/view?key=first123"></a>', BASE)[0]["thumbnail_url"] == ""
    assert pg.media_of('<!-- <video src="a"> --><script>"<video src=b>"</script><video src="c" poster="d"><source src="c"></video>') == [("media", "c"), ("poster", "d")]


def test_scan_cards(spark):
    rows = [(0, 1, BASE, card("xyz98765") + card("abc98765")), (0, 2, BASE, "<p>none</p>"), (1, 1, BASE, None)]
    got = pg.scan_cards(spark.createDataFrame(rows, "source_idx int, page int, base_url string, html string"))
    assert sorted((r.source_idx, r.page, r.card_ord, r.key) for r in got.collect()) == [(0, 1, 0, "xyz98765"), (0, 1, 1, "abc98765")]


def test_table_functions(spark):
    """The same cards and tags, called from SQL."""
    spark.udtf.register("listing_cards", pg.listing_cards())
    spark.udtf.register("media_tags", pg.media_tags())
    html = card("xyz98765") + card("abc98765") + '<video src="/a.mp4">'
    rows = spark.createDataFrame([(BASE, html)], "base string, html string")
    assert [r.key for r in spark.sql("SELECT c.* FROM {rows} p, LATERAL listing_cards(p.html, p.base) c", rows=rows).collect()] == ["xyz98765", "abc98765"]
    assert [tuple(r) for r in spark.sql("SELECT m.* FROM {rows} p, LATERAL media_tags(p.html) m", rows=rows).collect()] == [("media", "/a.mp4")]
    assert [tuple(r) for r in pg.scan_media(rows.selectExpr("1L as page_id", "html")).collect()] == [(1, "media", "/a.mp4")]


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_ledgers(spark, tmp_path):
    assert [r.key for r in src.key_list(spark, put(tmp_path / "k", " a \n\nb\na\n")).orderBy("key").collect()] == ["a", "b"]
    blocked = {"version": 1, "items": {"goodkey1": {"expectedAsset": "1", "error": "e", "kind": "media_mismatch", "firstSeenAt": "t", "lastSeenAt": "u"}, "bad": {"kind": "x"}}}
    assert [tuple(r) for r in src.blocked_ledger(spark, put(tmp_path / "b", blocked)).collect()] == [("goodkey1", "1", "e", "media_mismatch", "t", "u")]
    for items in ({"goodkey1": {"reason": "r"}}, ["goodkey1", "x"], [{"viewkey": "goodkey1"}, "goodkey1"]):
        assert [r.key for r in src.ignored_keys(spark, put(tmp_path / f"i{random.random()}", {"items": items})).collect()] == ["goodkey1"]
    hashes, assets = src.content_ledger(spark, put(tmp_path / "c", {"hashes": {"a" * 64: {"viewkey": "k", "bytes": "7"}, "zz": {"viewkey": "k"}}, "mediaAssets": {"12": "k", "x": "k"}}))
    assert [(r.key, r.bytes) for r in hashes.collect()] == [("k", 7)] and [tuple(r) for r in assets.collect()] == [("12", "k")]
    videos = {"videos": [{"viewkey": "goodkey1", "title": "old", "source_pages": [1, "x"]}, {"viewkey": "no"}, "odd", {"key": "goodkey2"}, {"viewkey": "goodkey1", "title": "new", "source_pages": [2, "3", 4.5, True]}, {"viewkey": "goodkey3", "source_pages": "1"}]}
    got = {r.key: (r.title, r.source_pages) for r in src.snapshot_items(spark, put(tmp_path / "s", videos)).collect()}
    assert got == {"goodkey1": ("new", [2, 1]), "goodkey3": ("", [])}
    assert src.snapshot_items(spark, str(tmp_path / "none")).count() == 0 and src.snapshot_items(spark, put(tmp_path / "l", {"videos": 1})).count() == 0
    with pytest.raises(Exception, match="MALFORMED"):
        src.snapshot_items(spark, put(tmp_path / "m", "{")).count()
    assert src.json_document(spark, str(tmp_path / "none"), {}) == {} and src.json_document(spark, put(tmp_path / "m2", "{"), []) == [] and src.json_document(spark, put(tmp_path / "m3", {"a": 1})) == {"a": 1}


def test_queue(spark, tmp_path):
    good = {"viewkey": "k-1", "media_url": "https://m.example/1.mp4", "canonical_url": "https://lists.example/view?key=k-1"}
    got = src.queue_items(spark, put(tmp_path / "q", {"videos": [good, {"viewkey": "x"}, 1, good | {"viewkey": "k_2", "canonical_url": ""}]})).orderBy("ord").collect()
    assert [(r.ord, r.key, r.canonical_url) for r in got] == [(0, "k-1", good["canonical_url"]), (3, "k_2", "")]
    for k, bad in enumerate((good | {"viewkey": "a b"}, good | {"viewkey": "k" * 65}, good | {"media_url": "http://m.example/1.mp4"}, good | {"media_url": "https://127.0.0.1/1.mp4"}, good | {"canonical_url": "https://other.example/"})):
        with pytest.raises(Exception, match="queue row 0"):
            src.queue_items(spark, put(tmp_path / f"b{k}", {"videos": [bad]})).collect()
    with pytest.raises(ValueError):
        src.queue_items(spark, put(tmp_path / "n", {}))


def test_backup(spark, tmp_path):
    from ledgerlake.sources import backup as bk

    (tmp_path / "live").mkdir()
    paths = {"success": put(tmp_path / "live/success.txt", "a\nb\n"), "empty": put(tmp_path / "live/empty.txt", ""), "gone": str(tmp_path / "live/none")}
    src.write_ledger(spark.createDataFrame([("k1", 1)], "key string, n int"), str(tmp_path / "live/blocks"))
    paths["blocks"] = str(tmp_path / "live/blocks")
    folder = str(tmp_path / "kept")
    assert bk.backup(spark, {"gone": paths["gone"]}, folder, "00") is None
    assert bk.backup(spark, paths, folder, "01") == "01" and bk.backup(spark, paths, folder, "02") == "01"
    for k in range(3, 12):
        put(tmp_path / "live/success.txt", f"{k}\n")
        bk.backup(spark, paths, folder, f"{k:02d}")
    assert bk.versions(spark, folder) == [f"{k:02d}" for k in range(5, 12)]
    targets = {n: str(tmp_path / "back" / n) for n in paths}
    assert len(bk.restore(spark, folder, targets, "06")) >= 2 and (tmp_path / "back/success").read_text() == "6\n" and [tuple(r) for r in spark.read.schema("key string, n int").json(targets["blocks"]).collect()] == [("k1", 1)]
    with pytest.raises(bk.Damaged):
        bk.restore(spark, folder, {"success": targets["success"]})
    rows = bk.version(spark, folder, "11").withColumn("content", F.when(F.col("name") == "success", F.lit(b"zz")).otherwise(F.col("content")))
    rows.write.parquet(f"{folder}/version=12")
    with pytest.raises(bk.Damaged, match="success"):
        bk.restore(spark, folder, {n: str(tmp_path / "no" / n) for n in paths})
    assert not (tmp_path / "no").exists()


def test_player_media(spark):
    rows = [(1, '<video src="https://m.example/a.mp4"><source src=" https://m.example/b.mp4?x=1 "></video> https://m.example/c.mp4'), (2, '<!-- https://m.example/no.mp4 --> "https://m.example/d.mp4?a=1&amp;b=2" http://m.example/e.mp4 https://m.example/f.txt'), (3, None), (4, '<source src="https://10.0.0.1/a.mp4">https://m.example/g.mp4')]
    got = {r.page_id: r.media for r in pg.player_media(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {1: ["https://m.example/a.mp4", "https://m.example/b.mp4?x=1"], 2: ["https://m.example/d.mp4?a=1&b=2"], 4: ["https://m.example/g.mp4"]}
    urls_ = spark.createDataFrame([(["https://m/a", "https://m/b.mp4?sig=1", "https://m/c?sig=1&token=2", "https://m/d.MP4?sig=1"],), ([],)], "u array<string>")
    from ledgerlake.functions.urls import choose_media

    assert [r[0] for r in urls_.select(choose_media(F.col("u"))).collect()] == ["https://m/c?sig=1&token=2", ""]


def test_lines_of_split_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in "ab":
        put(tmp_path / f"d/{name}.log", "".join(f"{name}{k}\n" + ("\n" if k % 7 == 0 else "") for k in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = sorted(map(tuple, src.lines(spark, str(tmp_path / "d")).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(f"{name}.log", k, x) for name in "ab" for k, x in enumerate((tmp_path / f"d/{name}.log").read_text().splitlines()) if x]
    assert got == sorted(want)


def test_logs(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    put(tmp_path / "logs/download-20240105-000000.log", 'noise\n{"viewkey":"a","status":"downloaded","bytes":100}\n[1]\n')
    put(tmp_path / "logs/repair-download-20240101-000000.log", '{"viewkey":"a","status":"downloaded","bytes":"999"}\n{"viewkey":"b","status":"failed"}\n{"viewkey":')
    put(tmp_path / "logs/other.log", '{"viewkey":"z","status":"downloaded"}\n')
    log = src.result_log(spark, str(tmp_path / "logs"))
    assert sorted((r.file_name[:6], r.line_no, r.viewkey) for r in log.collect()) == [("downlo", 1, "a"), ("repair", 0, "a"), ("repair", 1, "b")]
    from ledgerlake.operators.ledger import first_success

    first = first_success(log.select(F.col("viewkey").alias("key"), "status", "file_name", "line_no", F.col("logged_at").alias("at"), "bytes")).collect()
    assert [(r.key, str(r.date), r.bytes) for r in first] == [("a", "2024-01-05", 100)]
    events = src.run_history(spark, put(tmp_path / "runs.jsonl", '{"taskType":"crawl","crawlExitCode":"0"}\nnot-json\n{"taskType":"repair"}\n'))
    assert [(r.line_no, r.taskType) for r in events.orderBy("line_no").collect()] == [(0, "crawl"), (2, "repair")]


def test_directory(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    put(tmp_path / "d/goodkey1.mp4", "x")
    put(tmp_path / "d/sub/goodkey2.MKV", "y")
    put(tmp_path / "d/empty123.mp4", "")
    put(tmp_path / "d/goodkey3.mp4.part", "z")
    files = src.directory(spark, str(tmp_path / "d"))
    assert sorted(r.key for r in src.file_keys(files).collect()) == ["goodkey1", "goodkey2"] and files.count() == 2  # the reader leaves out empty files
    assert src.partial_files(spark, str(tmp_path / "d")).count() == 1


def test_sources(spark, tmp_path):
    good = {"pagesPerSource": 2, "sources": [{"name": "", "url": "https://lists.example/list?category=a"}, {"name": "B", "url": "https://lists.example/top"}]}
    assert [(r.name, r.pages) for r in src.sources(spark, put(tmp_path / "g", good)).orderBy("ord").collect()] == [("a", 2), ("B", 2)]
    twice = {"pagesPerSource": 2, "sources": [{"url": "https://lists.example/list?a=1&b=2"}, {"url": "https://LISTS.example/list?b=2&a=1#x"}]}
    for bad in (good | {"pagesPerSource": 21}, good | {"pagesPerSource": True}, good | {"sources": []}, good | {"sources": [{"url": "https://x.example/list"}]}, twice):
        with pytest.raises(ValueError):
            src.checked_sources(spark, bad)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("k1", 1, "now"), ("k2", 2, "now")], "key string, n int, generated_at string")
    path = str(tmp_path / "snap")
    assert src.publish(df, path) and not src.publish(df.withColumn("generated_at", F.lit("later")), path) and src.publish(df.withColumn("n", F.col("n") + 1), path)
    assert json.loads(src.ledger_document(df.drop("generated_at")).first().document) == {"version": 1, "items": {"k1": {"n": 1}, "k2": {"n": 2}}}
    assert src.digest(df).first() == src.digest(df.orderBy(F.desc("key"))).first() != src.digest(df.union(df)).first()
    items = spark.createDataFrame([("k", None, "t", None, None, [1, 2], None, None, "9")], "key string, canonical_url string, title string, thumbnail_url string, duration string, source_pages array<int>, media_url string, resolved_at string, asset_id string")
    src.write_csv(items, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert tuple(back.columns) == src.CSV_COLUMNS and back.first().source_pages == "1,2"
