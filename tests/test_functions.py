from pyspark.sql import functions as F

from ledgerlake.functions import rules, text, urls


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, "A girl&#39;s  &quot;day date&quot; ", text.normalize_text) == 'A girl\'s "day date"'
    assert one(spark, None, text.normalize_text) == ""
    assert one(spark, "abcdef", text.valid_key) and not one(spark, "abcdef\n", text.valid_key) and not one(spark, "bad", text.valid_key) and not one(spark, None, text.valid_key)
    assert [one(spark, v, text.tolerant_int) for v in ("7", "1.9", "nope", None, "-3", "")] == [7, 1, 0, 0, -3, 0]
    line = lambda name: (lambda c: text.counter(c, name, 5))
    assert [one(spark, '{"n":%s}' % v, line("n")) for v in ("0", '"0"', '"nope"', "null", "3")] == [0, 0, 0, 0, 3]
    assert one(spark, "{}", line("n")) == 5 and one(spark, "broken", line("n")) == 5
    assert one(spark, 3 * 1024 * 1024, text.format_bytes, "long") == "3.0 MB" and one(spark, 3725, text.format_duration, "long") == "1:02:05"
    assert one(spark, "1:02:05", text.duration_seconds) == 3725 and one(spark, "x", text.duration_seconds) is None
    assert tuple(one(spark, "bytes 5-9/10", text.content_range)) == (5, 9, 10) and tuple(one(spark, "bytes */7", text.content_range)) == (None, None, 7)
    assert one(spark, "Mozilla Firefox/9", text.agent_label) == "Firefox"
    assert one(spark, 250, lambda c: text.floor_to(c, 100), "long") == 200
    assert one(spark, 1, lambda c: text.percent(c, F.lit(3)), "long") == 33.3 and one(spark, 1, lambda c: text.percent(c, F.lit(0)), "long") == 0.0


def test_urls(spark):
    assert one(spark, "https://a.b/list?x=1&PAGE=3&y=#f", lambda c: urls.page_url(c, F.lit(2))) == "https://a.b/list?x=1&y=&page=2"
    assert one(spark, "https://u:p@A.B.:8/x?z=1&a=2#f", urls.normalized_source) == "https://a.b/x?a=2&z=1"
    assert one(spark, "https://a.b/x?k=&k=v%20w", lambda c: urls.query_value(c, "k")) == "v w"
    for u, want in (("https://t/1/1235.jpg?x", "1235"), ("https://t/12a.jpg", ""), ("https://t/77/", "77"), ("88", "88"), ("https://t/9.tar.gz", ""), (None, "")):
        assert one(spark, u, urls.asset_id) == want
    assert one(spark, "a/b.MP4?x=1", urls.extension) == "mp4" and one(spark, "a/.mp4", urls.extension) == "" and one(spark, "a.b/c", urls.extension_label) == "OTHER"
    for h, ok in (("a.example", True), ("localhost", False), ("10.1.2.3", False), ("8.8.8.8", True), ("172.20.0.1", False), ("x.local", False), ("", False), ("[::1]", False)):
        assert one(spark, h, urls.public_host) is ok
    for u, why in (("https://lists.example/list?x", None), ("http://lists.example/list", "scheme"), ("https://a@lists.example/list", "userinfo"), ("https://x.example/list", "host"), ("https://lists.example/z", "path"), (None, "scheme")):
        assert one(spark, u, urls.listing_problem) == why
    df = spark.createDataFrame([("https://a.b/c/d", "../e?x"), ("https://a.b", "http://[bad")], "b string, l string")
    assert [r.y for r in df.select(urls.url_join("b", "l").alias("y")).collect()] == ["https://a.b/e?x", ""]
    assert one(spark, "https://a.b/next?category=New+one", lambda c: urls.source_name(F.lit(" "), c)) == "New one"
    assert one(spark, "https://m.example/v.mp4?s", urls.accepted_media) and not one(spark, "https://127.0.0.1/v.mp4", urls.accepted_media)


def test_rules(spark):
    assert one(spark, "repair-download-20240102-030405.log", lambda c: F.date_format(rules.log_time(c), "yyyyMMddHHmmss")) == "20240102030405"
    assert one(spark, "x-20240102-030405.log", rules.log_time) is None
    status = lambda e, c, d, l: spark.range(1).select(rules.result_status(*[F.lit(v).cast("string") for v in (e, c, d, l)]).alias("y")).first().y
    assert [status(None, 0, 0, 1), status(None, 0, None, 0), status(None, 1, 0, 0), status("attention", 1, 0, 0), status(None, None, None, 0)] == ["attention", "success", "failed", "attention", "failed"]
    older = lambda a, b: spark.range(1).select(rules.block_predates(F.lit(a).cast("string"), F.lit(b)).alias("y")).first().y
    assert [older("2024-01-01T00:00:00+0800", "2024-01-02T00:00:00+08:00"), older("2024-01-03T00:00:00Z", "2024-01-02T00:00:00Z"), older(None, "2024-01-02T00:00:00Z"), older(None, "")] == [True, False, True, False]
    cls = lambda *f, **k: spark.range(1).select(rules.queue_class(*[F.lit(x) for x in f], **k).alias("y")).first().y
    assert cls(True, True, True, True, True) == "ignored" and cls(False, True, True, True, False) == "skip"
    assert cls(False, False, True, True, False) == "retry" and cls(False, False, True, True, False, has_listing=False) == "skip"
    assert cls(False, False, True, False, False, new_only=True) == "skip" and cls(False, False, False, False, True) == "new" and cls(False, False, False, True, True) == "skip"
    mismatch = lambda e, o: spark.range(1).select(rules.identity_mismatch(F.lit(e), F.array(*map(F.lit, o)).cast("array<string>")).alias("y")).first().y
    assert mismatch("1", ["2"]) and not mismatch("1", ["2", "1"]) and not mismatch("", ["2"]) and not mismatch("1", [])
    p = spark.range(1).select(rules.coerced_progress(F.lit("failed"), F.lit(2), F.lit(0), F.lit(2)).alias("y")).first().y
    assert tuple(p) == ("complete", 0)
