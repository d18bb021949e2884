import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import dedupe, history, inventory, ledger, queueing, ranking
from ledgerlake.operators.fixpoint import settled_in_shared_folder
from ledgerlake.plans import snapshot
from ledgerlake.plans.engine import Engine

FIELDS = ("canonical_url", "title", "thumbnail_url", "duration", "media_url", "resolved_at", "asset_id")


def asset_of(url):
    stem = (url or "").rsplit("/", 1)[-1].split(".")[0]
    return stem if stem.isdigit() else ""


def loop_merge(rows):
    """The ordered merge as a plain loop: per source first, then over the sources."""

    def fold(cur, new):
        ok = lambda r: r["asset_id"] != "" and r["asset_id"] == asset_of(r["thumbnail_url"])
        if cur is None:
            return dict(new)
        pages = sorted({*cur["source_pages"], *new["source_pages"]})
        if ok(new) and not ok(cur):
            cur, new = dict(new), cur
            names = FIELDS[1:6]
        else:
            cur, names = dict(cur), FIELDS[1:]
        for n in names:
            cur[n] = cur[n] or new[n]
        cur["source_pages"] = pages
        return cur

    inside, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["source_idx"], r["page"], r["first_ord"])):
        inside[r["source_idx"], r["key"]] = fold(inside.get((r["source_idx"], r["key"])), r)
    for (_, key), r in sorted(inside.items(), key=lambda x: x[0][0]):
        out[key] = fold(out.get(key), r)
    return {k: tuple(v[c] for c in FIELDS) + (v["source_pages"],) for k, v in out.items()}


def test_merge_equals_loop_in_any_row_order(spark):
    rng = random.Random(3)
    rows = []
    for k in range(150):
        n = rng.choice(["1", "2", "3"])
        rows.append({"source_idx": rng.randrange(3), "page": rng.randrange(4), "first_ord": k, "key": f"k{rng.randrange(12)}", "canonical_url": f"u{k}", "title": rng.choice(["", f"t{k}"]), "thumbnail_url": rng.choice(["", f"https://x/{n}.jpg"]), "duration": rng.choice(["", f"d{k}"]), "media_url": rng.choice(["", f"m{k}"]), "resolved_at": "", "asset_id": rng.choice(["", "1", "2"]), "source_pages": [rng.randrange(4)]})
    schema = "source_idx int, page int, first_ord int, key string, " + ", ".join(f"{c} string" for c in FIELDS) + ", source_pages array<int>"
    want = loop_merge(rows)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(3)
        assert {r.key: tuple(r[c] for c in FIELDS) + (r.source_pages,) for r in dedupe.merge_items(df).collect()} == want


def test_merge_of_a_hot_key_keeps_few_records(spark):
    """All rows under one key; assets and thumbnails that fit only once they are filled together; nulls and ties."""
    rows = []
    for k in range(60000):
        asset, thumb = ("", "https://x/7.jpg") if k < 300 else ("8", "") if k < 600 else ("8", "https://x/8.jpg")
        rows.append((k % 2, k // 100, k, "hot", f"u{k}", "", thumb if k % 2 else "", "" if k < 500 else f"d{k}", "", "", asset, [k % 5]))
    schema = "source_idx int, page int, first_ord int, key string, " + ", ".join(f"{c} string" for c in FIELDS) + ", source_pages array<int>"
    df = spark.createDataFrame(rows, schema).repartition(8)
    merged = dedupe.merge_items(df)
    assert "collect_list" not in merged._jdf.queryExecution().toString()
    want = loop_merge([dict(zip(df.columns, r)) for r in rows])
    assert {r.key: tuple(r[c] for c in FIELDS) + (r.source_pages,) for r in merged.collect()} == want

    mixed = [(0, 1, 1, "k", "u1", "", "", None, None, "", "5", [1]), (0, 1, 2, "k", "u2", None, "https://x/5.jpg", "", "", "", "9", None), (0, 1, 3, "k", "u3", "t", "https://x/6.jpg", "", "", "", "6", [2, 1]), (0, 1, 3, "k", "u3", "s", "https://x/6.jpg", "", "", "", "6", [2, 1])]
    for order in (mixed, mixed[::-1]):
        (r,) = dedupe.merge_items(spark.createDataFrame(order, schema)).collect()
        assert (r.canonical_url, r.title, r.thumbnail_url, r.asset_id, r.duration, r.source_pages, r.first_ord) == ("u1", "s", "https://x/5.jpg", "5", "", [1, 2], 1)
    assert dedupe.merge_items(spark.createDataFrame([], schema)).collect() == []


def test_best_cards(spark):
    rows = [(0, 1, 0, "k", "decoy", "9", "x", ""), (0, 1, 1, "k", "visible", "", "", ""), (0, 1, 2, "k", "decoy", "1", "https://x/1.jpg", ""), (0, 1, 3, "j", "", "", "", ""), (0, 1, 4, "j", "", "", "", "")]
    df = spark.createDataFrame([(s, p, o, k, c, "", a, t, d) for s, p, o, k, c, a, t, d in rows], "source_idx int, page int, card_ord int, key string, tracking_class string, title string, asset_id string, thumbnail_url string, duration string")
    assert sorted((r.key, r.card_ord, r.first_ord) for r in dedupe.best_cards(df).collect()) == [("j", 3, 3), ("k", 2, 0)]


def test_greedy_queue_equals_loop(spark):
    rng = random.Random(5)
    rows = [(k, f"key-{rng.randrange(40):03d}", f"u{rng.randrange(40)}") for k in range(200)] + [(500, "bad", "u"), (501, "key-abc", "")]
    seen, want = set(), []
    for o, k, u in rows[:200]:
        if ("k", k) not in seen and ("u", u) not in seen:
            seen |= {("k", k), ("u", u)}
            want.append(o)
    df = spark.createDataFrame(rows, "ord int, key string, url string").repartition(3)
    assert sorted(r.ord for r in dedupe.valid_queue(df, settled_in_shared_folder).collect()) == want


def test_assets_and_content(spark):
    items = spark.createDataFrame([("a", "1", "https://x/1.jpg"), ("b", "1", "https://x/2.jpg"), ("c", "1", "https://x/1.png"), ("d", "", "")], "key string, asset_id string, thumbnail_url string")
    assert {r.key for r in dedupe.asset_duplicates(items, items.filter("key = 'a'")).collect()} == {"c"}
    assert dedupe.asset_duplicates(items, items.filter("key = 'b'")).count() == 0
    results = spark.createDataFrame([(2, "a", "h"), (1, "b", "h"), (3, "c", "g"), (4, "c", "g")], "ord int, key string, hash string")
    known = spark.createDataFrame([("g", "z")], "hash string, key string")
    assert sorted((r.key, r.owner, r.is_duplicate) for r in dedupe.content_claims(results, known).collect()) == [("a", "b", True), ("b", "b", False), ("c", "z", True), ("c", "z", True)]


def test_blocks(spark):
    items = spark.createDataFrame([("aaaaaa", "https://t.example/1.jpg"), ("bbbbbb", "https://t.example/2.jpg"), ("cccccc", "https://t.example/x.jpg"), ("dddddd", "https://t.example/4.jpg")], "key string, thumbnail_url string")
    rows = (("aaaaaa", "1", "", "2024-01-05T00:00:00Z"), ("bbbbbb", "9", "e", "2024-01-05T00:00:00Z"), ("cccccc", "3", "e", ""), ("dddddd", "4", "e", "2024-01-05T00:00:00Z"))
    blocked = spark.createDataFrame([(k, a, e, "request_error", "2024-01-01T00:00:00Z", s) for k, a, e, s in rows], "key string, expected_asset string, error string, kind string, first_seen_at string, last_seen_at string")
    done = spark.createDataFrame([("dddddd",)], "key string")
    held = lambda at: {r.key: (r.kind, r.error) for r in queueing.matching_blocks(items, blocked, done, at).collect()}
    assert held("") == {"aaaaaa": ("media_mismatch", "media is not available"), "cccccc": ("media_mismatch", "e")}
    assert set(held("2024-01-02T00:00:00Z")) == {"aaaaaa"} and held("2024-01-06T00:00:00Z") == {} and set(held("odd")) == {"aaaaaa", "cccccc"}
    new = spark.createDataFrame([(1, "cccccc", "media_mismatch", "e1"), (2, "cccccc", "media_unavailable", ""), (1, "unlisted", "media_mismatch", "e"), (1, "bbbbbb", "request_error", "e"), (1, "bad", "media_mismatch", "e")], "ord int, key string, kind string, error string")
    up = {r.key: tuple(r)[1:] for r in ledger.blocked_upsert(blocked, items, new, "now").collect()}
    assert up["cccccc"] == ("", "media is not available", "media_unavailable", "2024-01-01T00:00:00Z", "now") and len(up) == 4
    assert up["bbbbbb"] == ("9", "e", "request_error", "2024-01-01T00:00:00Z", "2024-01-05T00:00:00Z")


def test_repair_candidates(spark):
    items = spark.createDataFrame([("completed", 1), ("blocked", 2), ("retry", 3), ("retry", 4), ("", 5), ("again", 6)], "key string, ord int")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    got = queueing.repair_candidates(items, keys("completed"), keys("blocked", "again"), keys("again"), keys("other")).collect()
    assert sorted((r.key, r.ord) for r in got) == [("again", 6), ("retry", 3)]


def test_active_downloads(spark):
    p = spark.createDataFrame([("file", 10), ("both", 10), ("zero", 10)], "key string, size_bytes long")
    g = spark.createDataFrame([("both", 300, 200), ("zero", 0, 0), ("gauge", 5, 0)], "key string, bytes_done long, bytes_total long")
    assert {r.key: tuple(r)[1:] for r in inventory.active_downloads(p, g).collect()} == {"file": (10, 0, None), "both": (300, 200, 150.0), "zero": (10, 0, None), "gauge": (5, 0, None)}
    assert inventory.active_downloads(p, g, active=False).count() == 0


def test_completed_today_and_reasons(spark):
    def one(**facts):
        return snapshot.snapshot(spark.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items()])).first()

    assert one(today_success=True).completed_today and not one(today_success=True, today_listing_failures=1).completed_today
    assert not one().completed_today and not one(today_success=True, active=True).completed_today
    blocked = next(a for a in one(n_blocked=6, n_mismatch=2, n_unavailable=1).alerts if a.code == "blocked_skipped")
    assert blocked.detail == "2 mismatch, 1 unavailable, 3 unclassified"


def test_summarise_run(spark):
    from ledgerlake.plans.runs import Run, check_arguments

    manifest = spark.createDataFrame([("a", "downloaded", "10", "2"), ("b", "skipped", "", "nope"), ("c", "blocked", None, None), ("d", "failed", "5", "1"), ("", "blocked", "", "")], "viewkey string, status string, bytes string, autoRetries string")
    failures = spark.createDataFrame([("c", "media_mismatch", ""), ("e", "", "it does not match the listing"), ("f", "auth_challenge", "x"), ("", "media_mismatch", "")], "viewkey string, kind string, error string")
    listing = spark.createDataFrame([("timeout",)], "kind string")
    run = Run(0, 0, True, "manual", "2024-01-01T00:00:00Z", "2024-01-01T00:01:30Z", 2, 9, {"unique_videos": 7, "raw_detail_links": 9}, {"rawLinks": 1})
    e = Engine().summarise_run(run, manifest, failures, listing).first()
    assert (e.downloadedVideos, e.alreadyPresentVideos, e.blockedVideos, e.failedVideos, e.listingFailures, e.authChallenges, e.authFailure) == (1, 1, 2, 2, 1, 1, True)
    assert (e.downloadedBytes, e.autoRetryAttempts, e.autoRetriedVideos, e.autoRecoveredVideos) == (10, 3, 2, 1) and (e.rawLinks, e.uniqueVideos, e.durationSeconds, e.resultStatus) == (9, 7, 90.0, "attention")
    lost = Engine().summarise_run(Run(1, None, False, "daily", "2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z", progress={"rawLinks": 4, "listingFailures": 18, "authFailure": True}), manifest.limit(0), failures.limit(0), listing).first()
    assert lost.authDetectorVersion == 3 and (lost.resultStatus, lost.rawLinks, lost.listingFailures, lost.authFailure, lost.downloadExitCode) == ("failed", 4, 18, True, None)
    check_arguments(pages=20, limit=0)
    for bad in ({"pages": 21}, {"limit": -1}, {"delay": 0.1}):
        with pytest.raises(ValueError):
            check_arguments(**bad)


def test_history(spark):
    from ledgerlake.sources.ledgers import run_events

    at = '"timestamp":"2024-01-0%dT10:00:00Z"'
    raw = [
        '{%s,"taskType":"crawl","trigger":"manual","crawlExitCode":1,"authFailure":true,"authDetectorVersion":2}' % (at % 1),
        '{%s,"trigger":"manual","crawlExitCode":0}' % (at % 2),
        '{%s,"trigger":"manual","crawlExitCode":1,"authFailure":true,"authDetectorVersion":"2"}' % (at % 3),
        '{%s,"trigger":"manual","crawlExitCode":"0","inner":{"crawlExitCode":0}}' % (at % 4),
        '{%s,"taskType":"repair","crawlExitCode":0,"downloadExitCode":"0"}' % (at % 5),
        '{"trigger":"manual","crawlExitCode":0}',
    ]
    df = run_events(spark.createDataFrame(list(enumerate(raw)), "line_no int, line string"))
    assert [r.crawlExitCode for r in df.orderBy("line_no").collect()] == ["1", "0", "1", '"0"', "0", "0"]
    assert history.latest_manual_crawl(df).first().line_no == 1
    assert history.latest_manual_crawl(df.filter("line_no <> 1")).first().line_no == 0
    assert history.latest(df).first().line_no == 5 and history.latest(df.limit(0)).count() == 0
    assert {r.task: r.line_no for r in history.latest(history.described(df), "line_no", ["task"]).collect()} == {"crawl": 5, "repair": 4}
    assert history.latest_task_event(df).first().line_no == 4 and history.latest_task_event(df, "crawl").first().line_no == 3
    assert history.latest_task_event(df, "crawl", ("success",)).first().line_no == 1 and history.latest_task_event(df, "repair").first().result == "failed"
    day = run_events(spark.createDataFrame([(0, '{%s,"crawlExitCode":0,"downloadExitCode":%s,"downloadRequested":%s}' % (at % 1, d, q)) for d, q in (("0", "true"),)] + [(k, '{%s,"crawlExitCode":0,"downloadExitCode":%s,"downloadRequested":%s}' % (at % 1, d, q)) for k, (d, q) in enumerate((('"0"', "true"), ("null", "true"), ("0", "null"), ("0", '"true"')), 1)], "line_no int, line string"))
    assert history.latest_success_of_day(day, "2024-01-01").first().line_no == 0 and history.latest_success_of_day(day, "2024-01-02").count() == 0


def test_ema(spark):
    df = spark.createDataFrame([("a", 2, 8.0, 1.0), ("a", 1, 4.0, 1.0), ("a", 3, 100.0, 0.1)], "k string, o int, v double, s double")
    assert ranking.ema(df, ["k"], "o", "v", "s").first().ema == 5.0


def test_snapshot_invariants(spark):
    rng = random.Random(1)
    rows = [(k, f"key{k:05d}", rng.choice(["", "m"])) for k in range(80)]
    items = spark.createDataFrame(rows, "ord int, key string, media_url string")
    some = lambda p: spark.createDataFrame([(r[1],) for r in rows if rng.random() < p], "key string")
    o = inventory.overview(inventory.states(items, some(0.3), some(0.2), some(0.1), some(0.3), some(0.1), some(0.5))).first()
    assert o.n_resolved <= o.n_items and o.n_downloaded <= o.n_items and o.n_resolved + o.n_unresolved + o.n_ignored == o.n_items
    assert o.n_pending == max(0, o.n_items - o.n_downloaded - o.n_blocked - o.n_ignored)
    clear = snapshot.snapshot(spark.range(1).select(F.lit(True).alias("has_snapshot"), F.lit("crawl").alias("event_task"), F.lit("success").alias("event_result"), F.lit(True).alias("no_work"))).first()
    assert [a.code for a in clear.alerts] == ["all_clear"] and clear.run_status == "ready" and [s.status for s in clear.stages] == ["done"] * 4
    failed = snapshot.snapshot(spark.range(1).select(F.lit("crawl").alias("event_task"), F.lit("failed").alias("event_result"), F.lit(18).alias("event_listing_failures"))).first()
    assert [a.code for a in failed.alerts] == ["run_failed", "snapshot_missing"] and failed.run_status == "attention" and [s.status for s in failed.stages] == ["attention", "waiting", "waiting", "waiting"]


def test_snapshot_of_ledgers(spark):
    """A failed run over an old inventory: its counters stay, the run's are its own; then a run that had nothing to do."""
    from ledgerlake.plans.ledger_snapshot import Ledgers
    from ledgerlake.sources.ledgers import run_events

    def made(line, **more):
        table = lambda rows, schema: spark.createDataFrame(rows, schema)
        given = dict(
            items=table([(0, "done0000", "A &amp; B", ""), (1, "media000", "", "m"), (2, "lost0000", "c", ""), (3, "block000", "d", ""), (4, "ignored0", "e", "m")], "ord long, key string, title string, media_url string"),
            success=table([("done0000",), ("unlisted",)], "key string"), ignored=table([("ignored0",)], "key string"), files=table([("/x/done0000.mp4", 7, "2024-01-05 01:00:00"), ("/x/other.webm", 5, "2024-01-04 01:00:00")], "path string, size_bytes long, modified_at string").withColumn("modified_at", F.col("modified_at").cast("timestamp")),
            partials=table([], "path string, size_bytes long"), history=run_events(table([(0, line)] if line else [], "line_no long, line string")), downloads=table([("done0000", "2024-01-05", 7)], "key string, date string, bytes long").withColumn("date", F.col("date").cast("date")),
            failures=table([(0, "block000", "media_unavailable", ""), (1, "lost0000", "request_error", "")], "ord long, viewkey string, kind string, error string"), listing_failures=table([], "kind string"),
            manifests=((2.0, table([(0, "unlisted", "failed", "", "x")], "ord long, viewkey string, status string, kind string, error string")), (1.0, table([(0, "media000", "failed", "media_mismatch", "")], "ord long, viewkey string, status string, kind string, error string"))),
        )
        return Engine().snapshot_of(Ledgers(**(given | more)), "2024-01-05T12:00:00Z")

    out = made('{"timestamp":"2024-01-05T11:00:00Z","resultStatus":"failed","rawLinks":0,"listingFailures":18}')
    s = out["snapshot"].first()
    assert (s.n_items, s.n_resolved, s.n_downloaded, s.n_blocked, s.n_ignored, s.n_pending, s.n_backlog, s.n_current_errors) == (5, 2, 1, 2, 1, 1, 2, 0)
    assert (s.n_mismatch, s.n_unavailable, s.n_manifest_failures, s.event_raw_links, s.event_unique, s.event_listing_failures) == (1, 1, 1, 0, 5, 18)
    assert [a.code for a in s.alerts] == ["run_failed", "blocked_skipped", "backlog", "ignored", "downloads_failed"] and s.run_status == "attention" and s.age_hours is None
    assert [x.status for x in s.stages] == ["attention", "waiting", "waiting", "waiting"] and (s.n_files, s.n_files_today, s.file_bytes, s.ingested_bytes_today) == (2, 1, 12, 7)
    assert [r.name for r in out["recent"].orderBy(F.desc("modified_at")).collect()] == ["A & B", "other.webm"] and [r.name for r in out["pending"].collect()] == ["untitled"]
    idle = made('{"timestamp":"2024-01-05T11:00:00Z","resultStatus":"success","newVideos":0,"retryVideos":0}', manifests=((1.0, spark.createDataFrame([], "ord long, viewkey string, status string, kind string, error string")),)).pop("snapshot").first()
    assert idle.no_work and idle.run_status == "attention" and idle.event_ignored == 1 and (idle.n_current_errors, idle.n_backlog, idle.n_manifest_failures) == (1, 0, 0) and [x.value for x in idle.stages] == [5, 5, 0, 0]
    never = made("", has_snapshot=False, active=True, phase="listing").pop("snapshot").first()
    assert never.event_result == "none" and "snapshot_missing" in [a.code for a in never.alerts] and never.run_status == "active" and never.progress.stage == "listing" and not never.today_success


def test_engine(spark):
    from tests.test_sources import BASE, card

    pages = spark.createDataFrame([(0, 1, BASE, card("firstkey", img="/11.jpg", extra='<i id="thumb_11"></i>') + card("secondky")), (0, 2, BASE, card("firstkey") + card("ignored1"))], "source_idx int, page int, base_url string, html string")
    none = spark.createDataFrame([], "key string")
    old = spark.createDataFrame([("oldkey01", "", "https://lists.example/11.jpg", "", "", "", "11"), ("secondky", "kept", "", "", "m", "t", "")], "key string, title string, thumbnail_url string, duration string, media_url string, resolved_at string, asset_id string")
    blocked = spark.createDataFrame([], "key string, expected_asset string, error string, kind string, first_seen_at string, last_seen_at string")
    out = Engine().build_inventory(pages, old, spark.createDataFrame([("oldkey01",)], "key string"), blocked, spark.createDataFrame([("ignored1",)], "key string"), none)
    assert {r.key: r.queue_class for r in out["queue"].collect()} == {"firstkey": "skip", "secondky": "retry", "ignored1": "ignored"}
    assert {(r.raw_links, r.unique_items) for r in out["links"].collect()} == {(4, 3)}
    assert {r.key: r.source_pages for r in out["items"].collect()}["firstkey"] == [1, 2]
