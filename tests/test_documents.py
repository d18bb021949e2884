import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.sources import documents as docs
from ledgerlake.sources import ledgers as src

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(alphabet='a,"\\{}[]: é\n', max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet='k,"\\{é', max_size=3), x, max_size=3), max_leaves=8)
DOCUMENTS = st.fixed_dictionaries({"version": VALUES, "items": st.dictionaries(st.text(alphabet='k,"\\}é', max_size=4), VALUES, max_size=4) | st.lists(VALUES, max_size=4), "other": VALUES})


def by_hand(text: bytes, sizes: list[int]):
    """What the two passes give for pieces dealt into splits of these sizes, put together in order."""
    pieces = text.split(b",")
    splits, at = [], 0
    for n in [*sizes, len(pieces)]:
        splits.append(pieces[at : at + n])
        at += n
    splits = [s for s in splits if s]
    effects = []
    for k, s in enumerate(splits):
        effects.append((k, [docs.brackets(b",".join(s) + b",", x)[1] for x in docs._STARTS]))
    begins = docs.folded(effects)
    out, container, open_text = [], None, None
    for k, s in enumerate(splits):
        e = docs.Entries(begins[k])
        rows = [r for p in s for r in e.piece(p)] + list(e.end())
        for kind, _, inherited, own, name, value in rows:
            of = container if inherited else own
            if kind == "whole":
                out.append((of, name, value))
            elif kind == "tail":
                open_text = (of, value)
            elif kind == "through":
                open_text = (open_text[0], open_text[1] + value)
            elif kind == "head" and open_text is not None:
                text_ = open_text[1] + value
                if text_.strip():
                    out.append((open_text[0], *docs.split_member(text_.encode())))
                open_text = None
            elif kind == "open" and not inherited:
                container = own
    return out


@settings(max_examples=600, deadline=None)
@given(DOCUMENTS, st.lists(st.integers(0, 6), max_size=8), st.sampled_from([None, 1]))
def test_entries_are_those_of_the_parser(document, sizes, indent):
    text = json.dumps(document, ensure_ascii=False, indent=indent).encode()
    want = []
    for member, container in document.items():
        if isinstance(container, dict):
            want += [(member, k, v) for k, v in container.items()]
        elif isinstance(container, list):
            want += [(member, None, v) for v in container]
    assert [(m, k, json.loads(v)) for m, k, v in by_hand(text, sizes)] == want


@pytest.fixture(scope="module")
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_read_by_many_tasks(small_splits, tmp_path):
    spark = small_splits
    rng = random.Random(4)
    items = {f'key "{k}", {rng.random()}': {"n": k, "text": "x,{[\"\\" * rng.randint(0, 300)} for k in range(200)}
    path = tmp_path / "ledger.json"
    path.write_text(json.dumps({"note": {"a": [1, 2]}, "items": items, "list": list(range(500)), "none": {}}))
    assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 5
    rows = docs.entries(spark, str(path), "items").orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(200)) and {r.name: json.loads(r.value) for r in rows} == items and [r.name for r in rows] == list(items)
    assert [(r.ord, r.name, int(r.value)) for r in docs.entries(spark, str(path), "list").orderBy("ord").collect()] == [(k, None, k) for k in range(500)]
    assert docs.entries(spark, str(path), "none").count() == docs.entries(spark, str(path), "absent").count() == 0


@pytest.mark.parametrize("n", [0, 1, 700])
def test_document_of_many_files(small_splits, tmp_path, n):
    """Written by many tasks, joined by Spark's own order of names: the same JSON as the document in one row, and the same entries."""
    spark = small_splits
    text = F.concat(F.lit('x,{["\\ "'), F.repeat(F.lit(",\n"), (F.col("id") % 90).cast("int")))
    rows = spark.range(n).select(F.concat(F.lit('k", {'), F.col("id").cast("string")).alias("key"), F.col("id").alias("n"), F.when(F.col("id") % 3 > 0, text).alias("note"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        src.write_ledger_document(rows, str(tmp_path / "ledger"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "ledger").glob("part-*"))
    want = json.loads(src.ledger_document(rows).first()[0]) if n else {"version": 1, "items": {}}
    assert json.loads("".join(p.read_text() for p in parts)) == want and (n < 9 or len(parts) > 2)
    got = docs.entries(spark, str(tmp_path / "ledger"), "items").orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(n)) and [(r.name, json.loads(r.value)) for r in got] == sorted(want["items"].items())


def test_entries_query_writes_by_many_tasks(spark, tmp_path, monkeypatch):
    """The ledger is not gathered in one row."""
    from ledgerlake.queries import queries

    monkeypatch.setattr(src, "ledger_document", None)
    spark.range(500).selectExpr("id o_orderkey", "id o_custkey", "'F' o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    assert queries()["ledger_entries_file"](spark, str(tmp_path)).count() == 500


def test_large_ledgers_equal_the_document_readers(small_splits, tmp_path, monkeypatch):
    spark = small_splits
    rng = random.Random(9)
    long = lambda: "why, " * rng.randint(0, 400)
    blocked = {f"item-key-{k}" if k % 7 else "bad key": {"expectedAsset": str(k), "error": long(), "kind": "media_mismatch", "firstSeenAt": "a", "lastSeenAt": "b"} for k in range(90)}
    videos = [{"viewkey": f"item-key-{k % 60}", "title": long(), "source_pages": [k, "x", True]} for k in range(100)] + [1, "x", None, [2, 3], {"viewkey": "short"}]
    content = {"hashes": {f"{k:064x}" if k % 5 else f"x{k}": {"viewkey": f"k{k}", "bytes": k if k % 3 else "many", "recordedAt": long()} for k in range(60)}, "mediaAssets": {str(k): f"k{k}" for k in range(60)}}
    for name, d in (("blocked", {"version": 1, "items": blocked}), ("map", {"items": blocked}), ("list", {"items": list(blocked)}), ("objects", {"items": [{"viewkey": k} for k in blocked]}), ("snapshot", {"metadata": {"a": {}}, "videos": videos}), ("content", content)):
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=2 if name == "content" else None))

    def read():
        plain = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
        at = lambda name: str(tmp_path / f"{name}.json")
        out = [plain(src.blocked_ledger(spark, at("blocked"))), plain(src.snapshot_items(spark, at("snapshot")))]
        out += [plain(src.ignored_keys(spark, at(name))) for name in ("map", "list", "objects")]
        return out + [plain(x) for x in src.content_ledger(spark, at("content"))]

    whole = read()
    monkeypatch.setattr(src, "LARGE", 0)
    assert read() == whole and all(whole)
