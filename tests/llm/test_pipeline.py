import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ledgerlake.llm import decontam, pii, quality  # noqa: E402
from ledgerlake.llm.tokens import encoder  # noqa: E402
from tests.llm import test_jaccard_join as near  # noqa: E402
from tests.llm import test_quality as rules  # noqa: E402


def test_stages(spark, tmp_path):
    rng = __import__("random").Random(6)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8)))
    item = " ".join(word() for _ in range(14)) + ".\n" + " ".join(word() for _ in range(6))
    rows = []
    for k in range(90):
        w = [word() for _ in range(rng.randint(60, 150))]
        if k % 11 == 1:
            w = [x + "#*" for x in w]
        if k % 11 == 2:
            w[9:9] = item.split()
        if k % 11 == 3:
            w[5:5] = [f"mail{k}@host.example.com"]
        if k % 11 == 4:
            w = rows[-1][1].split() + [word()]
        rows.append((k, " ".join(w), "en", "s", 7))
    rows += [(200, None, "en", "s", 0), (201, "", None, None, None), (None, rows[0][1], "en", "s", 1), (300, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert now.columns == docs.columns
            kept.append(sorted(((r.doc_id, r.text) for r in now.collect()), key=str))
    start = [(d, t) for d, t, *_ in rows]
    stats = {t: rules.brute_stats(t) for _, t in start}
    good = [(d, t) for d, t in start if t and stats[t][0] >= 50 and 2 * stats[t][4] <= stats[t][0]]
    d2 = rules.brute_verdict([stats[t] for _, t in good])
    one = sorted((x for x, v in zip(good, d2) if v <= quality.CUTOFF), key=str)
    assert kept[0] == one and len(one) < len(good)
    component = {(d, n): c for d, n, c in near.brute(one, 5, 80)}
    two = [(d, t) for d, t in one if d is None or component[d, len(near.shingles(t, 5))] == d]
    assert kept[1] == two and len(two) < len(one)
    index = decontam.Index([(1, item)])
    three = [x for x, found in zip(two, index.leaks([t for _, t in two])) if not found]
    assert kept[2] == three and len(two) - len(three) >= 5
    four = sorted(((d, pii.masked(t)) for d, t in three), key=str)
    assert kept[3] == four and any("[EMAIL]" in t for _, t in four)
    pieces = now.collect()
    want = {d: np.r_[np.frombuffer(encoder().encode(t), "<u4"), [1]].astype("<u4") for d, t in four}
    assert sum(r.length for r in pieces) == sum(map(len, want.values()))
    assert all(r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) for r in pieces)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket int, kept boolean, start long"
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(None, None, None, None, None, 1, 1, True, 1), (5, "", "en", "s", 0, 1, 1, True, 1), (5, "", "en", "s", 0, 2, 1, True, 1)], schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, some, str(tmp_path))
        assert kept.columns == some.columns and sorted(r.node for r in kept.collect()) == [1, 1, 2], name
    assert corpus_pipeline.STAGES[0][1](spark, some, str(tmp_path)).count() == 0
    assert sorted((r.doc_id or 0, r.length) for r in corpus_pipeline.STAGES[4][1](spark, some, str(tmp_path)).collect()) == [(0, 1), (5, 1), (5, 1)]
