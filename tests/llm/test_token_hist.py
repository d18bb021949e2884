import math

import numpy as np

from ledgerlake.llm import token_hist, tokens

TEXTS = ["the cat sat", "", None, "naïve ½ x² foo's 'sx _a_b <|endoftext|> hi", "日本語 テスト é ﬁ İstanbul Σας", "a\x1cb\x85c\xa0d", "It's we'll I'M 12345 $%^ à l'été ª º ß ẞ", "the cat sat", "word " * 3000]


def test_encoder_equals_library():
    e = tokens.Encoder()
    for text in TEXTS:
        want = e._whole.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(e.encode(text), "<u4").tolist() == want


def test_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 2)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 2)
    e = tokens.Encoder()
    assert np.frombuffer(e.encode("one two three one"), "<u4").tolist() == e._whole.encode("one two three one", add_special_tokens=False).ids


def test_answers(spark):
    docs = spark.createDataFrame([(k % 3, t, 9) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_docs long")
    n = [len(tokens.encoder().encode(t)) // 4 + 1 for t in TEXTS]
    assert sorted(r.n_tokens for r in token_hist.lengths(docs).collect()) == sorted(n)
    a = token_hist.answers(token_hist.histogram(docs)).cache()
    for r in a.collect():
        cut = r.context_limit
        assert r.n_docs == n.count(cut) and r.docs_at_least == sum(x >= cut for x in n) and r.docs_over == sum(x > cut for x in n)
        assert r.kept_tokens == sum(min(x, cut) for x in n) and r.lost_tokens == sum(n) - r.kept_tokens and r.total_tokens == sum(n)
    for r in token_hist.truncated(a, [0, 2, 5, 10**6]).collect():
        assert r.kept_tokens == sum(min(x, r.limit) for x in n) and r.docs_over == sum(x > r.limit for x in n)
    for r in token_hist.quantiles(a).collect():
        assert r.n_tokens == sorted(n)[int(np.ceil(r.quantile * len(n))) - 1]
    assert a.count() == len(set(n))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_hist.answers(token_hist.histogram(docs)).count() == 0


def test_query_has_quantiles_and_limits(spark, tmp_path):
    from ledgerlake.llm import queries

    texts = [" ".join(["word"] * k) for k in range(1, 1500, 7)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op4_token_counts(spark, str(tmp_path)).collect()
    n = sorted(r.n_tokens for r in token_hist.lengths(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())
    assert len(rows) == len(set(n))
    for r in rows:
        assert (r.quantile_25, r.quantile_50, r.quantile_99) == tuple(n[math.ceil(p * len(n)) - 1] for p in (0.25, 0.5, 0.99))
        for limit in (512, 1024, 8192):
            assert r[f"docs_over_{limit}"] == sum(x > limit for x in n)
            assert r[f"kept_at_{limit}"] == sum(min(x, limit) for x in n)
            assert r[f"lost_at_{limit}"] == sum(max(0, x - limit) for x in n)
