import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from ledgerlake.llm import attention_lm as lm


def corpus(n=400):
    rng = random.Random(8)
    after = {a: rng.sample("abcdefgh", 2) for a in "abcdefgh"}  # a language with strong pairs
    rows = []
    for k in range(n):
        w, a = [], rng.choice("abcdefgh")
        for _ in range(rng.choice([3, 40, 200])):
            w.append(a * 2 if rng.random() < 0.98 else f"Rare{rng.randrange(500)}")
            a = rng.choice(after[a])
        rows.append((k, " ".join(w), 1))
    return rows + [(901, None, 1), (902, "", 1), (None, "aa bb", 1), (7, rows[7][1], 1), (903, "É aa\x0bAA", 1)]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 10)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(2)
    got = lm.score_all(docs).collect()
    assert len(got) == len(rows)
    train = Counter()
    for d, t, _ in rows:
        if not lm.held_out(d):
            train.update([*lm.words_of(t), "end"])
    total, distinct = sum(train.values()), len(train)
    by = {(r.doc_id, r.n_tokens): r for r in got}
    mine, base = 0.0, 0.0
    for d, t, _ in rows:
        tokens = [*lm.words_of(t), "end"]
        r = by[d, len(tokens)]
        want = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        assert abs(r.base_score - want) < 1e-6 * max(1, -want) and r.train_tokens == total
        assert r.n_known == sum(train[w] > 0 for w in tokens) and r.held_out == lm.held_out(d)
        if r.held_out:
            mine, base = mine + r.score, base + r.base_score
    assert mine > base  # closer to held-out documents than single words are


def test_each_id_counts_once_and_sees_only_the_past(monkeypatch):
    c = lm.Classes(np.random.default_rng(0).integers(0, 50, 3000))
    w = lm.first_weights()
    w["out"] = w["out"] * 20
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 3000, n) for n in (1, 2, 31, 32, 33, 56, 57, 60, 61, 300)]
    _, y, keep, doc = lm.grid(docs, c)
    for k, ids in enumerate(docs):
        assert (y[doc == k][keep[doc == k]] == ids).all()
    got = lm.score(w, c, docs)
    assert np.allclose(got, [lm.score(w, c, [d])[0] for d in docs])

    def direct(ids):
        total = 0.0
        _, starts, skips = lm.windows_of(np.array([len(ids)]))
        for s, k in zip(starts.tolist(), skips.tolist()):
            for t in range(s + k, min(s + lm.T, len(ids))):
                seq = np.array([[lm.START if j == 0 else c.input[ids[j - 1]] for j in range(s, t + 1)]])
                z = lm.attend(w, seq)[-1][0, -1] @ w["out"] + c.prior
                total += (z[c.cls[ids[t]]] - np.log(np.exp(z).sum())) / math.log(10) + c.inside[ids[t]]
        return total

    assert np.allclose(got, [direct(d) for d in docs], rtol=1e-4)
    monkeypatch.setattr(lm, "TURN", 2)  # long texts in parts
    assert np.allclose(lm.score(w, c, docs), got)
    every = np.arange(3000)  # probabilities of all ids sum to one
    assert abs(sum(10 ** lm.score(w, c, [np.array([i]) for i in every])) - 1) < 1e-3


def test_gradients_equal_differences():
    c = lm.Classes(np.random.default_rng(0).integers(0, 50, 3000))
    rng = np.random.default_rng(2)
    x, y, keep, _ = lm.grid([rng.integers(0, 3000, n) for n in (70, 5, 33)], c)
    w = {k: v.astype(np.float64) for k, v in lm.first_weights().items()}
    y = c.cls[y]

    def loss(w):
        g, total = lm.class_odds(w, c.prior, lm.attend(w, x)[-1][keep])
        return -np.log(g[np.arange(len(g)), y[keep]] / total).mean()

    grad, to = lm.gradients(w, c.prior, x, y, keep)
    for name, d in grad.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in d.shape)
            place = (to[at[0]], *at[1:]) if name == "embed" else at
            up, down = ({**w, name: w[name].copy()} for _ in range(2))
            up[name][place] += 1e-4
            down[name][place] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - d[at]) < 1e-4 + 1e-2 * abs(d[at])


def test_attention_is_what_the_model_knows():
    """On held-out texts whose words depend on words far back: the trained model is better than without attention,
    and better than when it sees the last input alone."""
    rng = np.random.default_rng(4)

    def text():
        topic = rng.integers(0, 20)
        return np.array([rng.integers(0, 40) if rng.random() < 0.3 else 40 + topic * 10 + rng.integers(0, 10) for _ in range(150)])

    docs, held = [text() for _ in range(1500)], [text() for _ in range(50)]
    c = lm.Classes(np.bincount(np.concatenate(docs), minlength=3000))
    x, y, keep, _ = lm.grid(docs, c, 0)
    w, state = lm.train(lm.first_weights(), c.prior, x, c.cls[y], keep)
    of = lambda w: lm.score(w, c, held).sum() / sum(map(len, held))
    full, none = of(w), of({**w, "out": w["out"] * 0})
    last = of({**w, "near": np.r_[50, np.full(lm.T - 1, -50)].astype(np.float32)})
    assert full > none + 0.2 and full > last + 0.1


def test_empty(spark):
    assert lm.score_all(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_model_is_that_of_the_shards_in_order(spark, monkeypatch):
    """Trained on all windows of all training texts, however the rows are dealt out."""
    monkeypatch.setattr(lm, "SHARD", 1500)
    monkeypatch.setattr(lm, "FAN", 2)
    rows = [*corpus(60), (904, "aa bb cc " * 500, 1)]
    made = spark.createDataFrame(rows, "doc_id long, text string, key int")
    vocab = lm.encoder(None).vocab_size
    found = lm.encoded(lm.ids_and_texts(made.coalesce(1)), None)
    counts = lm.count_ids(found, vocab)
    encode = lm.encoder(None).encode
    ids = [np.r_[np.frombuffer(encode(t), "<u4"), np.array([lm.END_ID], "<u4")] for d, t, _ in rows if not lm.held_out(d)]
    assert (counts == np.bincount(np.concatenate(ids).astype(np.int64), minlength=vocab + 1)).all()
    c = lm.Classes(counts)
    n = int(counts.sum())
    shards = -(-n // lm.SHARD)
    assert shards > 2
    train = found.filter("not held").selectExpr(f"pmod(xxhash64(doc_id, ids), {shards}) as s", "doc_id", "ids").collect()
    total, weights = 0, None
    for k in range(shards):
        own = [lm._ids([bytes(r.ids)], vocab)[0] for r in sorted((r for r in train if r.s == k), key=lambda r: (r.doc_id is not None, r.doc_id or 0, bytes(r.ids)))]
        if own:
            x, y, keep, _ = lm.grid(own, c, 0)
            assert keep.sum() == sum(map(len, own))
            w, _ = lm.train(lm.first_weights(), c.prior, x, c.cls[y], keep)
            weights = {j: (weights[j] if weights else 0) + v.astype(np.float64) * len(x) for j, v in w.items()}
            total += len(x)
    cast = spark.sparkContext.broadcast(c)
    got = lm.fit(found, cast, vocab, n)
    assert all(np.allclose(got[k], weights[k] / total, rtol=1e-4, atol=1e-6) for k in weights)
    again = lm.fit(lm.encoded(lm.ids_and_texts(made.repartition(5)), None), cast, vocab, n)
    assert all((got[k] == again[k]).all() for k in got)


def test_ablation_on_prose(spark):
    """The pipeline's own documents: attention to more than the last input lowers the loss of held-out texts."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    rows = lm.encoded(lm.ids_and_texts(spark.read.parquet(path)), None)
    vocab = lm.encoder(None).vocab_size
    counts = lm.count_ids(rows, vocab)
    c = lm.Classes(counts)
    w = lm.fit(rows, spark.sparkContext.broadcast(c), vocab, int(counts.sum()))
    held = lm._ids([bytes(r.ids) for r in rows.filter("held").select("ids").collect()], vocab)
    of = lambda w: lm.score(w, c, held).sum() / sum(map(len, held))
    full, none = of(w), of({**w, "out": w["out"] * 0})
    last = of({**w, "near": np.r_[50, np.full(lm.T - 1, -50)].astype(np.float32)})
    assert full > none + 0.1 and full > last + 0.02
