import random

import numpy as np

from ledgerlake.llm import decontam as dc


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    common = [word() for _ in range(30)]
    pick = lambda n: [rng.choice(common) if rng.random() < 0.6 else word() for _ in range(n)]
    items = [(k, " ".join(pick(rng.randint(5, 30))) + ".\n" + " ".join(pick(rng.randint(1, 20)))) for k in range(60)]
    texts = []
    for k in range(60):
        w = pick(rng.choice([3, 60, 300, 900]))
        if k % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = items[k][1].split()
        elif k % 3 == 1:
            at = rng.randint(0, len(w))
            w[at:at] = items[k][1].split("\n")[0].split()  # the question alone
        texts.append(" ".join(w))
    return items, texts


def brute(index, texts):
    """Scores of every passage and item without bounds."""
    out = []
    by = {}
    for t, k in index.terms.items():
        for e in range(index.term_at[k], index.term_at[k] + index.term_n[k]):
            for p in range(index.post_at[e], index.post_at[e] + index.post_n[e]):
                by.setdefault(t, []).append((index.item[p], index.weight[p]))
    for o, t in enumerate(texts):
        w = dc.words_of(t)
        n = max(1, -(-(len(w) - 64) // 64))
        found = {}
        for k in range(n):
            score = {}
            for term in set(w[k * 64 : k * 64 + 128]):
                for i, x in by.get(term, ()):
                    score[i] = score.get(i, 0) + x
            for i, s in score.items():
                if s >= 1 - 1e-9:
                    _, q, a, size = index.items[i]
                    near = w[max(0, k * 64 - size) : k * 64 + 128 + size]
                    if min(dc.overlap(q, near), dc.overlap(a, near)) >= dc.OVERLAP:
                        found[i] = max(found.get(i, 0), s)
        out.append({index.items[i][0]: round(s, 9) for i, s in found.items()})
    return out


def test_retrieves_all_above_threshold():
    for seed in (1, 2):
        items, texts = make(seed)
        index = dc.Index(items)
        got = [{r[0]: round(r[1], 9) for r in rows} for rows in index.leaks(texts)]
        assert got == brute(index, texts)
        assert all(k in got[k] for k in range(0, 60, 3))


def test_rows(spark):
    items, texts = make(3)
    bench = spark.createDataFrame([*items, (None, None), (99, "")], "item_id long, text string")
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)] + [(None, items[0][1], 1), (71, None, 1), (72, "", 2)], "doc_id long, text string, item_id long")
    leaks = dc.find_leaks(docs, bench).collect()
    assert {(k, k) for k in range(0, 60, 3)} <= {(r.doc_id, r.item_id) for r in leaks}
    left = dc.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()}
    assert gone == {r.doc_id for r in leaks} and {71, 72}.isdisjoint(gone)
    assert dc.find_leaks(docs, bench.limit(0)).count() == 0 and dc.drop_leaks(docs.limit(0), bench).count() == 0
    assert dc.drop_leaks(docs, bench.limit(0)).count() == docs.count()


def test_parts(spark, monkeypatch):
    items, texts = make(4)
    monkeypatch.setattr(dc, "INDEX_BYTES", 900)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(k, k) for k in range(0, 60, 3)} <= {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}


def test_long_item_and_words():
    long = " ".join(f"w{k}" for k in range(400))
    index = dc.Index([(1, long + ".\nthe answer")])
    assert [len(x) for x in index.leaks(["x " * 200 + long + " the answer " + "y " * 300, long[:300], None])] == [1, 0, 0]
    assert dc.words_of(" A, b. -- (c)\n") == ["a", "b", "c"]
    assert dc.parts_of("One two. Three four.") == (["one", "two"], ["three", "four"])
    assert np.isclose(dc.overlap(["a", "b"], ["x", "a", "b"]), 1)


def test_parts_score_as_one_index(spark, monkeypatch):
    items, texts = make(5)
    bench = spark.createDataFrame([*items, (None, None), (99, "")], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: {(r.doc_id, r.item_id): (round(r.score, 9), r.question_overlap, r.answer_overlap, r.n_passages) for r in dc.find_leaks(docs, bench).collect()}
    want = found()
    monkeypatch.setattr(dc, "INDEX_BYTES", 2000)
    assert len(list(dc.indexes(bench))) > 2
    assert want and found() == want
