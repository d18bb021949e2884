import collections
import itertools
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = list(zip(w, w[1:], w[2:]))
    count, cover = collections.Counter(tri), set()
    for i, g in enumerate(tri):
        if count[g] > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(cover)


def values(rows):
    return np.array([[round(v * q.SCALE) for v in (math.log(max(wc / n, 1)), math.log1p(10 * sy / n), math.log1p(100 * dl / n), rw / n)] for n, wc, sy, dl, rw in rows]) / q.SCALE


def estimate(core, consistency=q.CONSISTENCY):
    mean = core.mean(0)
    return mean, consistency * ((core.T @ core) / len(core) - np.outer(mean, mean)) + np.diag(np.square(q.RIDGE))


def distances(v, mean, cov):
    return np.einsum("ij,jk,ik->i", v - mean, np.linalg.inv(cov), v - mean)


def brute_search(v):
    """(log determinant, mean, covariance) of each start, followed as long as the determinant falls."""
    need = math.ceil(q.CORE * len(v))
    bins = np.sort(np.floor(np.round(v * q.SCALE) * q.X_BINS / q.SCALE), axis=0)
    low, mid, high = (bins[math.ceil(s * len(v)) - 1] for s in (0.25, 0.5, 0.75))
    centre = (mid + 0.5) / q.X_BINS
    spread = np.square(q.NORMAL_QUARTILES * (high - low) / q.X_BINS) + np.square(q.RIDGE)
    out = []
    for mean, cov in ((centre, np.diag(np.square(q.RIDGE))), (centre, np.diag(spread)), estimate(v, 1.0)):
        best = math.inf
        while True:
            d = np.floor(q.D_BINS * np.log2(distances(v, mean, cov) + 1e-6))
            new = estimate(v[d <= np.sort(d)[need - 1]])
            ld = np.linalg.slogdet(new[1])[1]
            if not ld < best - q.FALL:
                break
            best, (mean, cov) = ld, new
        out.append((best, mean, cov))
    return out


def brute_verdict(rows):
    """The same search in numpy over all rows of one group: squared distances."""
    v = values(rows)
    _, mean, cov = min(brute_search(v), key=lambda x: x[0])
    return distances(v, mean, cov)


def texts(rng, n):
    out = []
    for k in range(n):
        words = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200))]
        if k % 9 == 0:
            words = [x + "|" for x in words]
        if k % 7 == 0:
            words[10:20] = words[:10]
        out.append(" ".join(words) + "\n" + " ".join(words[:3]))
    return out


def test_group_equals_numpy(spark):
    rng = random.Random(5)
    rows = [(k, t, "en", "a") for k, t in enumerate(texts(rng, 120))]
    got = {r.doc_id: r for r in q.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    stats = [brute_stats(t) for _, t, _, _ in rows]
    want = brute_verdict(stats)
    for k, s in enumerate(stats):
        assert tuple(got[k][c] for c in q.STATS) == s
        assert abs(got[k].distance2 - want[k]) < 1e-6 * max(1, want[k])
        assert got[k].kept == (want[k] <= q.CUTOFF)
    assert {k for k in got if not got[k].kept} == set(range(0, 120, 9))


def test_least_determinant_of_all_subsets(spark, monkeypatch):
    """A masked group of outliers: the smallest determinant over all subsets gives the same verdicts."""
    monkeypatch.setattr(q, "MIN_GROUP", 4)
    rng = random.Random(11)
    rows = [(k, " ".join("".join(rng.choice("aeiourst") for _ in range(rng.randint(3, 7))) + ("#%|" if k % 5 == 0 else "") for _ in range(80)), "en", "a") for k in range(13)]
    got = {r.doc_id: r.kept for r in q.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    v = values([brute_stats(t) for _, t, _, _ in rows])
    subsets = (v[list(c)] for c in itertools.combinations(range(len(v)), math.ceil(q.CORE * len(v))))
    mean, cov = min((estimate(c) for c in subsets), key=lambda e: np.linalg.slogdet(e[1])[1])
    assert [got[k] for k in range(13)] == (distances(v, mean, cov) <= q.CUTOFF).tolist()
    assert sum(got.values()) == 10


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t|é\x0b", max_size=40), min_size=1, max_size=20))
def test_stats_equal_brute(spark, found):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(found)], "doc_id long, text string")
    out = q.with_stats(df).collect()
    for r in out:
        assert tuple(r[q._P + c] for c in q.STATS) == brute_stats(r.text)


def test_nulls_clashes_and_empty(spark):
    long = " ".join(f"w{k}" for k in range(80))
    schema = "doc_id long, text string, lang string, source string, key string, x0 int, m0 int, level int"
    rows = [(1, None, None, None, "k", 1, 1, 1), (None, "", "en", None, None, 1, 1, 1), (2, long, None, "s", "k", 1, 1, 1), (2, long, None, "s", "k", 1, 1, 1), (3, "one " * 60, "en", "s", "k", 1, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    kept = q.keep_clean(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2, 2]
    assert {(r.doc_id, r.base_failed, r.kept) for r in q.verdicts(docs).collect()} == {(1, True, False), (None, True, False), (2, False, True), (3, True, False)}
    assert q.verdicts(docs.limit(0)).count() == 0 and q.keep_clean(docs.limit(0)).count() == 0
