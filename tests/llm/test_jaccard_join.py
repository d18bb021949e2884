import random
import re

import duckdb
import numpy as np

from ledgerlake.llm import jaccard_join as jj
from ledgerlake.llm.components import components


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < words else zip(*(w[k:] for k in range(words))))


def brute(rows, words, percent):
    s = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            if s[i] and s[k] and rows[i][0] is not None and rows[k][0] is not None:
                inter = len(s[i] & s[k])
                if 100 * inter >= percent * (len(s[i]) + len(s[k]) - inter):
                    root[find(i)] = find(k)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(s[k]), least[find(k)] if d is not None else None) for k, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=120, family=30):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abÉcdE") for _ in range(rng.randint(1, 3)))
    base = [word() for _ in range(80)]
    line = [word() for _ in range(12)]
    rows = []
    for k in range(n):
        if k < family:
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
        elif k < family + 30:
            w = line + [word() for _ in range(rng.randint(0, 9))]
        elif k % 3 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "").split()
            for _ in range(rng.randint(0, 2)):
                w.insert(rng.randint(0, len(w)), word())
        else:
            w = [word() for _ in range(rng.choice([1, 2, 3, 4, 5, 40]))]
        rows.append((1000 - k * 7 % n, " \n".join(w)))
    return rows + [(5, None), (6, ""), (None, rows[0][1]), (7, " \t"), (8, "one two"), (9, "ONE\x0btwo"), (9, "else where"), (9, rows[3][1])]


def check(spark, rows, words, percent, **how):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, size int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.join(df, words, percent, **how).collect()), key=str)
    assert got == brute(rows, words, percent)


def test_equals_brute(spark):
    check(spark, corpus(1), 4, 85)
    check(spark, corpus(2), 5, 80, small=3, pivots=(1,))  # pivots first, then the rest


def test_components(spark):
    links = [(k, k + 1) for k in range(10, 40)] + [(3, 40), (100, 101), (101, 99), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 3 for k in range(10, 42) if k in got) and got[3] == 3 and got[100] == got[101] == 99 and got[5] == 5


def test_keep_one_and_empty(spark):
    text = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(3, text, "x"), (2, text + " z", "y"), (9, text, None), (4, None, "z"), (None, text, "n"), (7, "other words", "o")], "doc_id long, text string, root string")
    out = jj.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "4", "7", "None"]
    assert jj.join(docs.limit(0)).count() == 0


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_words_that_meet_in_polynomial_hashes(spark):
    rows = [(k, f"one two three {thue_morse(1024, k)}") for k in range(2)] + [(5, thue_morse(2048, 0)), (6, thue_morse(2048, 1)), (7, "x " + "é" * 300_000), (8, "x " + "é" * 299_999 + "e")]
    check(spark, rows, 4, 85)


def test_second_hash_tells_sets_apart():
    """Sets whose n-grams meet in the first hash have one node, and their second hashes differ."""
    t, h = np.array([0, 0, 1, 1]), np.array([5, 9, 5, 9], np.uint64)
    _, node, second = jj._nodes(t, h, np.array([1, 2, 1, 3], np.uint64), 2)
    assert node[0] == node[1] and second[0] != second[1]
    _, node, second = jj._nodes(t, h, np.array([1, 2, 1, 2], np.uint64), 2)
    assert node[0] == node[1] and second[0] == second[1]


def test_key_does_not_matter():
    texts = ["a b c d e", "A b\tc d e f", None, "", "x y", "w" * 2000]
    for words in (2, 4):
        got = [[len(np.unique(h[t == k])) for k in range(len(texts))] for t, h, _ in (jj.sets(texts, words, key) for key in (0, 1, (1 << 63) - 1))]
        assert got[0] == got[1] == got[2] == [len(shingles(x, words)) for x in texts]


def test_sql_says_the_same():
    rows = corpus(1)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(jj.SQL).fetchall(), key=str) == brute(rows, 4, 85)


def test_long_text(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "w0 w1 w2 w3 w4"), (4, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 59_997, 1), (2, 59_998, 1), (3, 2, 3), (4, 0, 4)]


def test_sets_outside_a_large_group_s_core_find_links_early(spark, monkeypatch):
    """Near copies that few others reach are not compared with all of a large group."""
    import types

    rng = random.Random(2)
    base = [f"w{k}" for k in range(145)]
    rows = []
    for k in range(700):
        words = list(base)
        for at in rng.sample(range(len(base)), 1 + rng.randrange(3)):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    counted = []
    real = jj.verified

    def counting(pairs, segments, percent):
        counted.append(pairs.count())
        return real(pairs, segments, percent)

    monkeypatch.setattr(jj, "verified", counting)
    monkeypatch.setattr(jj, "secrets", types.SimpleNamespace(randbits=lambda n: 3 * 0x9E3779B97F4A7C15 % (1 << 63)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()), key=str)
    assert max(counted) < 40 * len(rows) and got == brute(rows, 5, 80)
