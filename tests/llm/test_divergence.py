import re
from collections import Counter, defaultdict

import duckdb
import pytest

from ledgerlake.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string"


def brute(rows, least, top=50):
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        seen = Counter(t for _, _, ts in own for t in set(ts))
        kept = {t for t, n in seen.items() if n >= least}
        by = defaultdict(Counter)
        for _, source, ts in own:
            by[source].update(t for t in ts if t in kept)
        whole = sum(by.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s in by:
            found = {"pair": [(sum(abs(share(by[s], t) - share(by[u], t)) for t in kept), u) for u in by if u != s]}
            found["term"] = [(share(by[s], t) - share(whole, t), t) for t in kept if by[s][t] and share(by[s], t) > share(whole, t)]
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    words = ["Alpha", "beta", "GAMMA", "délta", "Éps", "zeta9eta", "x_y", "日本", "\x00nul", "ſ"]
    out = []
    for i in range(160):
        text = " ".join(words[(i * k + k * k) % len(words)] for k in range(i % 13))
        out.append((i % 90, text, ("en", "fr", None, "")[i % 4], (None, "s1", "s2", "", "s3")[i % 5], "clash"))
    out += [(1, "alpha " * 5, "en", "hot", "x")] * 40 + [(2, None, "de", "a", "x"), (3, "", "de", "b", "x"), (4, "rare", "de", None, "x"), (5, "ab " * 60000, "en", "s1", "x")]
    return out


@pytest.mark.parametrize("least", [1, 5, 30])
def test_equals_brute_force(spark, rows, least):
    assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA), least=least)) == brute(rows, least)


def test_ranks_to_the_limit_only(spark, rows):
    assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA), least=2, top=3)) == brute(rows, 2, 3)


def test_counts_in_small_holds(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "HOLD", 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(divergence.audit(df, least=5)) == brute(rows, 5)


def test_sql_says_the_same(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, term VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(divergence.SQL).fetchall()) == brute(rows, 30)


def test_empty_table(spark):
    out = divergence.audit(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and dict(out.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
