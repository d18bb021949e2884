import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from ledgerlake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role.encode(), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [x[4:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c > 0 else -1)
        rebuilt[c] = tuple(own.get(c - rest, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for node, cs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        childless = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        ended = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(node))
        out.append((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(x) == len(node) + 1 for x in under), len(childless),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x), hashlib.sha256(ended.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    out = []
    for c in range(-7, 120):
        for turn in range(random.choice([0, 1, 2, 3, 5, 9, 14])):
            out.append((c, random.choice([turn, turn, turn, None, 3]), random.choice(["user", "assistant", None, ""]), random.choice(["hi", "hé", "", None, "long " * 50]), "clash", 1))
    out += [(c, t, "user", "copy", "clash", 1) for c in range(1000, 1100) for t in range(3)]  # a group of copies
    out += [(2000, t, "user", f"turn {t % 3}", "clash", 1) for t in range(150)] + [(2001, t, "user", f"turn {t % 3}", "clash", 1) for t in range(149)]
    out += out[:20] + [(None, 1, "user", "none", "clash", 1), (5005, 0, "user", "x" * 300_000, "clash", 1)]
    return out


@pytest.mark.parametrize("heavy", [1, 60, 4096, 10**9])
def test_equals_brute_force(spark, rows, heavy):
    assert rows_of(prefix_trie.rollups(spark.createDataFrame(rows, SCHEMA).repartition(3), heavy)) == brute(rows)


def test_turnless_conversations_are_in_the_root(spark):
    alone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(alone, 0, "user", "gone", None, None), (alone, 1, "user", "gone too", None, None)]
    none = hashlib.sha256(str(alone).encode()).hexdigest()
    assert rows_of(prefix_trie.rollups(spark.createDataFrame(rows, SCHEMA))) == [(alone, 0, None, 1, 0, 1, 0, none)] == brute(rows)


def test_no_conversations(spark):
    assert rows_of(prefix_trie.rollups(spark.createDataFrame([], SCHEMA))) == []


def test_sql_says_the_same(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, depth VARCHAR, a INT)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?, ?)", [r for r in rows if r[0] is None or r[0] < 2000])
    found = con.execute(prefix_trie.SQL)
    assert [x[0] for x in found.description] == COLUMNS
    assert sorted(found.fetchall(), key=str) == brute([r for r in rows if r[0] is None or r[0] < 2000])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_given_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    got = rows_of(prefix_trie.rollups(spark.read.parquet(path), 200))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    assert got == sorted(con.execute(prefix_trie.SQL).fetchall(), key=str)


def test_level_order_trie():
    rng = np.random.default_rng(3)
    above = np.array([-1, -1, *(rng.integers(-1, k) for k in range(2, 300))])
    level = np.zeros(300, np.int64)
    for k, up in enumerate(above):
        level[k] = 0 if up < 0 else level[up] + 1
    shuffled = rng.permutation(300)
    where = np.argsort(shuffled)
    trie = prefix_trie.Louds(level[shuffled], np.where(above[shuffled] < 0, -1, where[above[shuffled]]))
    rows = shuffled[trie.order]
    up = trie.parents()
    assert [above[r] for r in rows] == [-1 if u == 0 else rows[u - 1] for u in up]
    assert sorted(k for node in range(301) for k in trie.children(node)) == list(range(1, 301))
    assert all(up[k - 1] == node for node in range(301) for k in trie.children(node))
    want = np.ones(300, np.int64)
    for k in np.argsort(-level, kind="stable"):
        if above[k] >= 0:
            want[above[k]] += want[k]
    total = trie.summed(np.ones(300, np.int64))
    assert total[0] == 300 and list(total[1:]) == list(want[rows])
    assert prefix_trie.Louds(np.empty(0, np.int64), np.empty(0, np.int64)).parents().size == 0
