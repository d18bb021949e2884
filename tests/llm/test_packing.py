import random
import zlib
from collections import defaultdict

import numpy as np

from ledgerlake.llm import packing as pk
from ledgerlake.llm.tokens import encoder


def cost(cuts, penalty, ends):
    pen, total, at = dict(zip(cuts, penalty)), 0, 0
    for e in ends:
        n = e - at
        assert 0 < n <= pk.WINDOW
        total += pen[e] + (0 if n & (n - 1) == 0 else pk.WINDOW - n)
        at = e
    return total


def test_windows_are_cheapest():
    rng = random.Random(2)
    for _ in range(30):
        gaps = [rng.choice([1, 7, 64, 300, 900, 2000]) for _ in range(rng.randint(1, 40))]
        cuts = [0, *np.cumsum(gaps).tolist()]
        penalty = [rng.choice([0, 8, 48]) for _ in cuts]
        best = [0] + [10**9] * (len(cuts) - 1)
        for j in range(1, len(cuts)):
            for i in range(j):
                n = cuts[j] - cuts[i]
                if n <= pk.WINDOW:
                    best[j] = min(best[j], best[i] + penalty[j] + (0 if n & (n - 1) == 0 else pk.WINDOW - n))
        found = pk.windows(np.array(cuts), np.array(penalty))
        assert found[-1] == cuts[-1] and cost(cuts, penalty, found) == best[-1]


def stream_cost(packer_pieces):
    lengths = defaultdict(int)
    for p in packer_pieces:
        lengths[p[5]] += p[2]
    return [lengths[k] for k in sorted(lengths)]


def test_chunks_do_not_change_the_windows(monkeypatch):
    """Costs go on over chunks: the windows of a stream taken bit by bit are those of one solve over all of it."""
    rng = np.random.default_rng(6)
    for case in range(12):
        sizes = rng.choice([1, 3, 90, 400, 2049, 9000, 30000], 200, p=[0.1, 0.2, 0.3, 0.2, 0.1, 0.08, 0.02])
        stop = np.flatnonzero(pk.sentence_ends(None))
        docs = []
        for n in sizes:
            ids = rng.integers(2, 40000, n).astype("<u4")
            if case % 2:  # else the ids' own sentence ends, and hard cuts
                ids[rng.random(n) < 0.02] = stop[0]
            ids[-1] = 1
            docs.append(ids)
        got = []
        for chunk in (1, 5000, 64 * 2048, 10**9):
            monkeypatch.setattr(pk, "CHUNK", chunk)
            packer = pk.Packer()
            pieces = [p for k, d in enumerate(docs) for p in packer.add(k, d)]
            if chunk == 5000:
                assert len(pieces) > 200 and sum(map(len, packer.ids)) < 200_000  # windows are given out on the way
            got.append(pieces + packer.end())
        assert got[0] == got[1] == got[2] == got[3]
        whole = np.concatenate(docs)
        cuts, penalty = pk.cuts_of(whole, np.cumsum(sizes), pk.sentence_ends(None))
        one, ends = pk.windows(cuts, penalty), np.cumsum(stream_cost(got[0])).tolist()
        assert ends[: len(one) - 1] == one[:-1] and ends[-1] == one[-1]


def test_pieces(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["one", "two.", "Three", "fôur!"]) for _ in range(rng.choice([0, 3, 50, 900, 9000]))) for _ in range(70)]
    texts += [None, "", "word " * 30000, "same.", "same."]
    rows = [(k if k != 5 else None, t, 1) for k, t in enumerate(texts)] + [(3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = pk.pack(docs).collect()
    want = defaultdict(list)
    for d, t, _ in rows:
        want[d].append(np.r_[np.frombuffer(encoder().encode(t), "<u4"), [1]].astype("<u4"))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for d, ids in want.items():
        ps = sorted(pieces[d], key=lambda r: r.start)
        assert sum(r.length for r in ps) == sum(map(len, ids)) and all(r.doc_tokens == len(ids[0]) for r in ps)
        for r in ps:
            assert r.ids_crc32 == zlib.crc32(ids[0][r.start : r.start + r.length].tobytes())
    used = padded = 0
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= pk.WINDOW
        used += at
        padded += at if at & (at - 1) == 0 else pk.WINDOW
    assert used / padded > 0.97
    assert pk.pack(docs.limit(0)).count() == 0


def test_cuts_a_power_of_two_apart_are_found_for_many_cuts_at_once():
    """Also those before the cuts at hand, which an earlier stretch has left."""
    rng = np.random.default_rng(9)
    cuts = np.unique(rng.integers(1, 9000, 3000)).tolist()
    solver = pk.Solver()
    for a, b in ((0, 1), (1, 700), (700, 700), (700, len(cuts))):
        found, bounds = solver._powers(cuts[a:b])
        known = solver.cuts + cuts[a:b]
        want = [[known.index(c - (1 << k)) for k in range(12) if c - (1 << k) in known] for c in cuts[a:b]]
        assert [found[x:y] for x, y in zip([0, *bounds], bounds)] == want
        solver.add(cuts[a:b], [0] * (b - a))
    assert pk.windows(np.array([0, *cuts]), np.zeros(len(cuts) + 1, np.int64)) == solver.path()
