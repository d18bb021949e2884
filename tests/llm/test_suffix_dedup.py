import hashlib
import random

import numpy as np

from ledgerlake.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        if doc is None:
            continue
        for k in range(len(raw) - sd.SPAN + 1):
            s = raw[k : k + sd.SPAN]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        if doc is not None:
            for k in range(len(raw) - sd.SPAN + 1):
                if first[raw[k : k + sd.SPAN]] < doc:
                    gone[k : k + sd.SPAN] = True
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        out.append((doc, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "e", "on", "ré", "a"]) for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(5)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) // 3)
                parts.append(p[a : len(p) - rng.randint(0, len(p) // 3)])
            else:
                parts.append(" ".join(word() for _ in range(rng.randint(1, 80))))
        rows.append((k * 7 % n, " ".join(parts)))
    rows += [(3, rows[5][1]), (3, rows[5][1]), (n + 1, rows[2][1]), (n + 2, "a" * 3000), (n + 3, "b" + "a" * 700), (None, rows[1][1]), (n + 4, None), (n + 5, ""), (n + 6, "x" * 49)]
    return rows


def test_equals_brute(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int").repartition(5)
        got = sorted((tuple(r) for r in sd.digest(df).collect()), key=str)
        assert got == brute(rows)


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    pos = rng.permutation(3900)[:1500]
    heads = np.array([0, 1, 400, 402, 1100])
    order = sd.merge_sorted(sd.PrefixHashes(data), data, pos, heads)
    raw = data.tobytes()
    for a, b in zip(heads, np.r_[heads[1:], len(pos)]):
        want = sorted(range(a, b), key=lambda k: raw[pos[k] : pos[k] + sd.SPAN])
        assert order[a:b].tolist() == want


def test_collision_repeats_sort(monkeypatch):
    calls = []
    real = sd.PrefixHashes

    class Bad(real):
        def __init__(self, data, seed=0):
            super().__init__(data, seed)
            calls.append(seed)
            if seed == 0:
                self.sums[:] = 0

    monkeypatch.setattr(sd, "PrefixHashes", Bad)
    a, b = b"q" * 8 + b"w" * 60, b"q" * 8 + b"v" * 60
    from ledgerlake.llm.packed import pack

    n = 10
    blob = pack(np.array([1, 2]), np.array([5, 6], np.uint64), np.array([9, 9], np.uint64), np.zeros(2, np.uint32), np.array([n, n], np.uint8), np.frombuffer(a[: n + 49] + b[: n + 49], np.uint8))
    assert sd._sorted_repeats([blob], 4) == [] and calls[:2] == [0, 1]


def test_very_long_texts_are_taken_in_parts(monkeypatch):
    """Every start of a long text is in one unit, and equal units of two long texts still meet."""
    from ledgerlake.llm.packed import unpack

    rng = random.Random(9)
    a = "".join(rng.choice("abcdef ") for _ in range(5000)).encode()
    b = a[1000:4000] + bytes(reversed(a[:2000]))

    def taken(size):
        monkeypatch.setattr(sd, "PASS", size)
        starts, gone = {1: [], 2: []}, []
        for _, kind, blob in sd._block([1, 2], [a, b], 1, 1):
            cols = unpack(blob)
            if kind == sd._UNITS:
                for t, s, n in zip(*(c.tolist() for c in cols[5:8])):
                    starts[int(cols[0][t])] += range(s, s + n)
            else:
                gone += [(d, k) for d, s, e in zip(cols[0].tolist(), cols[2].tolist(), cols[3].tolist()) for k in range(s, e - sd.SPAN + 1)]
        return starts, gone

    for size in (1 << 20, 700):
        starts, gone = taken(size)
        assert sorted(starts[1]) == list(range(len(a) - sd.SPAN + 1))
        assert sorted(starts[2] + [k for _, k in gone]) == list(range(len(b) - sd.SPAN + 1))
        assert {d for d, _ in gone} == {2} and len(gone) > 2500


def blocks(rows):
    """Repeats that one block and one meeting of buckets find, as byte sets by document."""
    from ledgerlake.llm.packed import unpack

    gone = {doc: set() for doc, _ in rows}
    sent = []
    for doc, text in rows:  # each document is a block of its own
        sent += [blob for _, kind, blob in sd._block([doc], [text], 1, 1, 77) if kind == sd._UNITS]
    for kind, blobs in ((0, [blob for _, k, blob in sd._block([d for d, _ in rows], [t for _, t in rows], 1, 1, 77) if k == sd._REPEATS]), (1, sent)):
        cols = [unpack(x) for x in blobs] if kind == 0 else [sd._meet(blobs)[0]]
        for doc, _, start, end in (c[:4] for c in cols):
            for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist()):
                gone[d].update(range(s, e))
    return gone


def thue_morse(n, flip):
    return bytes(b"ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_units_that_meet_in_polynomial_hashes():
    """Texts without a common string of 50 bytes lose nothing, though any polynomial modulo 2**64 gives them one hash."""
    mark = b"zzzzzzzzzzzzzzzz"
    rows = [(1, mark + thue_morse(2048, 0)), (2, mark + thue_morse(2048, 1))]
    assert blocks(rows)[2] <= set(np.flatnonzero([rows[0][1].find(rows[1][1][k : k + sd.SPAN]) >= 0 for k in range(len(rows[1][1]))]).tolist()) | {k + x for k in range(len(rows[1][1]) - sd.SPAN + 1) if rows[1][1][k : k + sd.SPAN] in rows[0][1] for x in range(sd.SPAN)}
    a, b = (mark + bytes(random.Random(s).choices(b"abcdef", k=256)) for s in (1, 2))
    assert blocks([(1, a), (2, b)]) == {1: set(), 2: set()} and blocks([(1, a), (2, a)])[2] == set(range(len(a)))


def test_few_bits_of_the_first_hash_are_no_repeat(monkeypatch):
    """Where the first hash says nothing, the second still keeps units apart."""
    real = sd.keyed
    monkeypatch.setattr(sd, "keyed", lambda *a: (real(*a)[0] & np.uint64(3), real(*a)[1]))
    rows = [(k, (t or "").encode()) for k, (_, t) in enumerate(corpus(3, 40)) if t]
    found = blocks(rows)
    for doc, text in rows:
        want = set()
        for k in range(len(text) - sd.SPAN + 1):
            if any(text[k : k + sd.SPAN] in other for d, other in rows if d < doc):
                want.update(range(k, k + sd.SPAN))
        assert found[doc] <= want
    assert sum(map(len, found.values())) > 1000


def test_keyed_hashes_see_every_byte():
    from ledgerlake.llm.packed import keyed

    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 3000)
    end = start + rng.integers(0, 40, 3000)
    start, end = np.r_[start, 100, 100], np.r_[end, 900, 901]
    for key in (0, 5, (1 << 63) - 1):
        h, g = keyed(data, start, end, key)
        by = {}
        for s, e, x, y in zip(start.tolist(), end.tolist(), h.tolist(), g.tolist()):
            assert by.setdefault(data[s:e].tobytes(), (x, y)) == (x, y)
        assert len({x for x, _ in by.values()}) == len({y for _, y in by.values()}) == len(by)
    assert not np.array_equal(keyed(data, start, end, 1)[0], keyed(data, start, end, 2)[0])


def test_empty(spark):
    assert sd.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_unites_equal_suffixes():
    """A suffix that very many documents hold is compared once a copy, not once a copy and round."""
    n = 4096
    rng = np.random.default_rng(1)
    tails = rng.integers(97, 123, (n, 40)).astype(np.uint8)
    data = np.concatenate([np.concatenate([np.full(60, 120, np.uint8), t]) for t in tails])
    pos = np.arange(n) * 100
    compared = []

    class Counted(sd.PrefixHashes):
        def part(self, start, end):
            compared.append(len(start))
            return super().part(start, end)

    order = sd.merge_sorted(Counted(data), data, pos, np.array([0]))
    assert order.tolist() == list(range(n)) and sum(compared) <= 4 * n
    mixed_ = np.sort(rng.permutation(len(data) - 60)[:3000])
    raw = data.tobytes()
    want = sorted(range(3000), key=lambda k: raw[mixed_[k] : mixed_[k] + sd.SPAN])
    assert sd.merge_sorted(sd.PrefixHashes(data), data, mixed_, np.array([0])).tolist() == want


def test_units_of_a_hot_mark_go_to_several_buckets(monkeypatch):
    """A passage in very many different documents: its mark's suffixes are dealt out, and repeats stay the same."""
    from ledgerlake.llm.packed import pack, unpack

    rng = random.Random(4)
    passage = bytes(rng.randrange(97, 123) for _ in range(40))
    texts = [bytes(rng.randrange(97, 123) for _ in range(34)) + passage + bytes(rng.randrange(97, 123) for _ in range(12)) for _ in range(300)]
    texts[100:200] = [texts[k][:20] + texts[0][20:] for k in range(100)]
    mark = np.full(300, 7, np.uint64)
    runs = np.array([len(t) - sd.SPAN + 1 for t in texts], np.uint8)
    doc, sign, start = np.arange(300) // 2, np.arange(300).astype(np.uint64), np.zeros(300, np.uint32)

    def starts(rows):
        return {(d, g, k) for _, kind, blob in rows if kind == sd._REPEATS for d, g, s, e in zip(*(c.tolist() for c in unpack(blob))) for k in range(s, e)}

    want = starts(sd._sorted_repeats([pack(doc, sign, mark, start, runs, np.frombuffer(b"".join(texts), np.uint8))], 3))
    rows = []
    for some in (slice(0, 140), slice(140, 300)):
        rows += sd._split(doc[some], sign[some], mark[some], start[some], runs[some], np.frombuffer(b"".join(texts[some]), np.uint8), 16, 3)
    buckets = {}
    for b, kind, blob in rows:
        if kind == sd._BYTES:
            buckets.setdefault(b, []).append(blob)
    assert len(buckets) == 16
    got = starts(rows) | {x for blobs_ in buckets.values() for x in starts(sd._sorted_repeats(blobs_, 3))}
    assert want and got == want


def test_hot_marks_equal_brute(spark, monkeypatch, tmp_path):
    split = sd._split

    def seen(*args):
        (tmp_path / str(random.random())).touch()
        return split(*args)

    answer = sd._answer
    monkeypatch.setattr(sd, "HOT", 2)
    # Functions that are not found under their names go to the workers as they are here.
    monkeypatch.setattr(sd, "_split", seen)
    monkeypatch.setattr(sd, "_answer", lambda it, n, m: answer(it, n, m))
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in sd.digest(df).collect()), key=str) == brute(rows)
    assert list(tmp_path.iterdir())


def test_sendings_are_few(spark, monkeypatch):
    """A blob for each shuffle partition and sending, a partition for each bucket, and one sending for some megabytes."""
    from ledgerlake.llm.packed import pack, unpack

    buckets = sd._by_bucket(spark.range(35).selectExpr("cast(id % 7 as int) bucket", "0 kind"), 7)
    assert buckets.selectExpr("bucket", "spark_partition_id() p").distinct().collect() == [(k, k) for k in range(7)]
    dealt_to, real = [], sd._to_units
    monkeypatch.setattr(sd, "_to_units", lambda docs, n, m, key: dealt_to.append((n, m)) or real(docs, n, m, key))
    _, m, width = sd.repeats(spark.createDataFrame([(1, "a" * 60)], "doc_id long, text string"))
    assert dealt_to == [(width, width)] and m == width

    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 123, 100_000).astype(np.uint8).tobytes() for _ in range(40)]
    starts = np.arange(0, 99_000, 60)
    n = len(starts)
    blobs, rows = [], []
    for doc, text in enumerate(texts):
        sign = np.full(n, sd.xxhash.xxh3_64_intdigest(text), np.uint64)
        mark = rng.integers(0, 1 << 62, n).astype(np.uint64)
        blobs.append((0, sd._ASKED, pack(np.full(n, doc), sign, mark, starts.astype(np.uint32), np.full(n, 11, np.uint8), np.zeros(n, np.uint8)), None))
        rows.append((0, 9, sd.zstandard.compress(text), doc))
    batch = sd.pa.RecordBatch.from_arrays([sd.pa.array(list(c), kind) for c, kind in zip(zip(*blobs + rows), (sd.pa.int32(), sd.pa.int32(), sd.pa.binary(), sd.pa.int64()))], names=["bucket", "kind", "blob", "doc_id"])
    sent = [(b, blob) for out in sd._answer([batch], 16, 1) for b, blob in zip(out.column(0).to_pylist(), out.column(2).to_pylist())]
    assert len(sent) == len({b for b, _ in sent}) == 16
    assert sum(len(unpack(blob)[0]) for _, blob in sent) == 40 * n


def test_parts_of_a_bucket_find_the_same(monkeypatch):
    rows = [(k, (t or "").encode()) for k, (_, t) in enumerate(corpus(6, 40)) if t]
    from ledgerlake.llm.packed import pack, unpack

    mark, unit, check, text, start, runs = sd.units([t for _, t in rows], 3)
    data = np.frombuffer(b"".join(rows[t][1][s : s + r + sd.SPAN - 1] for t, s, r in zip(text.tolist(), start.tolist(), runs.tolist())), np.uint8)
    doc = np.array([d for d, _ in rows])[text]
    blob = pack(doc, doc.astype(np.uint64), mark, start.astype(np.uint32), runs.astype(np.uint8), data)
    found = []
    for spread in (1, 4, 16):
        monkeypatch.setattr(sd, "SPREAD", spread)
        found.append({(d, k) for _, _, x in sd._sorted_repeats([blob], 3) for d, _, s, e in zip(*(c.tolist() for c in unpack(x))) for k in range(s, e)})
    assert len(found[0]) > 1000 and found[0] == found[1] == found[2]
