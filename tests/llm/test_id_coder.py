import random
import zlib

import numpy as np
import pytest

from ledgerlake.llm import id_coder as ic
from ledgerlake.llm.tokens import encoder


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 4097])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), np.minimum(rng.geometric(0.01, n), 49407), np.zeros(n, int), np.tile([5, 9, 70, 40000], n)[:n], np.full(n, 65535)):
        size, words_n, words = ic.encode_blocks(ids.astype(np.uint16), 64)
        assert (ic.decode_blocks(size, words_n, words) == ids).all()


def test_intervals_are_a_mixture():
    """After any history, the intervals of all numbers are disjoint, cover the total and have the mixed sizes."""
    rng = np.random.default_rng(3)
    m, lanes, history = ic._Model(5, 256, True), 5, []
    for step in range(200):
        if step in (8, 40, 150):
            m.renew(np.array(history[-(step - {8: 0, 40: 8, 150: 40}[step]) :], np.uint16))
        m.predict(lanes)
        if step % 20 == 19:
            of = np.arange(257, dtype=np.uint16)
            found = [m.interval(np.full(lanes, k, np.uint16)) for k in of]
            start, size = (np.array([f[j] for f in found]).astype(np.int64) for j in (0, 1))
            share = (m.share[:, :257] & 16383).T
            same, w1, w2 = m.p1 == m.p2, m.w1_.astype(int), m.w2_.astype(int)
            want = share * m.w0 + ((of[:, None] == m.p1) * w1 + (of[:, None] == m.p2) * w2 << ic._SHIFT)
            assert (size == want).all() and (size.sum(0) == 1 << ic._TOTAL).all() and step > 0
            for lane in range(lanes):
                used = np.flatnonzero(size[:, lane])
                order = used[np.argsort(start[used, lane])]
                ends = start[order, lane] + size[order, lane]
                assert start[order[0], lane] == 0 and (start[order[1:], lane] == ends[:-1]).all()
                for k in order:
                    for t in (start[k, lane], start[k, lane] + size[k, lane] - 1):
                        assert m.find(np.full(lanes, t, np.int32))[lane] == k
            m.predict(lanes)
        # numbers by first occurrence: an old one, or the next
        x = np.array([rng.integers(1, s + 2) if s < 250 else 1 for s in m.seen], np.uint16) if step % 3 else np.minimum(m.seen, 1 + step % 4).clip(1).astype(np.uint16)
        m.seen = np.maximum(m.seen, x)
        m.interval(np.where((x <= m.known) | (x == m.p1) | (x == m.p2), x, 0).astype(np.uint16))
        m.learn(x)
        history.append(x)


def test_orders_add_to_each_other():
    """Ids that follow the last two are cheap, ids that follow the last one less so, others by how common they are."""
    rng = np.random.default_rng(5)
    bits = lambda x: 32 * len(ic.encode_blocks(np.asarray(x, np.uint16), 2048)[2]) / len(x)
    flat = rng.integers(0, 64, 8192)
    skewed = np.minimum(rng.geometric(0.2, 8192), 63)
    chain = [0]
    for _ in range(8191):  # the next id depends on the last one, nine times in ten
        chain.append((chain[-1] * 5 + 1) % 64 if rng.random() < 0.9 else int(rng.integers(0, 64)))
    pair = [0, 1]
    for _ in range(8190):
        pair.append((pair[-1] * 5 + pair[-2] * 3 + 1) % 16 if rng.random() < 0.95 else int(rng.integers(0, 16)))
    assert bits(chain) < 3 < bits(skewed) < 4.5 < bits(flat) < 8 and bits(pair) < 2 < bits(rng.integers(0, 16, 8192))


def test_compresses():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 40000, 50)
    ids = np.tile(base, 40)
    assert len(ic.write_frame(ids, [(1, len(ids), False)])) < 2 * len(ids) / 5


def test_damage():
    ids = np.arange(3000) % 700
    frame = ic.write_frame(ids, [(None, 1000, True), (-4, 2000, False)])
    got, docs = ic.read_frame(frame)
    assert (got == ids).all() and docs == [(None, 1000, True), (-4, 2000, False)]
    for at in (0, 10, 40, len(frame) - 200):
        bad = bytearray(frame)
        bad[at] ^= 4
        with pytest.raises(ic.Damaged):
            ic.read_frame(bytes(bad))
    assert len(ic.read_frame(ic.write_frame(np.empty(0, int), []))[0]) == 0


def test_joined_checksum():
    for n in (0, 1, 5, 4000):
        a, b = b"abc" * 7, bytes(range(256)) * 20
        assert ic._crc_joined(zlib.crc32(a), zlib.crc32(b[:n]), n) == zlib.crc32(a + b[:n])


def test_documents(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["one", "two.", "Three", "fôur!"]) for _ in range(rng.choice([0, 3, 50, 900]))), 1) for k in range(40)]
    rows += [(50, None, 1), (3, rows[3][1], 1), (-7, "x " * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    got = sorted(tuple(r) for r in ic.digest(docs).collect())
    start, want = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = encoder().encode(t) + b"\1\0\0\0"
        want.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert got == sorted(want)
    ic.write(docs, f"{tmp_path}/small", block=64, lanes=3)  # documents span frames
    stretches = ic.read(spark, f"{tmp_path}/small").collect()
    assert sum(len(r.ids) for r in stretches) == start and any(r.goes_on for r in stretches)
    assert ic.digest(docs.limit(0)).count() == 0


def test_steps_are_prepared_in_stretches(monkeypatch):
    """The coded words do not depend on how many steps are prepared at once, nor do they if the last block is short."""
    rng = np.random.default_rng(8)
    for n in (1, 70, 3 * 2048 + 1, 3 * 2048 + 513, 4 * 2048):
        ids = np.where(rng.random(n) < 0.5, rng.integers(0, 50, n), rng.integers(0, 65536, n)).astype(np.uint16)
        got = []
        for steps in (1, 7, 32, 5000):
            monkeypatch.setattr(ic, "STEPS", steps)
            got.append([x.tolist() for x in ic.encode_blocks(ids)])
        assert got[0] == got[1] == got[2] == got[3]
        assert (ic.decode_blocks(*map(np.array, got[0][:2]), np.array(got[0][2], np.uint32)) == ids).all()
