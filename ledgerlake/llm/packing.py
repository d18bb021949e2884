"""Order-preserving packing by dynamic programming.

Documents are put in order of ``doc_id`` and encoded; their ids, each document's closed by the
end id, form one stream a range of documents. The stream is cut into windows of at most
``WINDOW`` ids. Cuts may lie at document ends (free), sentence ends (``SENTENCE_CUT``) and, in
long stretches without either, every ``HARD_STEP`` ids (``HARD_CUT``). The cost of a window is its
padding, none where its length is a power of two; the cost of a cut is its penalty. With
``best[j] = penalty[j] + WINDOW - c[j] + min(best[i] + c[i])`` over the cuts ``i`` not more than
``WINDOW`` back, a monotone queue gives each minimum in constant time; power-of-two lengths are
looked up besides. The queue and the costs go on through the whole stream, so its windows are those
of one solve: a window is given out once the cheapest ways to all cuts that a later window may still
begin at run through its end. Until then ids are held; ways meet after some windows as a rule, though
no bound is proven. What is left at the end of a range is split into powers of two where that costs
less than its padding.

Null and empty texts are the end id alone. Repeated rows are packed one by one, ordered by text
among equal ids; a null ``doc_id`` comes first. Other columns are not read. Ranges are cut by
sampled borders that are the same on every retry, and sequence ids are the range's number and a
count inside it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import cluster_width, ids_and_texts, pieces
from .tokens import SPLIT_BYTES, encoder

WINDOW = 2048
SENTENCE_CUT, HARD_CUT = 8, 48
HARD_STEP = 128
#: Ids that are gathered before costs go on; the windows do not depend on it.
CHUNK = 64 * WINDOW


@lru_cache(maxsize=4)
def sentence_ends(vocabulary: str | None) -> np.ndarray:
    """For each id whether its piece closes a word and ends with a full stop or the like."""
    e = encoder(vocabulary)
    out = np.zeros(e.vocab_size + 1, bool)
    for piece, k in e._whole.get_vocab(with_added_tokens=True).items():
        if piece.endswith("</w>") and piece[:-4][-1:] in ".!?":
            out[k] = True
    return out


def cuts_of(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may lie, 0 and the end among them, and their penalties."""
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int64)
    penalty[np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[0] = penalty[n] = max(0, int(penalty[n]))
    at = np.flatnonzero(penalty >= 0)
    gap = np.diff(at)
    long = np.flatnonzero(gap > 2 * HARD_STEP)
    if len(long):
        more = np.concatenate([np.arange(at[k] + HARD_STEP, at[k + 1], HARD_STEP) for k in long.tolist()])
        penalty[more] = HARD_CUT
        at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


class Solver:
    """The cheapest windows of a stream whose cuts come bit by bit."""

    def __init__(self, start: int = 0):
        self.cuts, self.best, self.back = [start], [0], [0]
        self.queue: deque[tuple[int, int]] = deque()  # (best + cut, index), values ascending

    def add(self, cuts: list[int], penalty: list[int]) -> None:
        c, best, back, queue = self.cuts, self.best, self.back, self.queue
        exact, bounds = self._powers(cuts)
        value, a = best[-1] + c[-1], 0
        for j, (at, pen, b) in enumerate(zip(cuts, penalty, bounds), len(c)):
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, j - 1))
            floor = at - WINDOW
            while c[queue[0][1]] < floor:
                queue.popleft()
            cost, i = queue[0]
            cost += WINDOW - at
            for k in exact[a:b]:
                if best[k] < cost:
                    cost, i = best[k], k
            a = b
            cost += pen
            value = cost + at
            c.append(at)
            best.append(cost)
            back.append(i)

    def _powers(self, cuts: list[int]) -> tuple[list[int], list[int]]:
        """The cuts that lie a power of two before each new one, nearest first, one after the other; and how many up to each."""
        new = np.array(cuts, np.int64)
        known = np.concatenate([np.array(self.cuts, np.int64), new])
        of, found = [], []
        for p in (1 << k for k in range(WINDOW.bit_length())):
            k = np.searchsorted(known, new - p)
            same = np.flatnonzero(known[k] == new - p)
            of.append(same)
            found.append(k[same])
        of, found = np.concatenate(of), np.concatenate(found)
        return found[np.argsort(of, kind="stable")].tolist(), np.cumsum(np.bincount(of, minlength=len(new))).tolist()

    def path(self, j: int | None = None) -> list[int]:
        """Ends of the windows up to a cut, the last one by default."""
        j, out = len(self.cuts) - 1 if j is None else j, []
        while j:
            out.append(self.cuts[j])
            j = self.back[j]
        return out[::-1]

    def settled(self) -> list[int]:
        """Ends of the windows that no later cut can change; the stream goes on from the last of them."""
        open_ = bisect_left(self.cuts, self.cuts[-1] - WINDOW)
        heap = [-k for k in range(len(self.cuts) - 1, open_ - 1, -1)]
        heapify(heap)
        held = set(heap)
        while len(heap) > 1:  # the latest one steps back until all are one
            way = -self.back[-heappop(heap)]
            if way not in held:
                held.add(way)
                heappush(heap, way)
        a = -heap[0]
        out = self.path(a)
        if a:
            self.cuts, self.best = self.cuts[a:], self.best[a:]
            self.back = [max(0, k - a) for k in self.back[a:]]  # ways that start before it lead nowhere any more
            self.back[0] = 0
            self.queue = deque((v, k - a) for v, k in self.queue if k >= a)
        return out


def windows(cuts: np.ndarray, penalty: np.ndarray) -> list[int]:
    """Ends of the cheapest windows over ``cuts``, the first of which is where the stream starts."""
    solver = Solver(int(cuts[0]))
    solver.add(cuts[1:].tolist(), penalty[1:].tolist())
    return solver.path()


def _tail(length: int) -> list[int]:
    """Lengths of the windows that the last one is split into."""
    bits = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return bits if HARD_CUT * (len(bits) - 1) < WINDOW - length else [length]


class Packer:
    """Takes documents in order, gives pieces: (doc index, start, length, sequence, offset, crc)."""

    def __init__(self, vocabulary: str | None = None):
        self.ends = sentence_ends(vocabulary)
        self.solver = Solver()
        self.ids: list[np.ndarray] = []  # from the end of the last window on
        self.fresh: list[np.ndarray] = []  # documents whose cuts are not known yet
        self.docs: deque[list] = deque()  # [key, total, ids given out]
        self.base = self.total = self.size = self.sequence = 0

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        self.fresh.append(ids)
        self.docs.append([key, len(ids), 0])
        self.size += len(ids)
        if self.size < CHUNK:
            return []
        self._know()
        return self._given(self.solver.settled())

    def end(self) -> list[tuple]:
        if self.fresh:
            self._know()
        found = self.solver.path()
        if not found:
            return []
        start = found[-2] if len(found) > 1 else self.base
        found.pop()
        for part in _tail(self.total - start):
            start += part
            found.append(start)
        return self._given(found)

    def _know(self) -> None:
        """Goes on with the documents at hand; each one's cuts depend on itself alone."""
        ids = np.concatenate(self.fresh)
        cuts, penalty = cuts_of(ids, np.cumsum([len(x) for x in self.fresh]), self.ends)
        self.solver.add((cuts[1:] + self.total).tolist(), penalty[1:].tolist())
        self.ids.append(ids)
        self.total += len(ids)
        self.fresh, self.size = [], 0

    def _given(self, found: list[int]) -> list[tuple]:
        if not found:
            return []
        ids = np.concatenate(self.ids)
        raw = ids[: found[-1] - self.base].astype("<u4").tobytes()
        out, at = [], 0
        for end in found:
            offset = 0
            while at < end - self.base:
                doc = self.docs[0]
                n = min(end - self.base - at, doc[1] - doc[2])
                out.append((doc[0], doc[2], n, zlib.crc32(raw[4 * at : 4 * (at + n)]), doc[1], self.sequence, offset))
                doc[2] += n
                offset += n
                at += n
                if doc[2] == doc[1]:
                    self.docs.popleft()
            self.sequence += 1
        self.ids, self.base = [ids[at:]], found[-1]
        return out


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of ``doc_id``, each sorted."""
    return ids_and_texts(docs).repartitionByRange(cluster_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row a piece; see the module. ``sequence_id`` counts inside a range, above 32 bits of its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(vocabulary), encoder(vocabulary).encode_all
        first = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch_of(rows):
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            cols[5] = [first + s for s in cols[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in pieces(batches, most=SPLIT_BYTES * 3 // 2):
            flat, at = encode(batch.column(1))[:2]
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                rows += packer.add(doc, flat[a:b])
            yield batch_of(rows)
        yield batch_of(packer.end())

    return in_order(docs).mapInArrow(run, SCHEMA)
