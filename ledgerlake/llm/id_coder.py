"""Token ids in a binary file format, by an adaptive context-mixing range coder.

Ids are cut into blocks of ``BLOCK``. Every block starts from reset models and carries the number
of its ids and words and a checksum, so it can be read, checked and recovered by itself. Inside a
block, ids go by the order of their first occurrence. Each is coded in one step with a mixture of
what three models of different order predict:

* order 0: a distribution over the ids seen so far, from their counts in the block, taken anew at
  the steps of ``_renewals``; a share of it, by how many ids were new of late, is the escape;
* order 1 and order 2: the id that followed the last id, and the last two, when they came last,
  and how often it has been right in a row (up to ``SURE``).

The models' probabilities are added up with weights: ``P(id) = w0 P0(id) + w1 [id = id1] + w2 [id = id2]``.
The weights adapt after each id, in a context of how sure the orders 1 and 2 are. The interval of an
id lies at its place in order 0, those of the other orders' ids widened by their weights; so the
coder needs no escape between orders. After the escape, an id that is new since the last renewal is
coded by its number among those, and an id that is new to the block as 16 plain bits.

Blocks of a frame are coded in lockstep, one numpy lane a block, with a carry-less 64-bit range
coder that puts out 32-bit words.

A file row holds one frame: magic, block length, number of ids, a table of documents (doc_id, ids
of them in this frame, whether the document goes on from the frame before), a table of blocks and
the words. Frames follow the order of ``doc_id``; a document's ids may span frames.

Null and empty texts are the end id alone. Repeated rows are written one by one; a null ``doc_id``
comes first and is kept as null. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, shared_dir
from .packing import in_order
from .tokens import SPLIT_BYTES, encoder

BLOCK = 2048
#: Blocks of a frame at most.
LANES = 4096
MAGIC = b"LLCM2\0"
SURE = 3
_ORDER1, _ORDER2 = 1 << 9, 1 << 10  # slots of a block's tables
_SLOTS = 1 << 12  # order 0 shares of an id are multiples of 1 / _SLOTS
_WEIGHT = 1 << 12  # and weights of 1 / _WEIGHT
_SHIFT, _TOTAL = 12, 24  # bits of the first, and of both
_LEAST, _MOST, _RATE = 64, 3904, 5  # what a weight moves to after a miss, what a hit adds, and how fast
STEPS = 32  # that are prepared at once where ids are coded
_PENDING = 256  # share of an id that is new since the last renewal, against one of 16 plain bits
_SMALL = np.uint64(1 << 28)
_WORD = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def _renewals(block: int) -> set[int]:
    """The steps before which order 0 is taken from the counts anew."""
    return {k for k in (32, 128, 512) if k < block} | set(range(1024, block, 1024))


class _Model:
    """The mixed models of all lanes; ids are numbers by first occurrence, from 1 on; 0 is the escape."""

    def __init__(self, lanes: int, block: int, decodes: bool):
        if block > _SLOTS // 2:
            raise ValueError("blocks are too long")
        self.width = block + 1
        at = np.arange(lanes)
        # Orders 1 and 2 lie one after the other in one table, so that both are looked up at once.
        self.at1, self.at2, self.at_w, self.at_n, self.at_slot = at * _ORDER1, lanes * _ORDER1 + at * _ORDER2, at * (SURE + 1) ** 2, at * self.width, at * _SLOTS
        # Number of the id that came last, and how sure it is in the two low bits.
        self.next = np.zeros(lanes * (_ORDER1 + _ORDER2), np.uint16)
        # The weights of orders 1 and 2 by context, side by side; looked up as one.
        self.weights = np.full((lanes * (SURE + 1) ** 2, 2), _WEIGHT // 16, np.int16)
        self.weights_ = self.weights.view(np.int32).reshape(-1)
        # Start and size of each number's share of order 0; numbers without a share lie at the end.
        self.share = np.full((lanes, self.width), _SLOTS << 14, np.int32)
        self.share[:, 0] = _SLOTS
        self.slot = np.zeros((lanes, _SLOTS), np.uint16) if decodes else None
        self.share_, self.slot_ = self.share.reshape(-1), self.slot.reshape(-1) if decodes else None
        self.counts = np.zeros((lanes, self.width), np.uint16)
        self.known, self.seen, self.known16 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.uint16)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def renew(self, numbers: np.ndarray) -> None:
        """Order 0 from the counts, after the numbers (steps by lanes) coded since the last time."""
        steps, n = numbers.shape
        seen = self.seen[:n]
        d = int(seen.max()) + 1
        self.counts[:n, :d] += np.bincount((numbers + np.arange(n) * d).ravel(), minlength=n * d).reshape(n, d).astype(np.uint16)
        escape = 16 + _SLOTS // 2 * (seen - self.known[:n]) // steps
        counts = self.counts[:n, :d]
        room = (_SLOTS - escape - seen).astype(np.int32)[:, None]
        size = counts * room // np.int32(counts[0].sum()) + (counts > 0)
        size[:, 0] = _SLOTS - size.sum(axis=1)
        start = np.cumsum(size, axis=1) - size
        self.share[:n, :d] = np.where(size > 0, start << 14 | size, _SLOTS << 14)
        self.known[:n] = self.known16[:n] = seen
        if self.slot is not None:
            self.slot[:n] = np.repeat(np.broadcast_to(np.arange(d, dtype=np.uint16), (n, d)).ravel(), size.ravel()).reshape(n, _SLOTS)

    def slots(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where the last numbers (of the first lanes; or steps by lanes) lie in the tables of order 1 and 2."""
        n = last.shape[-1]
        out = np.empty((2, *last.shape), np.int64)
        np.bitwise_and(last, _ORDER1 - 1, out=out[0])
        out[0] += self.at1[:n]
        np.multiply(last, 0x9E5, out=out[1])
        out[1] += before * 0x2C1B3
        out[1] >>= 4
        out[1] &= _ORDER2 - 1
        out[1] += self.at2[:n]
        return out

    def predict(self, n: int) -> None:
        """For the first ``n`` lanes: the numbers that orders 1 and 2 predict, their shares and all weights."""
        self.i = self.slots(self.last[:n], self.before[:n])
        e = self.next.take(self.i)
        self.i_w = self.contexts(e & 3)
        self.weigh(e, self.weights_.take(self.i_w).view(np.int16).reshape(n, 2))
        self.h = self.share_.take(self.at_n[:n] + self.p)
        self.b = self.h >> 14
        self.b1, self.b2 = self.b

    def contexts(self, sure: np.ndarray) -> np.ndarray:
        return self.at_w[: sure.shape[-1]] + ((sure[1] << 2) | sure[0])

    def weigh(self, e: np.ndarray, weights: np.ndarray) -> None:
        """What orders 1 and 2 predict (first axis of ``e``) with which weights (last axis of ``weights``)."""
        self.e, self.weights2 = e, weights
        self.p = p = e >> 2
        self.p1, self.p2 = p
        wide = weights.astype(np.int32)
        w1, w2 = self.w1_, self.w2_ = wide[..., 0], wide[..., 1]
        both = w1 + w2
        self.w0 = _WEIGHT - both
        # Where both predict one number, order 2 has the weight of both.
        self.differ = self.p1 != self.p2
        self.m1 = (w1 * self.differ) << _SHIFT
        self.m2 = (both << _SHIFT) - self.m1

    def interval(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of a number in the mixture; of what lies at the end, order 2's comes before order 1's."""
        share = self.share_.take(self.at_n[: y.shape[-1]] + y)
        b = share >> 14
        self.hit = y == self.p
        return self.mixed(b, share & 16383, self.b1 < b, self.b2 <= b)

    def intervals(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for steps by lanes. Shares lie in the order of numbers, so the predicted ones are not looked up."""
        share = self.share_.take(self.at_n[: y.shape[-1]] + y)
        self.hit = y == self.p
        end = self.known16 + np.uint16(1)
        own, (first, second) = np.minimum(y, end), np.minimum(self.p, end)
        return self.mixed(share >> 14, share & 16383, first < own, second <= own)

    def mixed(self, b, z, over1, over2) -> tuple[np.ndarray, np.ndarray]:
        hit1, hit2 = self.hit
        start, size = self.w0 * b, self.w0 * z
        start += self.m2 * (over2 & ~hit2)
        start += self.m1 * over1
        size += self.m2 * hit2
        size += self.m1 * hit1
        return start.astype(np.uint64), size.astype(np.uint64)

    def find(self, t: np.ndarray) -> np.ndarray:
        """The number whose interval ``t`` lies in."""
        n = len(t)
        first = self.b1 < self.b2
        at, room = self.b * self.w0, (self.h & 16383) * self.w0
        a2 = t - (at[1] + self.m1 * first)
        a1 = t - (at[0] + self.m2 * (self.differ & ~first))
        in2 = a2.view(np.uint32) < (room[1] + self.m2).view(np.uint32)
        in1 = a1.view(np.uint32) < (room[0] + self.m1).view(np.uint32)
        rest = t - self.m2 * (a2 >= 0) - self.m1 * (a1 >= 0)
        # Quotients of such small numbers are exact; inside the two intervals what comes out does not matter.
        other = self.slot_.take(self.at_slot[:n] + (rest / self.w0).astype(np.int64), mode="clip")
        np.copyto(other, self.p1, where=in1)
        np.copyto(other, self.p2, where=in2)
        return other

    def learn(self, x: np.ndarray) -> None:
        """The weights after the coded number, and the tables after the id's own number ``x``."""
        n = len(x)
        self.weights_[self.i_w] = _moved(self.weights2, _aims(self.hit)).view(np.int32).reshape(n)
        self.next[self.i] = _after(self.e, x)
        self.before[:n] = self.last[:n]
        self.last[:n] = x


def _after(e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What orders 1 and 2 hold after a number: the same, surer or less sure, or the number."""
    new, sure = x << 2, e & 3
    return np.where((e ^ new) < 4, e + (sure < SURE), np.where(sure > 1, e - 2, new))


def _aims(hit: np.ndarray) -> np.ndarray:
    """What the weights of orders 1 and 2 (last axis) move to, by what was hit (first axis)."""
    out = np.empty((*hit.shape[1:], 2), np.int16)
    np.greater(hit[0], hit[1], out=out[..., 0], casting="unsafe")
    out[..., 1] = hit[1]
    out *= _MOST
    out += _LEAST
    return out


def _moved(weights: np.ndarray, aims: np.ndarray) -> np.ndarray:
    aims -= weights
    aims >>= _RATE
    aims += weights
    return aims


class _Coder:
    """Interval of each lane; what is settled of it moves out at the top, 32 bits at a time."""

    puts_out = True

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)

    def _narrow(self, low, rng, part, start, size):
        """The interval's part; the lanes whose top word is settled, shifted by it; and the words, where they are put out."""
        low += part * start
        np.multiply(part, size, out=rng)
        ready = (low ^ (low + rng)) <= _LOW
        tight = rng < _SMALL
        if tight.any():  # ranges too small before their top word is settled are cut so that it is
            cut = np.flatnonzero(tight & ~ready)
            rng[cut] = (np.uint64(0) - low[cut]) & (_SMALL - np.uint64(1))
            ready[cut] = True
        lane = np.flatnonzero(ready)
        top = (low[lane] >> _WORD).astype(np.uint32) if self.puts_out else None
        shift = ready.astype(np.uint64) << np.uint64(5)
        low <<= shift
        rng <<= shift
        return lane, top


class _Out(_Coder):
    def __init__(self, lanes: int):
        super().__init__(lanes)
        self.lanes, self.words = [], []

    def code(self, n: int, start, size) -> None:
        """A step of the first ``n`` lanes, of a total of ``1 << _TOTAL``."""
        low, rng = self.low[:n], self.range[:n]
        lane, words = self._narrow(low, rng, rng >> np.uint64(_TOTAL), start, size)
        self.lanes.append(lane)
        self.words.append(words)

    def code_some(self, lane, start, size, total) -> None:
        low, rng = self.low[lane], self.range[lane]
        at, words = self._narrow(low, rng, rng // total, start, size)
        self.lanes.append(lane[at])
        self.words.append(words)
        self.low[lane], self.range[lane] = low, rng

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """How many words each lane has, and all words, lane by lane."""
        every = np.arange(len(self.low))
        self.lanes += [every, every]
        self.words += [(self.low >> _WORD).astype(np.uint32), (self.low & _LOW).astype(np.uint32)]
        lane = np.concatenate(self.lanes)
        # Stable, and quick for small numbers.
        order = np.argsort(lane.astype(np.uint16) if len(every) <= 1 << 16 else lane, kind="stable")
        return np.bincount(lane, minlength=len(every)), np.concatenate(self.words)[order]


class _In(_Coder):
    puts_out = False

    def __init__(self, words: np.ndarray, start: np.ndarray, n: np.ndarray):
        super().__init__(len(start))
        self.words, self.at = np.r_[words, np.zeros(2, np.uint32)].astype(np.uint64), start + 2
        self.value = (self.words[start] << _WORD) | self.words[start + 1]

    def _more(self, lane) -> None:
        """The next words of some lanes; whole blocks never ask for more than they have."""
        at = self.at[lane]
        self.value[lane] = (self.value[lane] << _WORD) | self.words.take(at, mode="clip")
        self.at[lane] = at + 1

    def target(self, n: int) -> np.ndarray:
        self.part = self.range[:n] >> np.uint64(_TOTAL)
        return np.minimum((self.value[:n] - self.low[:n]) // self.part, np.uint64((1 << _TOTAL) - 1)).astype(np.int32)

    def take(self, n: int, start, size) -> None:
        self._more(self._narrow(self.low[:n], self.range[:n], self.part, start, size)[0])

    def target_some(self, lane, total) -> np.ndarray:
        self.some = low, rng = self.low[lane], self.range[lane]
        self.part = rng // total.astype(np.uint64)
        return np.minimum((self.value[lane] - low) // self.part, (total - 1).astype(np.uint64)).astype(np.int64)

    def take_some(self, lane, start, size) -> None:
        """The part of the lanes that ``target_some`` was just asked for."""
        low, rng = self.some
        at, _ = self._narrow(low, rng, self.part, start.astype(np.uint64), size.astype(np.uint64))
        self.low[lane], self.range[lane] = low, rng
        self._more(lane[at])


def _numbered(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ids (lanes by steps): each id's number by first occurrence in its lane, and whether it is the first."""
    lanes, block = grid.shape
    number, first = np.empty((lanes, block), np.uint16), np.empty((lanes, block), bool)
    step = min(lanes, 64)
    place = np.empty(step << 16, np.int32)
    order = np.arange(block, dtype=np.int32)
    for at in range(0, lanes, step):
        part = grid[at : at + step]
        key = part + (np.arange(len(part), dtype=np.int32) << 16)[:, None]
        # Of equal keys the value assigned last stays: the first step, as they come from the back.
        place[np.ascontiguousarray(key[:, ::-1]).ravel()] = np.ascontiguousarray(np.broadcast_to(order[::-1], part.shape)).ravel()
        where = place.take(key)
        new = where == order
        number[at : at + step] = np.take_along_axis(np.cumsum(new, axis=1, dtype=np.uint16), where, axis=1)
        first[at : at + step] = new
    return number, first


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of each block, words of each block, all words) of 16-bit ids, blocks in lockstep."""
    lanes = -(-len(ids) // block)
    size = np.full(lanes, block)
    size[-1] = len(ids) - (lanes - 1) * block
    grid = np.zeros(lanes * block, np.uint16)
    grid[: len(ids)] = ids
    grid = grid.reshape(lanes, block)
    number, first = (np.ascontiguousarray(x.T) for x in _numbered(grid))
    m, out = _Model(lanes, block, False), _Out(lanes)
    most = int(size[0])
    seen = np.zeros((STEPS + 1, lanes), np.uint16)  # before each step from ``a`` on
    history = np.zeros((STEPS + 2, lanes), np.int64)  # numbers from two steps before ``a`` on
    edges = sorted({0, most, *(k for k in _renewals(block) if k < most), *range(0, most, STEPS)})
    renewals, done = _renewals(block), 0
    for a, b in zip(edges, edges[1:]):
        if a in renewals:
            n = lanes if a < size[-1] else lanes - 1
            m.seen[:n] = seen[0, :n]
            m.renew(number[done:a, :n])
            done = a
        # All numbers are known, so only the tables and weights go step by step, then the coder;
        # what the last block lacks is carried on with and not coded.
        x = number[a:b]
        history[2 : b - a + 2] = x
        at = m.slots(history[1 : b - a + 1], history[: b - a])
        e = np.empty(at.shape, np.uint16)
        for k in range(b - a):
            own = m.next.take(at[:, k])
            e[:, k] = own
            m.next[at[:, k]] = _after(own, x[k])
            np.add(seen[k], first[a + k], out=seen[k + 1])
        at, guess = m.contexts(e & 3), e >> 2
        escaped = (x > m.known16) & (x != guess[0]) & (x != guess[1])
        y = np.where(escaped, np.uint16(0), x)
        aims = _aims(y == guess)
        weights = np.empty(at.shape, np.int32)
        for k in range(b - a):
            own = weights[k] = m.weights_.take(at[k])
            m.weights_[at[k]] = _moved(own.view(np.int16).reshape(lanes, 2), aims[k]).view(np.int32).reshape(lanes)
        m.weigh(e, weights.view(np.int16).reshape(*weights.shape, 2))
        start, length = m.intervals(y)
        step, lane = np.nonzero(escaped)
        known = m.known[lane]
        pending, new = seen[step, lane] - known, first[a + step, lane]
        some = np.where(new, pending * _PENDING + grid[lane, a + step], (x[step, lane] - known - 1) * _PENDING).astype(np.uint64)
        some_size, total = np.where(new, 1, _PENDING).astype(np.uint64), (pending * _PENDING + 65536).astype(np.uint64)
        bounds = np.searchsorted(step, np.arange(b - a + 1)).tolist()
        for k in range(b - a):
            n, p, q = (lanes if a + k < size[-1] else lanes - 1), bounds[k], bounds[k + 1]
            if n < lanes and q > p and lane[q - 1] == n:
                q -= 1
            out.code(n, start[k, :n], length[k, :n])
            if q > p:
                out.code_some(lane[p:q], some[p:q], some_size[p:q], total[p:q])
        seen[0], history[:2] = seen[b - a], history[b - a : b - a + 2]
    return size, *out.close()


def decode_blocks(size: np.ndarray, n_words: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids that :func:`encode_blocks` was given; blocks may be any subset, longest first."""
    lanes, block = len(size), int(size.max())
    number = np.zeros((block, lanes), np.uint16)
    m, source = _Model(lanes, block, True), _In(words, np.cumsum(n_words) - n_words, n_words)
    named = np.zeros((lanes, block + 1), np.uint16)  # ids by number
    named_ = named.reshape(-1)
    renewals, done = _renewals(block), 0
    active = np.searchsorted(-size, -np.arange(block), "left")
    for step in range(block):
        n = int(active[step])
        if step in renewals:
            m.renew(number[done:step, :n])
            done = step
        m.predict(n)
        x = m.find(source.target(n))
        source.take(n, *m.interval(x))
        lane = np.flatnonzero(x == 0)
        if len(lane):
            seen, known = m.seen[lane], m.known[lane]
            pending = (seen - known) * _PENDING
            t = source.target_some(lane, pending + 65536)
            new = t >= pending
            old = t // _PENDING
            source.take_some(lane, np.where(new, t, old * _PENDING), np.where(new, 1, _PENDING))
            seen += new
            m.seen[lane] = seen
            x[lane] = np.where(new, seen, known + 1 + old)
            k = np.flatnonzero(new)
            named_[lane[k] * (block + 1) + seen[k]] = (t - pending)[k]
        number[step, :n] = x
        m.learn(x)
    keep = np.arange(block) < size[:, None]
    return np.take_along_axis(named, number.T, axis=1)[keep]


_HEAD = struct.Struct("<6sIQII")


def write_frame(ids: np.ndarray, docs: list[tuple[int | None, int, bool]], block: int = BLOCK) -> bytes:
    """One frame. ``docs``: (doc_id, ids in this frame, goes on from before). Ids must fit 16 bits."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids of more than 16 bits")
    size, n, words = encode_blocks(ids, block) if len(ids) else (np.empty(0, int),) * 2 + (np.empty(0, np.uint32),)
    raw = ids.astype("<u2").tobytes()
    sums = [zlib.crc32(raw[2 * block * k : 2 * block * (k + 1)]) for k in range(len(size))]
    parts = [
        _HEAD.pack(MAGIC, block, len(ids), len(docs), len(size)),
        np.array([d or 0 for d, _, _ in docs], "<i8").tobytes(),
        np.array([n_ for _, n_, _ in docs], "<u4").tobytes(),
        bytes((d is None) | go << 1 for d, _, go in docs),
        size.astype("<u4").tobytes(),
        n.astype("<u4").tobytes(),
        np.array(sums, "<u4").tobytes(),
        words.astype("<u4").tobytes(),
    ]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body[: len(body) - 4 * len(words)]))


class Damaged(ValueError):
    """A frame or block whose checksum does not hold."""


def read_frame(frame: bytes) -> tuple[np.ndarray, list[tuple[int | None, int, bool]]]:
    """(ids, docs) of a frame; raises :class:`Damaged` where a checksum fails."""
    magic, block, n_ids, n_docs, n_blocks = _HEAD.unpack_from(frame)
    if magic != MAGIC:
        raise Damaged("not a frame")
    at = _HEAD.size

    def take(kind, n):
        nonlocal at
        out = np.frombuffer(frame, kind, n, at)
        at += out.nbytes
        return out

    ids, sizes, marks = take("<i8", n_docs), take("<u4", n_docs), take(np.uint8, n_docs)
    size, n, sums = take("<u4", n_blocks).astype(np.int64), take("<u4", n_blocks).astype(np.int64), take("<u4", n_blocks)
    if zlib.crc32(frame[:at]) != struct.unpack("<I", frame[-4:])[0]:
        raise Damaged("header")
    words = take("<u4", int(n.sum()))
    values = decode_blocks(size, n, words) if n_blocks else np.empty(0, np.uint16)
    raw = values.astype("<u2").tobytes()
    for k in range(n_blocks):
        if zlib.crc32(raw[2 * block * k : 2 * block * (k + 1)]) != sums[k]:
            raise Damaged(f"block {k}")
    if len(values) != n_ids:
        raise Damaged("length")
    return values.astype(np.uint32), [(None if m & 1 else i, s, bool(m & 2)) for i, s, m in zip(ids.tolist(), sizes.tolist(), marks.tolist())]


def write(docs: DataFrame, path: str, vocabulary: str | None = None, block: int = BLOCK, lanes: int = LANES) -> None:
    """Writes the ids of ``docs`` in ascending ``doc_id`` order as frames under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_all
        part = TaskContext.get().partitionId()
        hold: list[np.ndarray] = []
        table: list[tuple] = []
        size = frame = 0

        def flush():
            nonlocal hold, table, size, frame
            ids = np.concatenate(hold)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([write_frame(ids, table, block)], pa.binary())], names=["part", "frame", "n_ids", "data"])
            hold, table, size, frame = [], [], 0, frame + 1
            return row

        for batch in pieces(batches, most=SPLIT_BYTES * 3 // 2):
            flat, at = encode(batch.column(1))[:2]
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                ids, go = flat[a:b], False
                while len(ids):
                    now, ids = ids[: block * lanes - size], ids[block * lanes - size :]
                    hold.append(now)
                    table.append((doc, len(now), go))
                    size, go = size + len(now), True
                    if size == block * lanes:
                        yield flush()
        if table:
            yield flush()

    in_order(docs).mapInArrow(run, "part int, frame int, n_ids long, data binary").write.parquet(path)


_STRETCH = "part int, frame int, place int, doc_id long, goes_on boolean"


def _frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, frame int, n_ids long, data binary").parquet(path).select("part", "frame", "data")


def _stretches(batches: Iterator[pa.RecordBatch]):
    """For each frame of the files: the columns of ``_STRETCH``, all ids, and where each stretch begins in them."""
    for batch in batches:
        for part, frame, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            ids, docs = read_frame(data)
            n = len(docs)
            cols = [pa.array([part] * n, pa.int32()), pa.array([frame] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([d for d, _, _ in docs], pa.int64()), pa.array([g for _, _, g in docs], pa.bool_())]
            yield cols, ids, np.r_[0, np.cumsum([s for _, s, _ in docs], dtype=np.int64)]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, frame, place, doc_id, goes_on, ids) of each document's stretch in each frame, from the files."""

    def run(batches):
        for cols, ids, at in _stretches(batches):
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], names=[*(c.split()[0] for c in _STRETCH.split(", ")), "ids"])

    return _frames(spark, path).mapInArrow(run, f"{_STRETCH}, ids array<int>")


def _crc_joined(a: int, b: int, n: int) -> int:
    """Checksum of two strings one after the other, from theirs and the second's length."""
    square, odd = [0] * 32, [0xEDB88320] + [1 << k for k in range(31)]

    def times(mat, vec):
        out = k = 0
        while vec:
            if vec & 1:
                out ^= mat[k]
            vec >>= 1
            k += 1
        return out

    def squared(mat):
        return [times(mat, v) for v in mat]

    square = squared(squared(odd))
    while n:
        square = squared(square)
        if n & 1:
            a = times(square, a)
        n >>= 1
    return a ^ b


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes ``docs``, reads the files back, and gives (doc_id, start, n_tokens, ids_crc32) from them."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, path, vocabulary)

    def run(batches):
        for cols, ids, at in _stretches(batches):
            raw, bounds = ids.astype("<u4").tobytes(), (4 * at).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=[*(c.split()[0] for c in _STRETCH.split(", ")), "n", "crc"])

    stretch = _frames(spark, path).mapInArrow(run, f"{_STRETCH}, n long, crc long")

    def whole(batches):
        """Stretches of a part in order; documents that span frames are joined."""
        part, offset, hold = None, 0, None
        for batch in batches:
            rows = []
            for p, _, _, doc, goes_on, n, crc in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if p != part:
                    if hold:
                        rows.append(hold)
                    part, offset, hold = p, 0, None
                if goes_on:
                    hold = (*hold[:3], hold[3] + n, _crc_joined(hold[4], crc, 4 * n))
                else:
                    if hold:
                        rows.append(hold)
                    hold = (p, doc, offset, n, crc)
                offset += n
            yield _rows(rows)
        if hold:
            yield _rows([hold])

    def _rows(rows):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = stretch.repartition(width, "part").sortWithinPartitions("part", "frame", "place").mapInArrow(whole, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # One row a part: how many ids the parts before it have.
    before = spark.read.schema("part int, n_ids long").parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = before.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return one.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
