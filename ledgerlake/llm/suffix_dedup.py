"""Removal of repeated byte strings across documents, by sorting suffixes.

A byte goes when a string of ``SPAN`` bytes that covers it also starts in a document with a
smaller ``doc_id``. All suffixes of a corpus can't be sorted in one place, so they are dealt out
by content: each start of a ``SPAN``-byte string belongs to the least scrambled hash of the
``GRAM``-byte strings inside it (its mark). Equal strings have equal marks, and neighbouring
starts mostly share one, so they travel as units: runs of starts with one mark.

1. Units of a block of documents are hashed, with a key drawn for each run. Of equal units in a
   block, only those of the smallest document are sent on, by mark; the others are repeats.
2. Where units of one mark meet, equal units of larger documents are repeats. First owners of
   units with one mark but different bytes may share shorter strings: their bytes are asked for.
   A mark with very many units (``HOT``) is taken apart: tasks that answer sort its suffixes among
   themselves first, and send on those that are no repeat there, start by start, dealt out by a
   hash of their ``SPAN`` bytes as well. So a passage that very many documents hold is no load of one task.
3. Their suffixes are sorted inside each mark: by the first eight bytes, then by a mergesort
   whose comparisons find the common extension by binary search over prefix hashes, and which
   unites equal suffixes where they meet. Neighbours
   in that order that agree over ``SPAN`` bytes, checked byte by byte, form groups; all but those
   of the smallest document are repeats. A hash collision repeats the sort with other constants.

Whole units are compared by 96 bits of two independent hashes of their bytes, suffixes by their bytes.
First owners suffice in step 3: the smallest document with a string has it in a unit that no smaller one has.

Nulls: a null text is empty; a document with a null ``doc_id`` neither takes nor gives. Rows with
one ``doc_id`` don't remove from each other, and each is judged by its own text. Texts under
``SPAN`` bytes stay whole. Other columns are not read. Blocks, buckets and sorts hold a bounded
share of the corpus; lineage is cut in the shared folder between the steps. There is a bucket a shuffle
partition; what a task sends is gathered before it is packed, as every sending has a blob for each bucket
and so the blobs are many where the corpus is large. Buckets are taken in parts of marks where they are sorted.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cluster_width, ids_and_texts, pieces, settled
from .packed import by_bucket, dealt, keyed, mixed, pack, ranges, unpack

SPAN = 50
GRAM = 16
#: Starts of one unit at most; longer runs (one letter repeated) are cut.
RUN = 255
#: Bytes of text of one block, and of one pass of numpy inside it.
BLOCK, PASS = 16 << 20, 1 << 20
#: Bytes of units asked for that are held before they are sent; those of hot marks are sorted first.
ANSWER, HOT_ANSWER = 16 << 20, 2 << 20
#: A mark with more units than this is sorted in parts, dealt out start by start.
HOT = 1 << 15
#: Parts of a bucket of marks that are sorted one after the other.
SPREAD = 4
#: Repeats and requests that a task gathers before it packs them, over all its buckets.
GATHER = 2_000_000

_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_BLOBS = "bucket int, kind int, blob binary"


def _letters(seed: int = 0) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


class PrefixHashes:
    """Polynomial hashes modulo 2**64 of all prefixes; hash of any part in constant time."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        base = (_BASE + 2 * seed) | 1
        n = len(data)
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters(seed)[data] * power[:n], out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Scrambled hash of each ``GRAM``-byte string, by doubling."""
    h, size = _letters()[data], 1
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(pow(0x100000001B3, size, 1 << 64)) + h[size:]
        size *= 2
    return mixed(h)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def units(texts: list[bytes], key: int) -> tuple[np.ndarray, ...]:
    """Of each unit: mark, hash, 32 bits of a second one, text number, first start inside the text, number of starts."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < SPAN:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint32), none, none, none
    end = np.cumsum(size)
    marks = _sliding_min(_gram_hashes(data), SPAN - GRAM + 1)
    text = np.repeat(np.arange(len(size)), size)[: len(marks)]
    fits = np.arange(len(marks)) + SPAN <= end[text]
    new = np.r_[True, (marks[1:] != marks[:-1]) | (text[1:] != text[:-1])]
    start = np.flatnonzero(new & fits)
    runs = np.minimum(np.r_[start[1:], len(marks)], end[text[start]] - SPAN + 1) - start
    if (runs > RUN).any():
        parts = -(-runs // RUN)
        k, owner = ranges(np.zeros(len(runs), np.int64), parts)
        start, runs = start[owner] + k * RUN, np.minimum(RUN, runs[owner] - k * RUN)
    unit, check = keyed(data, start, start + runs + SPAN - 1, key)
    t = text[start]
    return marks[start], unit, check.astype(np.uint32), t, start - (end - size)[t], runs


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts; keys are sorted together."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _by_unit(mark: np.ndarray, unit: np.ndarray, check: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Order by mark, unit and document; only where marks repeat is more than the mark compared."""
    order = np.argsort(mark)
    same = mark[order[1:]] == mark[order[:-1]]
    some = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    of = order[some]
    order[some] = of[np.lexsort((doc[of], check[of], unit[of], mark[of]))]
    return order


def _spread_first(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values[starts], np.diff(np.r_[starts, n]))


# Marks are minima and so crowd among small numbers: they are scrambled again before dealing.
def _doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return dealt(mixed(ids.astype(np.int64).view(np.uint64)), n)


def _intervals(ids, hashes, starts, ends, n: int) -> Iterator[tuple[int, bytes]]:
    for b, cols in by_bucket(_doc_bucket(ids, n), ids, hashes, starts.astype(np.uint32), ends.astype(np.uint32)):
        yield b, pack(*cols)


def _by_part(mark: np.ndarray, *columns: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The columns of each part of a bucket; marks of a bucket agree in high bits, so parts go by low ones."""
    for _, cols in by_bucket((mixed(mark) & np.uint64(SPREAD - 1)).astype(np.uint8), *columns):
        yield cols


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])


# Kinds of blobs
_UNITS, _REPEATS, _ASKED, _BYTES = range(4)


def _block(ids: list[int], texts: list[bytes], n: int, m: int, key: int = 0) -> list[tuple]:
    """Blobs of one block: units to send on, and repeats inside the block."""
    found: list[list[np.ndarray]] = [[], [], [], [], [], []]
    at = 0

    def add(some: list[bytes], first: int, shift: int = 0):
        for into, values in zip(found, units(some, key)):
            into.append(values)
        found[3][-1] = found[3][-1] + first
        found[4][-1] = found[4][-1] + shift

    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PASS):
            size += len(texts[end])
            end += 1
        if size <= 2 * PASS:
            add(texts[at:end], at)
        else:  # one very long text: its starts are taken in parts, which at most cuts a unit in two
            for shift in range(0, len(texts[at]) - SPAN + 1, PASS):
                add([texts[at][shift : shift + PASS + SPAN - 1]], at, shift)
        at = end
    mark, unit, check, text, start, runs = (np.concatenate(x) for x in found)
    doc = np.array(ids, np.int64)
    order = _by_unit(mark, unit, check, doc[text])
    mark, unit, check, text, start, runs = (x[order] for x in (mark, unit, check, text, start, runs))
    owner = doc[text]
    heads = _groups(mark, unit, check)
    repeat = owner > _spread_first(owner, heads, len(mark))
    sign = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
    rows = [(b, _REPEATS, blob) for b, blob in _intervals(owner[repeat], sign[text[repeat]], start[repeat], start[repeat] + runs[repeat] + SPAN - 1, m)]
    sent = ~repeat
    for b, (k, u, c, t, s, r) in by_bucket(dealt(mixed(mark[sent]), n), mark[sent], unit[sent], check[sent], text[sent], start[sent], runs[sent]):
        used, t = np.unique(t, return_inverse=True)
        step = np.r_[k[:1], k[1:] - k[:-1]]
        rows.append((b, _UNITS, pack(doc[used], sign[used], step, u, c, t.astype(np.uint32), s.astype(np.uint32), r.astype(np.uint8))))
    return rows


def _to_units(docs: DataFrame, n: int, m: int, key: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def flush():
            return _batch(_block(ids, texts, n, m, key))

        for batch in pieces(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not t:
                    continue
                raw = t.encode("utf-8", "surrogatepass")
                if len(raw) < SPAN:
                    continue
                ids.append(i)
                texts.append(raw)
                size += len(raw)
                if size >= BLOCK:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, _BLOBS)


def _by_bucket(df: DataFrame, width: int) -> DataFrame:
    """Buckets are as many as partitions, so each is sent to the partition of its number and no two share one by chance."""
    return df.repartitionById(width, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def _bucketwise(batches: Iterator[pa.RecordBatch], full) -> Iterator[pa.RecordBatch]:
    """Calls ``full(bucket, blobs)`` for each bucket of a sorted partition; repeats that are known pass through."""
    now, blobs = None, []
    for batch in batches:
        passed = batch.filter(pc.equal(batch.column(1), _REPEATS))
        if passed.num_rows:
            yield passed
        batch = batch.filter(pc.not_equal(batch.column(1), _REPEATS))
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if b != now:
                if blobs:
                    yield _batch(full(now, blobs))
                now, blobs = b, []
            blobs.append(blob)
    if blobs:
        yield _batch(full(now, blobs))


def _meet(blobs: list[bytes], most: int = HOT) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Repeats among whole units of one bucket, and which units' bytes are asked for."""
    cols: list[list[np.ndarray]] = [[] for _ in range(7)]
    for blob in blobs:
        ids, sign, step, u, c, t, s, r = unpack(blob)
        for into, v in zip(cols, (np.cumsum(step), u, c, ids[t], sign[t], s, r)):
            into.append(v)
    whole = [np.concatenate(c) for c in cols]
    found = [_meet_part(*part, most) for part in _by_part(whole[0], *whole)]
    return tuple([np.concatenate(c) for c in zip(*side)] for side in zip(*found))


def _meet_part(mark, unit, check, doc, sign, start, runs, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    order = _by_unit(mark, unit, check, doc)
    mark, unit, check, doc, sign, start, runs = (x[order] for x in (mark, unit, check, doc, sign, start, runs))
    size = len(mark)
    whole = _groups(mark, unit, check)
    repeat = doc > _spread_first(doc, whole, size)
    marks = _groups(mark)
    span = np.diff(np.r_[marks, size])
    several = np.repeat((np.minimum.reduceat(doc, marks) != np.maximum.reduceat(doc, marks)), span)
    kinds = np.zeros(size, np.int64)
    kinds[whole] = 1
    several &= np.repeat(np.add.reduceat(kinds, marks) > 1, span)
    start, end = start.astype(np.int64), start.astype(np.int64) + runs + SPAN - 1
    asked = several & ~repeat
    hot = np.repeat(np.add.reduceat(asked.astype(np.int64), marks) > most, span)
    return [doc[repeat], sign[repeat], start[repeat], end[repeat]], [doc[asked], sign[asked], mark[asked], start[asked].astype(np.uint32), runs[asked].astype(np.uint8), hot[asked].astype(np.uint8)]


def _packed(repeats: list[list[np.ndarray]], asked: list[list[np.ndarray]], m: int) -> list[tuple]:
    rows = []
    if repeats:
        rows += _told(repeats, m)
    if asked:
        cols = [np.concatenate(c) for c in zip(*asked)]
        rows += [(b, _ASKED, pack(*c)) for b, c in by_bucket(_doc_bucket(cols[0], m), *cols)]
    return rows


def _with_docs(docs: DataFrame, blobs: DataFrame, n: int, width: int) -> DataFrame:
    """Blobs and documents of each bucket in one place, blobs first. Texts travel compressed."""

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches):
            ids = batch.column(0).to_pylist()
            texts = [squeeze((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            # Documents without an id meet no blobs; they are dealt out by their texts.
            bucket = _doc_bucket(np.array([xxhash.xxh3_64_intdigest(t) >> 1 if i is None else i for i, t in zip(ids, texts)], np.int64), n)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([9] * len(ids), pa.int32()), pa.array(texts, pa.binary()), batch.column(0)], names=["bucket", "kind", "blob", "doc_id"])

    both = docs.mapInArrow(zipped, _BLOBS + ", doc_id long").unionByName(blobs.withColumn("doc_id", F.lit(None).cast("long")))
    return _by_bucket(both, width)


def _docwise(batches: Iterator[pa.RecordBatch]):
    """(doc_id, text, columns of the blobs of its bucket sorted by document, their range) for each document."""
    unzip = zstandard.ZstdDecompressor().decompress
    now, blobs, cols = None, [], None
    for batch in batches:
        for b, kind, blob, doc in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if b != now:
                now, blobs, cols = b, [], None
            if kind != 9:
                blobs.append(blob)
                continue
            if cols is None:
                parts = list(zip(*(unpack(x) for x in blobs)))
                cols = [np.concatenate(p) for p in parts] if parts else []
                if cols:
                    order = np.lexsort((cols[1], cols[0]))
                    cols = [c[order] for c in cols]
                blobs = []
            raw = unzip(blob)
            low = high = 0
            if cols and doc is not None and len(raw) >= SPAN:
                low, high = np.searchsorted(cols[0], [doc, doc + 1]) if doc < (1 << 63) - 1 else (np.searchsorted(cols[0], doc), len(cols[0]))
                if low < high:
                    sign = np.uint64(xxhash.xxh3_64_intdigest(raw))
                    part = cols[1][low:high]
                    low, high = low + np.searchsorted(part, sign), low + np.searchsorted(part, sign, "right")
            yield doc, raw, [c[low:high] for c in cols] if low < high else None


def _answer(batches: Iterator[pa.RecordBatch], n: int, m: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the units asked for, sent to the bucket of their mark; those of hot marks are split."""
    hold: list[list[list]] = [[[] for _ in range(6)] for _ in range(2)]
    size = [0, 0]

    def flush(hot):
        doc, sign, mark, start, runs, data = (np.concatenate(x) for x in hold[hot])
        hold[hot], size[hot] = [[] for _ in range(6)], 0
        if hot:
            return _batch(_split(doc, sign, mark, start, runs, data, n, m))
        first = _first(runs)
        rows = []
        for b, (d, g, k, s, r, f) in by_bucket(dealt(mixed(mark), n), doc, sign, mark, start, runs, first):
            at, _ = ranges(f, r.astype(np.int64) + SPAN - 1)
            rows.append((b, _BYTES, pack(d, g, k, s, r, data[at])))
        return _batch(rows)

    for doc, raw, asked in _docwise(batches):
        if asked is None:
            continue
        for hot in np.unique(asked[5]).tolist():
            ids, sign, mark, start, runs = (c[asked[5] == hot] for c in asked[:5])
            at, _ = ranges(start.astype(np.int64), runs.astype(np.int64) + SPAN - 1)
            for into, v in zip(hold[hot], (ids, sign, mark, start, runs, np.frombuffer(raw, np.uint8)[at])):
                into.append(v)
            size[hot] += len(at)
            if size[hot] >= (ANSWER, HOT_ANSWER)[hot]:
                yield flush(hot)
    for hot in (0, 1):
        if size[hot]:
            yield flush(hot)


def _first(runs: np.ndarray) -> np.ndarray:
    """Where the bytes of units of so many starts begin, one after the other."""
    length = runs.astype(np.int64) + SPAN - 1
    return np.cumsum(length) - length


def _split(doc, sign, mark, start, runs, data, n: int, m: int) -> list[tuple]:
    """Repeats among suffixes of hot marks here; the other suffixes one by one, equal ones to one bucket."""
    first = _first(runs)
    pos, owner = ranges(first, runs.astype(np.int64))
    gone = _repeated(doc, mark, pos, owner, data)
    rows = _told([_found(gone, doc, sign, start, first, pos, owner)], m)
    pos, owner = pos[~gone], owner[~gone]
    at = start[owner].astype(np.int64) + pos - first[owner]
    bucket = dealt(mixed(mark[owner] + mixed(PrefixHashes(data).part(pos, pos + SPAN))), n)
    for b, (d, g, k, s, p) in by_bucket(bucket, doc[owner], sign[owner], mark[owner], at.astype(np.uint32), pos):
        rows.append((b, _BYTES, pack(d, g, k, s, np.ones(len(d), np.uint8), data[p[:, None] + np.arange(SPAN)].ravel())))
    return rows


def common_extension(h: PrefixHashes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length up to ``SPAN`` over which the suffixes at ``a`` and ``b`` agree, by halving steps."""
    length = np.zeros(len(a), np.int64)
    sum_a, sum_b, back_a, back_b = h.sums[a], h.sums[b], h.back[a], h.back[b]
    step = 1 << (SPAN.bit_length() - 1)
    while step:
        # What agrees so far is taken along, so only the ends move.
        longer = np.minimum(length + step, SPAN)
        same = (h.sums[a + longer] - sum_a) * back_a == (h.sums[b + longer] - sum_b) * back_b
        length = np.where(same, longer, length)
        step >>= 1
    return length


def _less(h: PrefixHashes, data: np.ndarray, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
    length = common_extension(h, a, b)
    full = length == SPAN
    at = np.where(full, 0, length)
    return np.where(full, or_equal, data[a + at] < data[b + at])


def merge_sorted(h: PrefixHashes, data: np.ndarray, pos: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``pos`` inside each segment starting at ``heads``: a stable bottom-up
    mergesort, all segments and runs of a round at once. Each element finds its place in the
    neighbouring run by binary search. Elements that a merge brings next to equal ones are united
    with them and go no further, so many equal suffixes cost one round each, not all rounds."""
    n = len(pos)
    whole = h.part(pos, pos + SPAN)
    one = np.arange(n)  # the suffix, further to the left, that each one is united with
    element = np.arange(n)  # those that stand for themselves, run by run
    size = np.ones(n, np.int64)  # of the runs
    of = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, n]))  # their segments
    done, done_of = [], []
    while True:
        # Segments of one run are done.
        head = _groups(of)
        runs = np.diff(np.r_[head, len(of)])
        first = np.cumsum(size) - size
        alone = head[runs == 1]
        at, owner = ranges(first[alone], size[alone])
        done.append(element[at])
        done_of.append(of[alone][owner])
        if len(alone) == len(head):
            break
        left = np.repeat(runs > 1, runs)
        element, size, of, head, runs = element[np.repeat(left, size)], size[left], of[left], head[runs > 1], runs[runs > 1]
        inside = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
        first = np.cumsum(size) - size
        right = inside % 2 == 1
        mate = np.arange(len(of)) + np.where(right, -1, 1)
        has = right | (inside + 1 < np.repeat(runs, runs))
        mate[~has] = 0
        run = np.repeat(np.arange(len(of)), size)
        base, to_right = first[mate][run], right[run]
        low = np.zeros(len(element), np.int64)
        high = np.where(has, size[mate], 0)[run]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            theirs, mine = element[base[open_] + mid], element[open_]
            # Elements of the left run stay before equal ones of the right run.
            go = to_right[open_]
            k = np.flatnonzero(whole[theirs] != whole[mine])
            go[k] = _less(h, data, pos[theirs[k]], pos[mine[k]], False)
            low[open_[go]] = mid[go] + 1
            high[open_[~go]] = mid[~go]
            open_ = open_[low[open_] < high[open_]]
        merged = np.empty_like(element)
        merged[(first - np.where(right, size[mate], 0))[run] + np.arange(len(element)) - first[run] + low] = element
        # Pairs of runs are one now.
        pair = np.flatnonzero(~right)
        size, of = np.add.reduceat(size, pair), of[pair]
        run = np.repeat(np.arange(len(of)), size)
        equal = np.zeros(len(merged), bool)
        equal[1:] = (run[1:] == run[:-1]) & (whole[merged[1:]] == whole[merged[:-1]])
        gone = np.flatnonzero(equal)
        one[merged[gone]] = merged[gone - 1]
        element = merged[~equal]
        size = size - np.bincount(run[gone], minlength=len(size))
    while (one[one] != one).any():
        one = one[one]
    place = np.empty(n, np.int64)
    element = np.concatenate(done)
    place[element[np.argsort(np.concatenate(done_of), kind="stable")]] = np.arange(len(element))
    return np.argsort(place[one], kind="stable")


def _repeated(doc: np.ndarray, mark: np.ndarray, pos: np.ndarray, owner: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which suffixes, at ``pos`` in units ``owner``, are repeats of one with the same mark in a smaller document."""
    out = np.zeros(len(pos), bool)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    head = words[pos].byteswap()
    order = np.lexsort((head, mark[owner]))
    # A suffix that is alone with its mark and first bytes is no repeat.
    key_m, key_h = mark[owner][order], head[order]
    heads = _groups(key_m, key_h)
    sizes = np.diff(np.r_[heads, len(order)])
    keep = np.repeat(sizes > 1, sizes)
    order = order[keep]
    if not len(order):
        return out
    heads = _groups(key_m[keep], key_h[keep])
    pos, owner = pos[order], owner[order]
    for seed in range(64):
        h = PrefixHashes(data, seed)
        place = merge_sorted(h, data, pos, heads)
        p, o = pos[place], owner[place]
        inner = np.ones(len(p), bool)
        inner[heads] = False
        near = np.flatnonzero(inner)
        equal = h.part(p[near - 1], p[near - 1] + SPAN) == h.part(p[near], p[near] + SPAN)
        pairs = near[equal]
        true = np.ones(len(pairs), bool)
        for k in (*range(0, SPAN - 7, 8), SPAN - 8):
            true &= words[p[pairs - 1] + k] == words[p[pairs] + k]
        if true.all():
            break
    else:
        raise RuntimeError("hashes kept colliding")
    joined = np.zeros(len(p), bool)
    joined[pairs] = True
    group = np.flatnonzero(~joined)
    smallest = np.repeat(np.minimum.reduceat(doc[o], group), np.diff(np.r_[group, len(p)]))
    out[order[place[doc[o] > smallest]]] = True
    return out


def _found(gone, doc, sign, start, first, pos, owner) -> list[np.ndarray]:
    """The intervals of the suffixes that are ``gone``: document, its text's hash, start, end."""
    o, p = owner[gone], pos[gone]
    at = start[o].astype(np.int64) + p - first[o]
    # Neighbouring starts of one document become one interval.
    order = np.lexsort((at, sign[o], doc[o]))
    d, g, at = doc[o][order], sign[o][order], at[order]
    if not len(d):
        return [d, g, at, at]
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (at[1:] > at[:-1] + SPAN)])
    last = np.r_[cut[1:], len(d)] - 1
    return [d[cut], g[cut], at[cut], at[last] + SPAN]


def _told(found: list[list[np.ndarray]], n: int) -> list[tuple]:
    """Blobs of intervals by bucket of document."""
    return [(b, _REPEATS, blob) for b, blob in _intervals(*(np.concatenate(c) for c in zip(*found)), n)]


def _sorted_repeats(blobs: list[bytes], n: int) -> list[tuple]:
    """Repeats among the suffixes of one bucket."""
    *cols, data = (np.concatenate(p) for p in zip(*(unpack(x) for x in blobs)))
    found = []
    for doc, sign, mark, start, runs, at in _by_part(cols[2], *cols, _first(cols[4])):
        first = _first(runs)
        pos, owner = ranges(first, runs.astype(np.int64))
        here = data[ranges(at, runs.astype(np.int64) + SPAN - 1)[0]]
        found.append(_found(_repeated(doc, mark, pos, owner, here), doc, sign, start, first, pos, owner))
    return _told(found, n)


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    s, e = starts[order].astype(np.int64), np.maximum.accumulate(ends[order].astype(np.int64))
    cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return list(zip(s[cut].tolist(), e[np.r_[cut[1:], len(s)] - 1].tolist()))


def repeats(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Packed intervals to remove, by bucket of document; number of buckets; shuffle partitions."""
    docs = ids_and_texts(docs)
    width = cluster_width(docs.sparkSession)
    n = m = width
    sent = _by_bucket(_to_units(docs, n, m, secrets.randbits(63)), width)

    def meet(batches):
        # Repeats found inside a block come by the same exchange and pass through.
        units_, passed, repeats_, asked_ = [], [], [], []
        now, held = None, 0

        def close():
            nonlocal units_, held
            r, a = _meet(units_, HOT)
            repeats_.append(r)
            asked_.append(a)
            units_ = []
            held += len(r[0]) + len(a[0])

        for batch in batches:
            for b, kind, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if b != now:
                    if units_:
                        close()
                    if held >= GATHER:
                        yield _batch(_packed(repeats_, asked_, m))
                        repeats_, asked_, held = [], [], 0
                    now = b
                if kind == _REPEATS:
                    passed.append((b, kind, blob))
                    if len(passed) >= 64:
                        yield _batch(passed)
                        passed = []
                else:
                    units_.append(blob)
        if units_:
            close()
        yield _batch(passed + _packed(repeats_, asked_, m))

    met = settled(sent.mapInArrow(meet, _BLOBS), "suffix-met")
    asked = _with_docs(docs, met.filter(F.col("kind") == _ASKED), m, width).mapInArrow(lambda it: _answer(it, n, m), _BLOBS)
    suffixes = _by_bucket(asked, width).mapInArrow(lambda it: _bucketwise(it, lambda b, blobs: _sorted_repeats(blobs, m)), _BLOBS)
    return met.filter(F.col("kind") == _REPEATS).unionByName(settled(suffixes, "suffix-sorted")), m, width


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans, kept): byte ranges removed and the bytes left, for every row of ``docs``."""
    found, n, width = repeats(docs)

    def run(batches):
        rows = []
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind), pa.array([r[3] for r in rows], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

        size = 0
        for doc, raw, cols in _docwise(batches):
            gone = _merged(cols[2], cols[3]) if cols else []
            at, left = 0, []
            for s, e in gone:
                left.append(raw[at:s])
                at = e
            left.append(raw[at:])
            rows.append((doc, len(raw), [{"start": s, "end": e} for s, e in gone], b"".join(left)))
            size += len(raw)
            if size >= 8 << 20:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return _with_docs(ids_and_texts(docs), found, n, width).mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from :func:`spans`."""
    out = spans(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
