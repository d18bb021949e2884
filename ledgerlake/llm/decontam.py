"""Benchmark decontamination by a BM25 index of the test items with block-max pruning.

The index holds, per term, the BM25 weights of the items that have it, scaled so that 1 is the
item's own threshold: ``SHARE`` of the score that the item (or, of a long item, as much as a
passage holds) would give itself. Items are numbered in blocks of ``ITEMS``, and each term keeps
its largest weight and its largest weight in each block. Every passage of every training text
(windows of ``PASSAGE`` words, each overlapping the next by half) is a query, and every item
that reaches the threshold is retrieved, as in block-max WAND: passages whose largest weights
can't add up to 1 are skipped, then blocks whose block maxima can't, and only items of the
blocks left are scored. Bounds and scores are computed for many passages at a time.

A retrieved item is verified in the words around the passage: its question (all but the last
line or sentence) and its answer (the rest) must each overlap by ``OVERLAP`` of their word
n-grams (five words, fewer where a part is shorter).

The index of the items is sent to all workers; its size is checked by the items' bytes. A larger
benchmark is taken in as many parts, one after the other, against all documents. Item count, mean
length and the number of items with a term are those of the whole benchmark in every part.

Null and empty texts hold no passage; items without words are never found. Words are lower-cased,
parted at white space and stripped of marks at their ends. Repeated rows and items are treated
one by one. A null ``doc_id`` or ``item_id`` stays null. Clashing extra columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, pieces, settled
from .packed import ranges

PASSAGE = 128
ITEMS = 8
SHARE = 0.5
OVERLAP = 0.5
GRAM = 5
K1, B = 1.2, 0.75
#: Bytes of item texts of one index.
INDEX_BYTES = 16 << 20
PASS = 1 << 20
MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_/\\`~“”‘’«»…¿¡"


def words_of(text: str | None) -> list[str]:
    return [w for w in (x.strip(MARKS) for x in (text or "").lower().split()) if w]


def parts_of(text: str | None) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer; the answer of a one-sentence item is empty."""
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    if len(lines) < 2:
        whole = lines[0].strip() if lines else ""
        cut = max(whole.rstrip(".!? ").rfind(m) for m in (". ", "! ", "? "))
        lines = [whole[: cut + 1], whole[cut + 1 :]] if cut > 0 else [whole]
    return words_of("\n".join(lines[:-1] or lines)), words_of(lines[-1]) if len(lines) > 1 else []


def _grams(words: list[str], n: int) -> set[tuple]:
    return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else set()


def overlap(part: list[str], near: list[str]) -> float:
    """Share of the part's distinct n-grams that occur nearby; 1 for an empty part."""
    if not part:
        return 1.0
    n = min(GRAM, len(part))
    own = _grams(part, n)
    return len(own & _grams(near, n)) / len(own)


class Index:
    """Terms, block maxima and postings as flat arrays. ``whole``: items with words, their words and the
    number of items with each term, where ``items`` is a part of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]], whole: tuple[int, int, dict[str, int]] | None = None):
        rows = [(i, t, words_of(t)) for i, t in items]
        self.items = [(i, *parts_of(t), len(w)) for i, t, w in rows if w]
        counts = [Counter(w) for _, _, w in rows if w]
        n = len(counts)
        all_n, all_words, df = whole or (n, sum(x[3] for x in self.items), Counter(t for c in counts for t in c))
        mean = all_words / max(1, all_n)
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        post: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for item, c in enumerate(counts):
            size = self.items[item][3]
            w = {t: math.log(1 + (all_n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in c.items()}
            own = SHARE * math.fsum(w.values()) * min(1.0, (PASSAGE // 2) / size)
            for t in sorted(w):
                post[self.terms[t]].append((item, w[t] / own))
        v = len(post)
        self.largest = np.array([max(x for _, x in p) for p in post]) if v else np.empty(0)
        entries = [(t, item, x) for t, p in enumerate(post) for item, x in p]
        self.item = np.array([e[1] for e in entries], np.int64)
        self.weight = np.array([e[2] for e in entries])
        term = np.array([e[0] for e in entries], np.int64)
        block = self.item // ITEMS
        head = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.empty(0, np.int64)
        self.block = block[head]
        self.block_max = np.maximum.reduceat(self.weight, head) if len(head) else np.empty(0)
        self.post_at, self.post_n = head, np.diff(np.r_[head, len(term)])
        per = np.bincount(term[head], minlength=v)
        self.term_at, self.term_n = np.cumsum(per) - per, per
        self.blocks = -(-n // ITEMS)

    def retrieve(self, query: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) of all scores of 1 or more. ``query`` and ``term`` are distinct pairs, sorted."""
        none = np.empty(0, np.int64)
        if not len(query):
            return none, none, np.empty(0)
        top = np.bincount(query, self.largest[term])
        use = top[query] >= 1 - 1e-9
        query, term = query[use], term[use]
        if not len(query):
            return none, none, np.empty(0)
        entry, owner = ranges(self.term_at[term], self.term_n[term])
        pair = query[owner] * self.blocks + self.block[entry]
        known, where = np.unique(pair, return_inverse=True)
        use = np.bincount(where, self.block_max[entry])[where] >= 1 - 1e-9
        entry, pair = entry[use], pair[use]
        if not len(entry):
            return none, none, np.empty(0)
        at, owner = ranges(self.post_at[entry], self.post_n[entry])
        n = self.blocks * ITEMS
        key = pair[owner] // self.blocks * n + self.item[at]
        known, where = np.unique(key, return_inverse=True)
        score = np.bincount(where, self.weight[at])
        hit = score >= 1 - 1e-9
        return known[hit] // n, known[hit] % n, score[hit]

    def leaks(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its verified (item_id, score, question overlap, answer overlap, passages)."""
        step = PASSAGE // 2
        get, queries, terms, first, split = self.terms.get, [], [], [0], []
        for t in texts:
            w = words_of(t)
            ids = np.array([get(x, -1) for x in w], np.int64)
            at = np.flatnonzero(ids >= 0)
            n = max(1, -(-(len(w) - step) // step))
            k = at // step
            for shift in (0, 1):  # a word is in the window that starts in its half, and in the one before
                q = k - shift
                ok = (q >= 0) & (q < n)
                queries.append(q[ok] + first[-1])
                terms.append(ids[at[ok]])
            first.append(first[-1] + n)
            split.append(w)
        out: list[list[tuple]] = [[] for _ in texts]
        v = max(1, len(self.terms))
        pairs = np.unique(np.concatenate(queries) * v + np.concatenate(terms)) if queries else np.empty(0, np.int64)
        q, item, score = self.retrieve(pairs // v, pairs % v)
        owner = np.searchsorted(first, q, "right") - 1
        best: dict[tuple[int, int], tuple] = {}
        for o, k, i, s in zip(owner.tolist(), q.tolist(), item.tolist(), score.tolist()):
            item_id, question, answer, size = self.items[i]
            at = (k - first[o]) * step
            near = split[o][max(0, at - size) : at + PASSAGE + size]
            found = (overlap(question, near), overlap(answer, near))
            if min(found) >= OVERLAP:
                old = best.get((o, i))
                best[(o, i)] = (item_id, max(s, old[1]), max(found[0], old[2]), max(found[1], old[3]), old[4] + 1) if old else (item_id, s, *found, 1)
        for (o, _), row in sorted(best.items()):
            out[o].append(row)
        return out


def _counts(items: DataFrame) -> DataFrame:
    """(word, n, size): items with each word; in the row without a word, items with any and all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found: Counter = Counter()
            n = size = 0
            for text in batch.column(0).to_pylist():
                w = words_of(text)
                found.update(set(w))
                n, size = n + (len(w) > 0), size + len(w)
            yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.string()), pa.array([n, *found.values()], pa.int64()), pa.array([size, *[0] * len(found)], pa.int64())], names=["word", "n", "size"])

    return items.select("text").mapInArrow(run, "word string, n long, size long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def indexes(benchmark: DataFrame) -> Iterator:
    """Broadcast indexes over all items, each of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = -(-size // INDEX_BYTES)
    if n > 1:
        counted = settled(_counts(items), "benchmark-words")
        total = counted.filter("word is null").first()
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        whole = None
        if n > 1:  # only the part's own words come to the driver
            own = _counts(part).filter("word is not null").select("word").join(counted.select("word", "n"), "word").collect()
            whole = (total.n, total.size, {r.word: r.n for r in own})
        yield benchmark.sparkSession.sparkContext.broadcast(Index(rows, whole))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        step = max(1, int(batch.num_rows * PASS / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, n_passages) of each leak."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_passages long"
    out = docs.sparkSession.createDataFrame([], schema)
    for held in indexes(benchmark):

        def run(batches, held=held):
            for batch in _batches(batches):
                rows = [(d, *x) for d, xs in zip(batch.column(0).to_pylist(), held.value.leaks(batch.column(1).to_pylist())) for x in xs]
                cols = list(zip(*rows)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in schema.split(", ")])

        out = out.unionByName(ids_and_texts(docs).mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns."""
    for held in indexes(benchmark):

        def run(batches, held=held):
            for batch in _batches(batches):
                found = held.value.leaks(batch.column(batch.schema.get_field_index("text")).to_pylist())
                yield batch.filter(pa.array([not x for x in found]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
