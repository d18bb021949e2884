"""Language-model scores of documents: a causal self-attention model in numpy on subword ids.

Documents whose ``crc32(doc_id as text) mod 10`` is not 0 are learned from; all are scored.

1. Every text is split and encoded once; texts and ids are kept in the shared folder. Words of all
   training documents are counted in the same pass (per block first, then by word); they give the
   base score. All their ids are counted too.
2. Ids are put in classes of equal mass: ``P(id | context) = P(class | context) * P(id | class)``;
   the second part is exact. All ids have input vectors: the most frequent ones their own, the
   others share ``HASHED`` by number.
3. The attention model for ``P(class | context)`` is trained on the ids of all training documents,
   cut into windows of ``T``; the first id of a window sees the true id before it. Ids are dealt
   out in shards by a hash of the document, the number of shards by the number of ids. Each shard
   is trained from the same first weights, in a fixed order of documents; the weights are averaged
   by windows in the order of shards. The model does not depend on how rows were dealt out.
4. All texts are scored in overlapping windows of ``T`` ids: batched masked attention over many
   windows at once; each id counts once, in the window where it has at least ``OVERLAP`` ids of
   context (or all there are).

What the model knows of a context comes through attention alone: it has no path around it and no
table of pairs. Each window position attends to the inputs up to its own, by content and distance.

Base: counts of the most frequent words, ``TOP`` at most and of ``TOP_BYTES`` bytes at most, go to
all workers. Other words travel by hash (64 bits) to where their counts are, and sums come back by
row.

Null and empty texts are one end token. A null ``doc_id`` counts as a training document. Repeated
rows are counted and scored one by one. Very long texts are scored in pieces of windows. Without
training tokens the counts are 0 and the classes uniform. Other columns are not read.
"""

from __future__ import annotations

import math
import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cluster_width, ids_and_texts, pieces, settled
from .packed import by_bucket, dealt, keyed, pack, unpack
from .tokens import END_ID, SPLIT_BYTES, encoder, split_words, summed

T, OVERLAP = 32, 4
WIDTH, KEYS = 16, 8  # of values, and of queries and keys
CLASSES = 48
#: Input vectors: the most frequent ids have their own, all others share the hashed ones; then the start.
OWN, HASHED = 2048, 2048
START = OWN + HASHED
BATCH, RATE = 128, 0.05
#: Ids of one shard, about.
SHARD = 4_000_000
#: Tasks that shards are dealt out to at most, on a cluster that does not ask for more.
MOST_TASKS = 4096
TOP, TOP_BYTES = 250_000, 64
SMOOTH = 0.1
SPREAD = 4
BLOCK = 32 << 20
PASS = 256 << 10
TURN = 4096  # windows of a long text that are held at once
FAN = 64  # rows that one sum takes in
HELD = 1_000_000  # words of a bucket that wait to be summed


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hash(words: pa.Array, key: int) -> np.ndarray:
    """64 bits of each word, with a key that is drawn for each run."""
    words = words.cast(pa.large_binary())
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1] if at else np.zeros(len(words) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return keyed(data, at[:-1], at[1:], key)[0]


# ---- counts


def _word_rows(words: pa.Array, count: np.ndarray, n: int, key: int) -> list[tuple]:
    """(bucket, words one after the other, packed sizes and counts) of distinct words."""
    bucket = dealt(_hash(words, key), n)
    order = np.argsort(bucket, kind="stable")
    words, count, bucket = words.cast(pa.large_binary()).take(pa.array(order)), count[order], bucket[order]
    data = words.buffers()[2]
    end = np.cumsum(size := np.asarray(pc.binary_length(words)))
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist() if len(bucket) else [0]
    return [(int(bucket[a]), data.slice(int(end[a] - size[a]), int(end[b - 1] - end[a] + size[a])).to_pybytes(), pack(size[a:b].astype(np.uint32), count[a:b].astype(np.uint32))) for a, b in zip(cuts, cuts[1:])]


def count_words(rows: DataFrame, width: int) -> DataFrame:
    """Settled rows (bucket, word, c) of each training word. ``rows``: from :func:`encoded`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, counts, held = None, [], [], 0

        def merge():
            nonlocal words, counts, held
            found, count = summed(pa.concat_arrays(words), np.concatenate(counts))
            words, counts, held = [found], [count], 0

        def flush():
            merge()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words[0]), now), pa.int32()), words[0].cast(pa.binary()), pa.array(counts[0], pa.int64())], names=["bucket", "word", "c"])

        for batch in batches:
            for bucket, data, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bucket != now:
                    if words:
                        yield flush()
                    now, words, counts, held = bucket, [], [], 0
                size, c = unpack(blob)
                at = np.r_[0, np.cumsum(size, dtype=np.int64)]
                words.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)]))
                counts.append(c.astype(np.int64))
                held += len(c)
                if held > HELD:
                    merge()
        if words:
            yield flush()

    sent = rows.filter("bucket >= 0").select("bucket", "words", "counts").repartition(width, "bucket").sortWithinPartitions("bucket")
    return settled(sent.mapInArrow(run, "bucket int, word binary, c long"), "lm-words")


# ---- ids


def encoded(docs: DataFrame, vocabulary: str | None, n: int = 1, key: int = 0) -> DataFrame:
    """Settled rows (doc_id, text, held, n, ids) of all documents: each text with its ids, the end id last; and rows
    (bucket, words, counts) of the words of training documents, per ``BLOCK`` of texts, dealt to ``n`` buckets, and,
    in a bucket below 0 for each partition, how often each id occurs in them."""
    kind = "doc_id long, text string, held boolean, n long, ids binary, bucket int, words binary, counts binary"
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_all
        vocab = encoder(vocabulary).vocab_size
        wide, total = vocab > 1 << 16, np.zeros(vocab + 1, np.int64)
        found: list[pa.Array] = []
        counts: list[np.ndarray] = []
        size = 0

        def others(rows):
            none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary())))], names=names)

        for batch in pieces(batches, most=SPLIT_BYTES):
            held = np.array([held_out(d) for d in batch.column(0).to_pylist()], bool)
            ids, at, words, count = encode(batch.column(1), ~held)
            total += np.bincount(ids[np.repeat(~held, np.diff(at))], minlength=vocab + 1)
            found.append(words)
            counts.append(count)
            size += batch.column(1).nbytes
            ids = ids if wide else ids.astype("<u2")
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(held), [None, pa.py_buffer((at * ids.itemsize).tobytes()), pa.py_buffer(ids)]).cast(pa.binary())
            none = [pa.nulls(len(held), t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held), pa.array(np.diff(at)), raw, *none], names=names)
            if size >= BLOCK:
                yield others(_word_rows(*summed(pa.concat_arrays(found), np.concatenate(counts)), n, key))
                found, counts, size = [], [], 0
        if found:
            yield others(_word_rows(*summed(pa.concat_arrays(found), np.concatenate(counts)), n, key))
        if total.any():
            yield others([(-1 - TaskContext.get().partitionId(), None, pack(total))])

    return settled(docs.mapInArrow(run, kind), "lm-ids")


def _ids(raw: list[bytes], vocab: int) -> list[np.ndarray]:
    kind = "<u4" if vocab > 1 << 16 else "<u2"
    return [np.frombuffer(r, kind) for r in raw]


def sums(rows: DataFrame, name: str) -> list[np.ndarray] | None:
    """Sums of packed arrays over all rows (k, blob), ``FAN`` rows at a time in the order of ``k``; None without rows."""

    def add(batches):
        now, total = None, None
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k // FAN != now:
                    if total is not None:
                        yield row(now, total)
                    now, total = k // FAN, None
                v = unpack(blob)
                total = v if total is None else [x + y for x, y in zip(total, v)]
        if total is not None:
            yield row(now, total)

    def row(k, total):
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pack(*total)], pa.binary())], names=["k", "blob"])

    rows, kind = settled(rows, name), "k long, blob binary"
    while (n := rows.count()) > FAN:
        width = min(cluster_width(rows.sparkSession), -(-n // FAN))
        dealt_ = rows.repartition(width, F.floor(F.col("k") / FAN)).sortWithinPartitions("k")
        rows = settled(dealt_.mapInArrow(add, kind), name)
    total = None
    for r in sorted(rows.collect(), key=lambda r: r.k):  # FAN rows at most
        v = unpack(bytes(r.blob))
        total = v if total is None else [x + y for x, y in zip(total, v)]
    return total


def count_ids(rows: DataFrame, vocab: int) -> np.ndarray:
    """How often each id occurs in training documents. ``rows``: from :func:`encoded`."""
    found = sums(rows.filter("bucket < 0").select((-1 - F.col("bucket")).cast("long").alias("k"), F.col("counts").alias("blob")), "lm-id-counts")
    return np.zeros(vocab + 1, np.int64) if found is None else found[0]


class Classes:
    """Class, input number and log10 P(id | class) of every id, from the counts of ids."""

    def __init__(self, counts: np.ndarray):
        rank = np.lexsort((np.arange(len(counts)), -counts))
        mass = np.cumsum(counts[rank] + SMOOTH)
        self.cls = np.empty(len(counts), np.int64)
        self.cls[rank] = np.minimum(CLASSES - 1, (mass - (counts[rank] + SMOOTH) / 2) * CLASSES // mass[-1]).astype(np.int64)
        self.input = (OWN + np.arange(len(counts)) % HASHED).astype(np.uint16)
        self.input[rank[:OWN]] = np.arange(min(OWN, len(rank)))
        in_class = np.bincount(self.cls, counts + SMOOTH, CLASSES)
        self.inside = np.log10((counts + SMOOTH) / in_class[self.cls])
        self.prior = np.log(np.maximum(in_class, 1e-9) / in_class.sum()).astype(np.float32)


# ---- model


_DISTANCE = np.arange(T)[:, None] - np.arange(T)
_HIDDEN = np.where(_DISTANCE >= 0, 0, -np.inf).astype(np.float32)
#: Scores are kept within these bounds, so that their exponentials stay finite.
_BOUND = np.float32(40)
_SCALE = np.float32(1 / math.sqrt(KEYS))


def first_weights() -> dict[str, np.ndarray]:
    """``embed``: input vectors; ``qkv``: to queries, keys and values; ``near``: by distance; ``out``: to classes."""
    rng = np.random.default_rng(7)
    shapes = {"embed": ((START + 1, WIDTH), 0.5), "qkv": ((WIDTH, 2 * KEYS + WIDTH), 0.25), "near": ((T,), 0.0), "out": ((WIDTH, CLASSES), 0.05)}
    out = {k: (rng.standard_normal(s) * scale).astype(np.float32) for k, (s, scale) in shapes.items()}
    out["near"] -= np.minimum(np.arange(T, dtype=np.float32), 8) / 2  # near inputs weigh more from the start
    return out


def attend(w: dict, x: np.ndarray, made: np.ndarray | None = None) -> tuple:
    """What each place of windows of input numbers attends to: vectors, scaled queries, keys, values, weights, what to
    multiply them by so that they sum to one, and the mean of the values by them. ``made``: queries, keys and values
    of all input numbers, where they stay the same."""
    n, t = x.shape
    e = w["embed"].take(x.ravel(), axis=0) if made is None else None
    z = (e @ w["qkv"] if made is None else made.take(x.ravel(), axis=0)).reshape(n, t, -1)
    q, k, v = z[:, :, :KEYS], z[:, :, KEYS : 2 * KEYS], z[:, :, 2 * KEYS :]
    q = q * _SCALE
    a = q @ k.transpose(0, 2, 1)
    np.clip(a, -_BOUND, _BOUND, out=a)
    a += np.clip(w["near"], -_BOUND, _BOUND)[np.maximum(_DISTANCE[:t, :t], 0)] + _HIDDEN[:t, :t]
    np.exp(a, out=a)
    part = 1 / (a @ np.ones(t, np.float32))[:, :, None]
    h = a @ v
    h *= part
    return e, q, k, v, a, part, h


def class_odds(w: dict, prior: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unscaled probabilities of the classes after each of the vectors ``h``, and what to divide them by."""
    wide = np.ones((len(h), h.shape[1] + 1), h.dtype)  # the last column brings in the prior
    wide[:, :-1] = h
    g = wide @ np.vstack([w["out"], prior[None].astype(w["out"].dtype)])
    np.clip(g, -_BOUND, _BOUND, out=g)
    np.exp(g, out=g)
    return g, g @ np.ones(CLASSES, np.float32)


def _sums(to: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers ``to`` and the sums of ``rows`` by them."""
    order = np.argsort(to, kind="stable")
    to = to.take(order)
    new = np.empty(len(to), bool)
    new[0] = True
    np.not_equal(to[1:], to[:-1], out=new[1:])
    first = np.flatnonzero(new)
    # Two numbers at a time, which add up as one complex number.
    pairs = rows.take(order, axis=0).view(np.result_type(rows.dtype, np.complex64))
    return to[first], np.add.reduceat(pairs, first).view(rows.dtype)


def gradients(w: dict, prior: np.ndarray, x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean log loss by weight; those of input vectors only for the numbers returned beside them."""
    n, t = x.shape
    e, q, k, v, a, part, h = attend(w, x)
    flat = lambda z: z.reshape(-1, z.shape[-1])
    g, total = class_odds(w, prior, flat(h))
    used = keep.ravel().astype(np.float32) / np.float32(max(1, keep.sum()))
    g *= (used / total)[:, None]
    g.reshape(-1)[np.arange(0, g.size, CLASSES) + y.ravel()] -= used
    grad = {"out": flat(h).T @ g}
    dh = (g @ w["out"].T).reshape(n, t, WIDTH)
    dh *= part
    da = dh @ v.transpose(0, 2, 1)
    da -= np.einsum("bij,bij->bi", dh, h)[:, :, None]
    da *= a
    near = da.sum(axis=0)
    grad["near"] = np.bincount(np.maximum(_DISTANCE[:t, :t], 0).ravel(), (near * (_DISTANCE[:t, :t] >= 0)).ravel(), T).astype(np.float32)
    dz = np.empty((n, t, 2 * KEYS + WIDTH), e.dtype)
    np.matmul(da, k * _SCALE, out=dz[:, :, :KEYS])
    np.matmul(da.transpose(0, 2, 1), q, out=dz[:, :, KEYS : 2 * KEYS])
    np.matmul(a.transpose(0, 2, 1), dh, out=dz[:, :, 2 * KEYS :])
    grad["qkv"] = e.T @ flat(dz)
    to, grad["embed"] = _sums(x.ravel(), flat(dz) @ w["qkv"].T)
    return grad, to


def train(w: dict, prior: np.ndarray, x: np.ndarray, y: np.ndarray, keep: np.ndarray, seen: dict | None = None) -> tuple[dict, dict]:
    """Weights after one pass over windows with adaptive steps, and the state of the steps to go on from.
    ``x``: input numbers, ``y``: classes that follow, ``keep``: which places count."""
    w = {k: v.copy() for k, v in w.items()} if seen is None else w
    seen = {k: np.full_like(v, 1e-8) for k, v in w.items()} if seen is None else seen
    for at in range(0, len(x), BATCH):
        grad, to = gradients(w, prior, x[at : at + BATCH], y[at : at + BATCH], keep[at : at + BATCH])
        for name, d in grad.items():
            rows = to if name == "embed" else slice(None)
            total = seen[name][rows] + d * d
            seen[name][rows] = total
            w[name][rows] -= np.float32(RATE) * d / np.sqrt(total)
    return w, seen


def windows_of(lengths: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first place, places that don't count) of the windows over sequences of these lengths."""
    n = 1 + np.maximum(0, -(-(lengths - T) // (T - overlap)))
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    return doc, k * (T - overlap), np.where(k > 0, overlap, 0)


def grid(ids: list[np.ndarray], c: Classes, overlap: int = OVERLAP):
    """Windows over documents: input numbers, ids to predict, which places count, document."""
    lengths = np.array([len(i) for i in ids])
    flat = np.concatenate(ids).astype(np.int64)
    first = np.cumsum(lengths) - lengths
    doc, start, skip = windows_of(lengths, overlap)
    place = start[:, None] + np.arange(T)
    inside = place < lengths[doc][:, None]
    at = np.minimum(first[doc][:, None] + place, len(flat) - 1)
    shown = np.empty(len(flat), c.input.dtype)
    shown[1:] = c.input.take(flat[:-1])
    shown[first] = START
    return shown.take(at), flat.take(at), inside & (np.arange(T) >= skip[:, None]), doc


def score(w: dict, c: Classes, ids: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence of ids."""
    out = np.zeros(len(ids))
    if not ids:
        return out
    # A very long sequence is scored in parts of whole windows.
    turn = (T - OVERLAP) * TURN
    if max(map(len, ids)) > turn + OVERLAP:
        for k, i in enumerate(ids):
            out[k] = sum(_score(w, c, [i[at : at + turn + OVERLAP]], i[at - 1] if at else None)[0] for at in range(0, max(1, len(i) - OVERLAP), turn))
        return out
    return _score(w, c, ids)


def _score(w: dict, c: Classes, ids: list[np.ndarray], before: int | None = None) -> np.ndarray:
    """The same; a part that goes on after the id ``before`` starts with ``OVERLAP`` ids that don't count."""
    x, y, keep, doc = grid(ids, c)
    if before is not None:
        x[0, 0] = c.input[before]
        keep[0, :OVERLAP] = False
    made = w["embed"] @ w["qkv"]
    step = 128
    pick = np.flatnonzero(keep)
    now = y.reshape(-1).take(pick)
    cls, own = c.cls.take(now), np.empty(len(pick))
    cuts = np.searchsorted(pick, np.arange(0, len(x) + step, step) * T).tolist()
    for at, i, j in zip(range(0, len(x), step), cuts, cuts[1:]):
        h = attend(w, x[at : at + step], made)[-1].reshape(-1, WIDTH)
        g, total = class_odds(w, c.prior, h.take(pick[i:j] - at * T, axis=0))
        own[i:j] = g.reshape(-1).take(np.arange(0, g.size, CLASSES) + cls[i:j]) / total
    return np.bincount(doc.take(pick // T), np.log10(own) + c.inside.take(now), len(ids))


def fit(rows: DataFrame, classes, vocab: int, n_ids: int) -> dict:
    """Weights averaged over all shards of training documents. ``rows``: from :func:`encoded`."""
    shards = max(1, -(-n_ids // SHARD))
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # the worker may have encoded before; here it only trains
        c = classes.value
        now, state, n = None, None, 0
        hold: list[np.ndarray] = []
        size = 0

        def learn():
            nonlocal state, n, hold, size
            x, y, keep, _ = grid(hold, c, 0)
            state = train(*(state[:1] if state else [first_weights()]), c.prior, x, c.cls.take(y), keep, state[1] if state else None)
            n, hold, size = n + len(x), [], 0

        def done():
            if hold:
                learn()
            w = state[0]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([pack(np.array([n], np.float64), *(w[k].ravel().astype(np.float64) * n for k in sorted(w)))], pa.binary())], names=["k", "blob"])

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), _ids(batch.column(1).to_pylist(), vocab)):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, state, n = shard, None, 0
                for at in range(0, len(ids), T * TURN):  # a very long text is learned from in several turns
                    hold.append(ids[at : at + T * TURN])
                    size += len(hold[-1])
                    if size >= T * TURN:
                        learn()
        if now is not None:
            yield done()

    shard = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards))
    dealt_ = rows.filter("not held").select(shard.alias("shard"), "doc_id", "ids")
    # A task for each shard, or for every so many of very many: each number has its own partition.
    tasks = min(shards, max(4 * cluster_width(spark), MOST_TASKS))
    ordered = dealt_.repartitionById(tasks, F.pmod(F.col("shard"), F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "doc_id", "ids").select("shard", "ids")
    total = sums(ordered.mapInArrow(run, "k long, blob binary"), "lm-weights")
    w = first_weights()
    if total is not None:
        w = {k: (v / total[0][0]).astype(np.float32).reshape(w[k].shape) for k, v in zip(sorted(w), total[1:])}
    return w


# ---- scores of all documents


def _frequent(words: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Counts of the most frequent words, ``TOP`` at most: all words from some eighth of an octave of counts on,
    but those of more than ``TOP_BYTES`` bytes."""
    words = words.filter(F.octet_length("word") <= TOP_BYTES)
    step = F.floor(8 * F.log2("c")).cast("int")
    sizes = {r.step: r.n for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a few hundred
    least, total = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > TOP:
            break
        least = k
    found = words.filter(step >= least).select("word", "c").collect()
    return pa.array([bytes(r.word) for r in found], pa.large_binary()), np.array([r.c for r in found], np.int64)


def score_all(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    docs = ids_and_texts(docs)
    spark = docs.sparkSession
    width = cluster_width(spark)
    n = SPREAD * width
    vocab = encoder(vocabulary).vocab_size
    key = secrets.randbits(64)
    rows = encoded(docs, vocabulary, n, key)
    words = count_words(rows, width)
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train = rows.filter("not held").count()
    all_tokens, distinct = totals.n + n_train, totals.v + (n_train > 0)
    id_counts = count_ids(rows, vocab)
    classes = spark.sparkContext.broadcast(Classes(id_counts))
    weights = spark.sparkContext.broadcast(fit(rows, classes, vocab, int(id_counts.sum())))
    top = spark.sparkContext.broadcast(_frequent(words))
    shift = math.log10(all_tokens + SMOOTH * (distinct + 1)) if all_tokens else math.log10(SMOOTH)

    kind = "key long, doc_id long, held_out boolean, n_tokens long, known long, part double, score double, bucket int, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()
        (frequent, counts), c, w = top.value, classes.value, weights.value
        logs, place = np.log10(counts + SMOOTH), TaskContext.get().partitionId() << 40
        ended = math.log10(n_train + SMOOTH) - shift
        rare_h: list[np.ndarray] = []
        rare_k: list[np.ndarray] = []

        def flush():
            h, k = np.concatenate(rare_h), np.concatenate(rare_k)
            cols = by_bucket(dealt(h, n), h, k)
            rows = [(b, pack(h, k)) for b, (h, k) in cols]
            none = {t: pa.nulls(len(rows), t) for t in (pa.int64(), pa.bool_(), pa.float64())}
            i, d = none[pa.int64()], none[pa.float64()]
            return pa.RecordBatch.from_arrays([i, i, none[pa.bool_()], i, i, d, d, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=[x.split()[0] for x in kind.split(", ")])

        for big in pieces(batches, most=SPLIT_BYTES):
            step = max(1, int(big.num_rows * PASS / max(1, big.nbytes)))
            scores = np.concatenate([score(w, c, _ids(big.column(2).slice(at, step).to_pylist(), vocab)) for at in range(0, big.num_rows, step)])
            words, bounds = split_words(big.column(1))
            words, sizes = words.cast(pa.large_binary()), np.diff(bounds)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            found = pc.index_in(words, value_set=frequent)
            rare = np.flatnonzero(np.asarray(found.is_null()))
            rare_h.append(_hash(words.take(pa.array(rare)), key))
            rare_k.append(place + owner[rare])
            missing = np.bincount(owner[rare], minlength=len(sizes))
            log = np.r_[logs, 0.0][np.asarray(found.fill_null(len(logs)))]
            part = np.bincount(owner, log, len(sizes)) - shift * sizes + ended
            held = [held_out(d) for d in big.column(0).to_pylist()]
            cols = (np.arange(place, place + len(sizes)), big.column(0), held, sizes + 1, sizes - missing + (n_train > 0), part, scores)
            place += len(sizes)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            none = (pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary()))
            yield pa.RecordBatch.from_arrays([*(v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(cols, kinds)), *none], names=[x.split()[0] for x in kind.split(", ")])
            if sum(map(len, rare_h)) >= 1_000_000:
                yield flush()
                rare_h.clear()
                rare_k.clear()
        if rare_h:
            yield flush()

    done = settled(rows.filter("bucket is null").select("doc_id", "text", "ids").mapInArrow(run, kind), "lm-rows")

    def table_blobs(batches):
        """Counts by hash of word, packed per bucket."""
        for batch in batches:
            h = _hash(batch.column(1), key)
            c = np.asarray(batch.column(2)).astype(np.int64)
            rows = [(b, 0, pack(hh, cc)) for b, (hh, cc) in by_bucket(dealt(h, n), h, c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])

    def look_up(batches):
        now, known, held = None, [], None
        for batch in batches:
            keys, parts, hits = [], [], []
            for bucket, what, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bucket != now:
                    now, known, held = bucket, [], None
                if what == 0:
                    known.append(blob)
                    continue
                if held is None:
                    cols = list(zip(*(unpack(b) for b in known))) or [[np.empty(0, np.uint64)], [np.empty(0, np.int64)]]
                    h, c = (np.concatenate(v) for v in cols)
                    order = np.argsort(h)
                    held, known = (h[order], c[order]), []
                h, key = unpack(blob)
                if len(held[0]):
                    at = np.minimum(np.searchsorted(held[0], h), len(held[0]) - 1)
                    c = np.where(held[0][at] == h, held[1][at], 0)
                else:
                    c = np.zeros(len(h), np.int64)
                one, where = np.unique(key, return_inverse=True)
                keys.append(one)
                parts.append(np.bincount(where, np.log10(c + SMOOTH)))
                hits.append(np.bincount(where, c > 0).astype(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(parts)), pa.array(np.concatenate(hits))], names=["rare_key", "rare", "rare_known"])

    both = words.mapInArrow(table_blobs, "bucket int, kind int, blob binary").unionByName(done.filter("bucket is not null").select("bucket", F.lit(1).alias("kind"), "blob"))
    rare = both.repartition(width, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(look_up, "rare_key long, rare double, rare_known long")
    rare = rare.groupBy("rare_key").agg(F.sum("rare").alias("rare"), F.sum("rare_known").alias("rare_known"))
    out = done.filter("bucket is null").join(rare, F.col("key") == F.col("rare_key"), "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rare", F.lit(0.0))).alias("base_score"),
        "score",
    )
