"""N-gram Jaccard join by vertical partitioning.

The n-gram sets of all documents are put in one global order. For candidates, n-grams that a
fixed-size table of counts calls rare come first, and only the prefix of each set that a similar
set must meet is sent, cut into buckets. For counting, the order of n-gram hashes is cut into
``FRAGMENTS``: each set falls into segments, the overlap of a pair is counted in each fragment
by itself, and the partial counts are summed per pair and held against the threshold.

Words are hashed with a key drawn for each run. Equal sets are one node (a 64-bit hash of the set; a
second one beside it, over second hashes of the words, tells whether two sets share a node by chance,
and then all is done again with another key), so copies cost one row each. Links matter
here up to connection: in a small group that shares a prefix n-gram all pairs that pass the size
and position bounds are counted; in a large one, members are first compared with a few pivots of
the group's largest component, then with four times as many of its sets in each round, and only at
last are all pairs counted that no link joins yet. No pair that could join two components is left out.

The order only steers how much is compared; any table of counts gives the same links.

Nulls: null and word-less texts have no set and are linked with nothing; their component is
their own ``doc_id``. Rows with a null ``doc_id`` are counted but not linked, with a null
component. Repeated rows are copies. Other columns are not read.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cluster_width, ids_and_texts, pieces, settled
from .components import components
from .packed import by_bucket, dealt, keyed, mixed, pack, ranges, unpack

#: Slots of the table of counts (its levels, a byte each, go to every worker), and parts it is summed in.
SLOTS, PARTS = 1 << 22, 64
#: Least and most bits of the table of documents to take up again; eight for each of them in between.
BITS = (1 << 25, 1 << 30)
FRAGMENTS = 4
#: Groups of so many members are compared in full; larger ones by pivots first.
SMALL = 64
PIVOTS = (4, 12)
SPREAD = 4
PASS = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_FOLD, _OTHER = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def sets(texts: list[str | None], words: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram hash, second hash of it), sorted and distinct, of all texts; one hash for texts of fewer words."""
    data = np.frombuffer((" ".join(t or "" for t in texts) + " ").encode("utf-8", "surrogatepass").lower(), np.uint8)
    sizes = np.array([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    text = np.searchsorted(np.cumsum(sizes), start, "right")
    both = keyed(data, start, end, key)
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    here = np.flatnonzero(np.r_[text[words - 1 :] == text[: len(text) - words + 1], np.zeros(min(words - 1, len(text)), bool)]) if len(text) >= words else np.empty(0, int)
    short = np.flatnonzero((n > 0) & (n < words))
    hashes = []
    for w, fold in zip(both, (_FOLD, _OTHER)):
        h = np.zeros(len(here), np.uint64)
        for k in range(words):
            h = mixed(h * fold + w[here + k])
        g = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            more = n[short] > k
            g[more] = mixed(g[more] * fold + w[first[short[more]] + k])
        hashes.append(np.r_[h, g + np.uint64(1)])
    t, (h, second) = np.r_[text[here], short], hashes
    order = np.lexsort((h, t))
    t, h, second = t[order], h[order], second[order]
    keep = np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])]
    return t[keep], h[keep], second[keep]


def _passes(batches: Iterator[pa.RecordBatch]):
    """(ids, texts) of about ``PASS`` characters."""
    ids, texts, size = [], [], 0
    for batch in pieces(batches):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= PASS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _slot(h: np.ndarray) -> np.ndarray:
    return (mixed(h + np.uint64(7)) >> np.uint64(40)).astype(np.int64) % SLOTS


def count_levels(docs: DataFrame, words: int, key: int) -> np.ndarray:
    """For each slot the logarithm of how often documents have an n-gram of it; of fixed size."""
    step = SLOTS // PARTS

    def count(batches):
        total = np.zeros(SLOTS, np.uint32)
        for _, texts in _passes(batches):
            total += np.bincount(_slot(sets(texts, words, key)[1]), minlength=SLOTS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([pack(total[k * step : (k + 1) * step]) for k in range(PARTS)], pa.binary())], names=["part", "blob"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + unpack(blob)[0].astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(2 * np.log2(1 + v)).astype(np.uint8).tobytes() for v in sums.values()], pa.binary())], names=["part", "blob"])

    kind = "part int, blob binary"
    rows = docs.mapInArrow(count, kind).repartition(PARTS, "part").mapInArrow(add, kind).collect()  # SLOTS bytes in all
    out = np.zeros(SLOTS, np.uint8)
    for r in rows:
        out[r.part * step : (r.part + 1) * step] = np.frombuffer(bytes(r.blob), np.uint8)
    return out


def _nodes(t: np.ndarray, h: np.ndarray, second: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size, node and a second hash of each text's set; size 0 where there is none."""
    size = np.bincount(t, minlength=n_texts)
    node, check = np.zeros(n_texts, np.uint64), np.zeros(n_texts, np.uint64)
    has = np.flatnonzero(size)
    if len(has):
        first = (np.cumsum(size) - size)[has]
        for into, values, fold in ((node, h, _FOLD), (check, second, _OTHER)):
            into[has] = mixed(np.add.reduceat(mixed(values ^ fold), first) + size[has].astype(np.uint64))
    return size, node.view(np.int64), check.view(np.int64)


def _prefix(size: np.ndarray, percent: int) -> np.ndarray:
    return size - -(-percent * size // 100) + 1


def _scan(docs: DataFrame, words: int, percent: int, levels, n: int, key: int) -> DataFrame:
    """Rows (doc_id, node, size, second hash), and blobs of prefix n-grams, each with a bucket."""
    names = ["doc_id", "node", "size", "bucket", "blob", "second"]

    def run(batches):
        table = np.frombuffer(levels.value, np.uint8)
        sent: set[int] = set()
        hold: list[list[np.ndarray]] = [[], [], [], []]
        held = 0

        def flush():
            cols = [np.concatenate(x) for x in hold]
            rows = [(b, pack(*c)) for b, c in by_bucket(dealt(mixed(cols[0]), n), *cols)]
            k = len(rows)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.nulls(k, pa.int64())], names=names)

        for ids, texts in _passes(batches):
            t, h, other = sets(texts, words, key)
            size, node, second = _nodes(t, h, other, len(texts))
            k = len(ids)
            # Documents only pass through: any bucket will do, and one for each of them deals copies out too.
            some = dealt(mixed(np.arange(k, dtype=np.uint64) + node.view(np.uint64)), n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(node), pa.array(size.astype(np.int64)), pa.array(some, pa.int32()), pa.nulls(k, pa.binary()), pa.array(second)], names=names)
            level = table[_slot(h)]
            order = np.lexsort((h, level, t))
            t, h = t[order], h[order]
            at = np.arange(len(t)) - (np.cumsum(size) - size)[t]
            fresh = np.array([i is not None and s > 0 and v not in sent for i, s, v in zip(ids, size.tolist(), node.tolist())], bool)
            if len(sent) > 500_000:
                sent.clear()
            sent.update(node[fresh].tolist())
            use = fresh[t] & (at < _prefix(size, percent)[t])
            for into, v in zip(hold, (h[use], node[t[use]], size[t[use]].astype(np.uint32), at[use].astype(np.uint32))):
                into.append(v)
            held += int(use.sum())
            if held >= 1_000_000:
                yield flush()
                hold, held = [[], [], [], []], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "doc_id long, node long, size long, bucket int, blob binary, second long")


def need(size_a, size_b, percent: int):
    """Least overlap of similar sets; also for columns."""
    total = percent * (size_a + size_b)
    if isinstance(total, Column):
        return F.ceil(total / (100 + percent))
    return -(-total // (100 + percent))


def _bucket_pairs(blobs: list[bytes], percent: int, most: int):
    """Pairs of small groups with how many n-grams of the bucket they share, and the members of large groups."""
    h, node, size, at = (np.concatenate(p) for p in zip(*(unpack(x) for x in blobs)))
    order = np.lexsort((node, h))
    h, node, size, at = h[order], node[order], size[order].astype(np.int64), at[order].astype(np.int64)
    keep = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]
    h, node, size, at = h[keep], node[keep], size[keep], at[keep]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    count = np.diff(np.r_[head, len(h)])
    small = np.flatnonzero((count > 1) & (count <= most))
    member, owner = ranges(head[small], count[small])
    later = count[small][owner] - (member - head[small][owner]) - 1
    second, first = ranges(member + 1, later)
    first = member[first]
    ok = 100 * np.minimum(size[first], size[second]) >= percent * np.maximum(size[first], size[second])
    a, b = first[ok], second[ok]
    order = np.lexsort((node[b], node[a]))
    a, b = a[order], b[order]
    cut = np.flatnonzero(np.r_[True, (node[a][1:] != node[a][:-1]) | (node[b][1:] != node[b][:-1])]) if len(a) else np.empty(0, int)
    shared = np.diff(np.r_[cut, len(a)])
    large = np.flatnonzero(np.repeat(count > most, count))
    pairs = node[a[cut]], node[b[cut]], size[a[cut]], size[b[cut]], shared
    return pairs, (h[large].view(np.int64), node[large], size[large], at[large])


#: What the rows of candidates are.
_DOC, _PAIR, _MEMBER = range(3)
_CANDIDATES = "kind int, grp long, a long, b long, size long, size_b long, n long"


def _candidates(scan: DataFrame, percent: int, width: int, small: int) -> DataFrame:
    """Settled rows of three kinds. Documents: (b: doc_id, a: node, size, n: second hash). Pairs: (a, b, size, size_b, n: shared
    n-grams in one bucket). Members of large groups: (grp, a, size, n: place in the set's order)."""

    def rows(kind, grp, a, b, size, size_b, n):
        k = len(a)
        col = lambda v: pa.nulls(k, pa.int64()) if v is None else pa.array(v, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.int32()), *map(col, (grp, a, b, size, size_b, n))], names=[x.split()[0] for x in _CANDIDATES.split(", ")])

    def run(batches):
        now, blobs = None, []

        def flush():
            (a, b, sa, sb, n), (g, m, s, at) = _bucket_pairs(blobs, percent, small)
            yield rows(_PAIR, None, np.minimum(a, b), np.maximum(a, b), np.where(a < b, sa, sb), np.where(a < b, sb, sa), n)
            yield rows(_MEMBER, g, m, None, s, None, at)

        for batch in batches:
            docs = batch.filter(batch.column(4).is_null())
            if docs.num_rows:
                yield rows(_DOC, None, docs.column(1), docs.column(0), docs.column(2), None, docs.column(5))
            for bucket, blob in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if blob is None:
                    continue
                if bucket != now:
                    if blobs:
                        yield from flush()
                    now, blobs = bucket, []
                blobs.append(blob)
        if blobs:
            yield from flush()

    sent = scan.repartition(width, "bucket").sortWithinPartitions("bucket")
    return settled(sent.mapInArrow(run, _CANDIDATES), "jaccard-candidates")


def _bits(wanted: DataFrame) -> tuple[bytes, int]:
    """A bit table of bounded size that holds the wanted documents' ids, and a few others by chance; its bits.

    Bits are joined to words of 64 by partial aggregates, so that what comes to the driver is no larger than the table.
    """
    n = BITS[0]
    count = wanted.count()
    while n < min(BITS[1], 8 * count):
        n *= 2
    found = wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("bit")).selectExpr("shiftright(bit, 6) as word", "shiftleft(1L, cast(bit % 64 as int)) as mask")
    words = np.zeros(n // 64, np.int64)
    table = found.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words[np.asarray(table.column("word"))] = np.asarray(table.column("mask"))
    return words.astype("<i8").tobytes(), n


def _segments(docs: DataFrame, wanted: DataFrame, words: int, key: int) -> DataFrame:
    """(node, frag, size, blob) of each wanted set, and of a few more. ``wanted``: doc_id of a document with it.

    Texts stay where they are: a bit table says which of them to take up again.
    """
    cut = np.uint64((1 << 64) // FRAGMENTS)
    table, n_bits = _bits(wanted)
    bits = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table = np.frombuffer(bits.value, np.uint8)
        names = ["node", "frag", "size", "blob"]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        for batch in pieces(batches):
            bit = np.asarray(batch.column(2)).astype(np.int64)
            batch = batch.filter(pa.array((table[bit >> 3] >> (bit & 7) & 1).astype(bool)))
            step = max(1, int(batch.num_rows * PASS / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                texts = batch.column(1).slice(at, step).to_pylist()
                t, h, other = sets(texts, words, key)
                size, node, _ = _nodes(t, h, other, len(texts))
                frag = (h // cut).astype(np.int64)
                edge = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (frag[1:] != frag[:-1])]) if len(t) else np.empty(0, int)
                rows = [(int(node[t[s]]), int(frag[s]), int(size[t[s]]), pack(np.r_[h[s : s + 1], np.diff(h[s:e])])) for s, e in zip(edge.tolist(), np.r_[edge[1:], len(t)].tolist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    marked = docs.filter("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(n_bits)).alias("bit"))
    return settled(marked.mapInArrow(run, "node long, frag int, size long, blob binary"), "jaccard-segments")


def verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those that are similar, with their overlap: partial counts by fragment, summed."""

    def run(batches):
        for batch in batches:
            left, right = (batch.column(k).to_pylist() for k in (4, 5))
            part = [len(np.intersect1d(np.cumsum(unpack(x)[0]), np.cumsum(unpack(y)[0]), assume_unique=True)) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 3, 6)), pa.array(part, pa.int64())], names=["a", "b", "size_a", "size_b", "frag", "part"])

    left = segments.select(F.col("node").alias("a"), F.col("frag"), F.col("size").alias("size_a"), F.col("blob").alias("blob_a"))
    right = segments.select(F.col("node").alias("b"), F.col("frag"), F.col("size").alias("size_b"), F.col("blob").alias("blob_b"))
    both = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "size_a", "size_b", "blob_a", "blob_b", "frag")
    parts = both.mapInArrow(run, "a long, b long, size_a long, size_b long, frag int, part long")
    # A set may have been taken up from more than one document.
    parts = parts.groupBy("a", "b", "frag").agg(*[F.max(c).alias(c) for c in ("size_a", "size_b", "part")])
    total = parts.groupBy("a", "b").agg(F.sum("part").alias("overlap"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    return total.filter(F.lit(100) * F.col("overlap") >= percent * (F.col("size_a") + F.col("size_b") - F.col("overlap"))).select("a", "b", "overlap")


def _passing(x: str, y: str, percent: int) -> Column:
    sx, sy, ax, ay = (F.col(f"{p}_{c}") for c in ("size", "at") for p in (x, y))
    return (F.least(sx - ax, sy - ay) >= need(sx, sy, percent)) & (100 * F.least(sx, sy) >= percent * F.greatest(sx, sy))


def _possible(found: DataFrame, degree: DataFrame, percent: int) -> DataFrame:
    """Pairs whose shared prefix n-grams, summed over the buckets, leave the threshold within reach.

    Common n-grams up to the smaller of the two prefixes' ends lie in both prefixes; beyond it a set
    has no more than the rest of it. Those in large groups aren't counted by pairs: up to the
    smaller of both degrees is allowed for them.
    """
    n = found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("size").alias("sa"), F.first("size_b").alias("sb"))
    da, db = (degree.select(F.col("a").alias(x), F.col("deg").alias(f"d{x}")) for x in "ab")
    rest = F.ceil(percent * F.greatest("sa", "sb") / 100) - 1
    with_degrees = n.join(da, "a", "left").join(db, "b", "left")
    more = F.least(F.coalesce("da", F.lit(0)), F.coalesce("db", F.lit(0)))
    return with_degrees.filter(F.col("n") + more + rest >= need(F.col("sa"), F.col("sb"), percent)).select("a", "b")


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _large(groups: DataFrame, links: DataFrame, segments: DataFrame, percent: int, counts: tuple[int, ...]) -> DataFrame:
    """Links of large groups, enough to connect whatever is connected.

    ``groups``: grp, a, size, at, deg (in how many large groups the set is). Pivots are the sets in
    most groups, first of the whole group, later of its largest component. Then every set outside that
    component meets growing shares of it, picked by hash, as most sets find a link long before they
    have met all; in the last round it meets all sets that no link joins to it yet.
    """
    most = groups.groupBy("grp").count().agg(F.max("count")).first()[0]
    shares = []
    while (share := 4 * (shares[-1] if shares else max(counts, default=12))) < most / 2:
        shares.append(share)
    for round_, pivots in enumerate((*counts, *shares, None)):
        labels = components(links)
        member = groups.join(labels, groups["a"] == labels["node"], "left").select("grp", F.col("a").alias("x"), F.col("size").alias("x_size"), F.col("at").alias("x_at"), "deg", F.coalesce("root", "a").alias("x_root"))
        member = settled(member, "jaccard-members")
        core = member.groupBy("grp", "x_root").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max(F.struct("n", F.col("x_root").alias("core"))).alias("m")).select("grp", F.col("m.core").alias("core"), F.col("m.n").alias("core_n"))
        marked = member.join(core, "grp")
        other = marked.select("grp", F.col("x").alias("y"), F.col("x_size").alias("y_size"), F.col("x_at").alias("y_at"), "deg", F.col("x_root").alias("y_root"), F.col("core").alias("y_core"), F.col("core_n").alias("y_core_n"))
        outside = (marked if round_ == 0 else marked.filter("x_root <> core")).drop("deg")
        if len(counts) <= round_ < len(counts) + len(shares):
            part = F.pmod(F.xxhash64("y", F.lit(round_)), F.lit(1 << 20)) * F.col("y_core_n") < F.lit(pivots << 20)
            pairs = outside.join(other.filter("y_root = y_core").filter(part), "grp")
        elif pivots:
            turn = F.pmod(F.xxhash64("y", F.lit(round_)), F.lit(pivots))
            picks = F.array(*[F.min(F.when(turn == k, F.struct((-F.col("deg")).alias("o"), "y", "y_size", "y_at", "y_root"))) for k in range(pivots)])
            pool = other if round_ == 0 else other.filter("y_root = y_core")
            chosen = pool.groupBy("grp").agg(F.array_compact(picks).alias("p")).select("grp", F.explode("p").alias("p")).select("grp", "p.*")
            pairs = outside.join(chosen, "grp")
        else:
            pairs = outside.join(other, "grp").filter("(y_root = y_core) or x < y")
        pairs = settled(_ordered(pairs.filter("x_root <> y_root").filter(_passing("x", "y", percent))), "jaccard-pairs")
        if not pairs.isEmpty():
            links = settled(links.select("a", "b").union(verified(pairs, segments, percent).select("a", "b")), "jaccard-links")
    return links


def join(docs: DataFrame, words: int = 4, percent: int = 85, small: int = SMALL, pivots: tuple[int, ...] = PIVOTS) -> DataFrame:
    """(doc_id, n_shingles, node, component_id) for every row of ``docs``."""
    docs = ids_and_texts(docs)
    spark = docs.sparkSession
    width = cluster_width(spark)
    for _ in range(8):
        key = secrets.randbits(63)
        levels = spark.sparkContext.broadcast(count_levels(docs, words, key).tobytes())
        found = _candidates(_scan(docs, words, percent, levels, SPREAD * width, key), percent, width, small)
        rows = found.filter(F.col("kind") == _DOC).select(F.col("b").alias("doc_id"), F.col("a").alias("node"), "size", F.col("n").alias("second"))
        # One row a set: its documents are counted up before they travel.
        reps = settled(rows.filter("size > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("second").alias("low"), F.max("second").alias("high")), "jaccard-sets")
        if reps.filter("low <> high").isEmpty():
            break
    else:
        raise RuntimeError("hashes kept colliding")
    member = found.filter(F.col("kind") == _MEMBER).select("grp", "a", "size", F.col("n").alias("at"))
    degree = settled(member.groupBy("a").agg(F.count(F.lit(1)).alias("deg")), "jaccard-degrees")
    groups = settled(member.join(degree, "a"), "jaccard-groups")
    pairs = settled(_possible(found.filter(F.col("kind") == _PAIR), degree, percent), "jaccard-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(degree.select("a")).distinct()
    segments = _segments(docs, settled(wanted.join(reps, "node").select("doc_id"), "jaccard-wanted"), words, key)
    links = settled(verified(pairs, segments, percent).select("a", "b"), "jaccard-links")
    if not groups.isEmpty():
        links = _large(groups, links, segments, percent, pivots)
    # Components are named by their least document on rows of sets; only sets that are linked are in ``labels``.
    rooted = settled(reps.join(components(links), "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "jaccard-roots")
    least = settled(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    named = settled(rooted.join(least, "root").select("node", "component_id"), "jaccard-named")
    # Both sides of this join are plain files, so a set with very many copies is split by the adaptive planner.
    linked = rows.filter("size > 0 and doc_id is not null").join(named, "node")
    alone = rows.filter("not (size > 0 and doc_id is not null)").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select("doc_id", F.col("size").alias("n_shingles"), "node", "component_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay when each component keeps the document with the smallest ``doc_id``.

    Repeated rows of that ``doc_id`` stay; documents without words or without ``doc_id`` stay.
    """
    out = join(docs, words, percent)
    losers = out.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("_j_id")).distinct()
    left = docs.join(losers, F.col("doc_id").cast("long") == F.col("_j_id"), "left_anti")
    return left.select(*docs.columns)


#: Links at four words and 85 percent by plain SQL: shared shingles counted by pairs, components by all that links reach.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT i, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) AS g FROM w),
x AS (SELECT i, len(g) AS n, unnest(g) AS g FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.i AS a, b.i AS b FROM x a JOIN x b ON a.g = b.g AND a.i <> b.i GROUP BY a.i, b.i HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
least_of AS (SELECT r.a, min(s.doc_id) AS least FROM r JOIN s ON s.i = r.b GROUP BY r.a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, CASE WHEN s.doc_id IS NOT NULL THEN least(s.doc_id, coalesce(l.least, s.doc_id)) END AS component_id
FROM s LEFT JOIN least_of l ON l.a = s.i
"""
