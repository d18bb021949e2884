"""The trie of all conversations' turns, and what its shared prefixes would save.

A node is a distinct sequence of first turns (role and text); its members are the conversations that
start with it. Texts are replaced by digests where they are read, and a chain of SHA-256 over the
turns (128 bits kept) names each prefix, so what is shuffled has a fixed size a turn.

* Equal prefixes are summed up first, with partial sums in every task: a first turn shared by a third
  of all conversations is one row a task.
* The trie is cut where the rows below a node number ``heavy`` or fewer. The subtrees under the cut are
  dealt into shards; numpy builds each shard as a level-order trie (:class:`Louds`: a bit vector of
  degrees and arrays of labels) and adds up its levels from the last to the first with ``add.at``.
* What is above the cut, the heavy upper levels, is merged apart: each round adds the sums of nodes
  to their ancestors 1, 2, 4, ... levels up, so a chain of m heavy nodes takes log2(m) rounds.

The turns of one conversation are chained in one task, row by row, in constant memory; SHA-256 over
the members that end in a node is taken the same way, from packed stretches of ascending numbers.

Turns are ordered by ``turn``, null first; of equal ones by role, then by digest. Null roles and texts
are empty. Repeated rows are turns like any other. Rows without ``conv_id`` belong to no conversation
and are left out. No conversations give no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cluster_width, settled

#: Subtrees of more rows than this are cut further, and nodes of one shard on the average.
HEAVY, SHARD_NODES = 4096, 100_000

_NODE = ["a", "b"]  # the name of a prefix in two numbers; the root is 0, 0
_UP = ["pa", "pb"]


class Louds:
    """A forest under one super-root (number 0), its nodes numbered level by level.

    ``bits`` has a one for each child and then a zero, for node after node; ``order`` has the given
    row of node 1, 2, ...
    """

    def __init__(self, level: np.ndarray, above: np.ndarray):
        """``above``: the row of the parent, -1 for roots, which are of level 0."""
        n = len(level)
        number, self.order, self.levels = np.zeros(n + 1, np.int64), np.empty(n, np.int64), [0]
        rows = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[rows], np.arange(int(level.max(initial=-1)) + 2))
        for lo, hi in zip(cuts, cuts[1:]):
            here = rows[lo:hi]
            here = here[np.argsort(number[above[here]], kind="stable")]  # row -1 is the super-root's
            number[here] = np.arange(lo, hi) + 1
            self.order[lo:hi] = here
            self.levels.append(int(hi))
        self.degrees = np.bincount(number[above], minlength=n + 1) if n else np.zeros(1, np.int64)
        bits = np.ones(2 * n + 1, np.uint8)
        bits[np.cumsum(self.degrees + 1) - 1] = 0
        self.bits, self.size = np.packbits(bits), n

    def parents(self) -> np.ndarray:
        """The number of each node's parent, for nodes 1, 2, ...: the zeros before its one."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=2 * self.size + 1))
        return ones - np.arange(self.size)

    def children(self, node: int) -> range:
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=2 * self.size + 1) == 0)
        first = 0 if node == 0 else int(zeros[node - 1]) - node + 1
        return range(first + 1, first + 1 + int(self.degrees[node]))

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values of nodes 1, 2, ...; the super-root's is first."""
        out, up = np.concatenate([[0], values]), self.parents()
        for lo, hi in zip(self.levels[-2::-1], self.levels[:0:-1]):
            np.add.at(out, up[lo:hi], out[lo + 1 : hi + 1])
        return out


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role_text, n_bytes): turns numbered from 0, each as a digest and the size of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("role_text"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "role_text")
    return rows.filter("conv_id IS NOT NULL").select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("at"), "role_text", "n_bytes")


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of another one, and (conv_id, size) of all of them.

    Conversation c takes the first h turns of conversation c - c % 5, h = crc32(c) % 9, and keeps its own after its first h.
    """
    sizes = turns.groupBy("conv_id").agg((F.max("at") + 1).alias("n"))
    lead = F.col("conv_id") - F.col("conv_id") % 5
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    members = sizes.select("conv_id", "n", lead.alias("lead"), h.alias("h"))
    members = members.join(sizes.select(F.col("conv_id").alias("lead"), F.col("n").alias("there")), "lead", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    members = members.select("conv_id", "lead", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size"))
    members = settled(members, "trie-members")
    own = turns.join(members, "conv_id").filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "role_text", "n_bytes", "size")
    lent = turns.filter("at < 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "lead")
    lent = lent.join(members, "lead").filter("at < h").select("conv_id", "at", "role_text", "n_bytes", "size")
    return own.unionByName(lent), members.select("conv_id", "size")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the prefixes of conversations that come row by row in their order."""
    conv, state = None, bytes(16)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, at = batch.column(0).to_pylist(), batch.column(1)
        names = [bytes(16)] * (len(ids) + 1)
        above = []
        for k, (c, digest) in enumerate(zip(ids, batch.column(2).to_pylist())):
            if c != conv:
                conv, state = c, bytes(16)
            above.append(state)
            state = hashlib.sha256(state + digest).digest()[:16]
            names[k] = state
        own, up = (np.frombuffer(b"".join(x[: len(ids)]), "<i8").reshape(-1, 2) for x in (names, above))
        size, depth = batch.column(4).to_numpy(), at.to_numpy() + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(depth), *(pa.array(np.ascontiguousarray(x[:, k])) for x in (own, up) for k in (0, 1)), batch.column(3), pa.array(size - depth + 1), pa.array((size == depth).astype(np.int64))],
            names=["conv_id", "depth", *_NODE, *_UP, "n_bytes", "rest", "ended"],
        )


def paths(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each conversation and each of its prefixes, the empty one included; ``rest`` is the rows from here on."""
    n = cluster_width(turns.sparkSession)
    rows = turns.select("conv_id", "at", "role_text", "n_bytes", "size").repartition(n, "conv_id").sortWithinPartitions("conv_id", "at")
    below = rows.mapInArrow(_chained, "conv_id long, depth long, a long, b long, pa long, pb long, n_bytes long, rest long, ended long")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = sizes.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("n_bytes"), (F.col("size") + 1).alias("rest"), (F.col("size") == 0).cast("long").alias("ended"))
    return below.unionByName(top)


def _shard(rows: pa.Table) -> pa.Table:
    """The light subtrees of a shard: rolled up, with the members' least numbers of parents."""
    got = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "depth", "top_depth", "n_bytes", "n_convs", "conv_id")}
    level = got["depth"] - got["top_depth"]
    up = [np.where(level > 0, rows.column(c).fill_null(0).to_numpy(), 0) for c in _UP]
    name = np.dtype([("a", "<i8"), ("b", "<i8")])
    own, above = np.empty(len(level), name), np.empty(len(level), name)
    own["a"], own["b"], above["a"], above["b"] = got["a"], got["b"], *up
    by_name = np.argsort(own, order=_NODE, kind="stable")
    place = np.full(len(level), -1)
    inner = np.flatnonzero(level > 0)
    place[inner] = by_name[np.searchsorted(own[by_name], above[inner])]
    trie = Louds(level, place)
    order = trie.order
    children = trie.degrees[1:]
    saved = trie.summed(((got["n_convs"] - 1) * got["n_bytes"])[order])[1:]
    leaves = trie.summed((children == 0).astype(np.int64))[1:]
    top = level[order] == 0
    labels = np.concatenate([[0], got["conv_id"][order]])
    columns = [*(got[c][order] for c in ("a", "b", "conv_id", "depth", "n_convs")), children, leaves, saved]
    out = pa.table([*map(pa.array, columns), pa.array(labels[trie.parents()], mask=top), pa.array(top)], names=["a", "b", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id", "is_top"])
    return out.append_column("pa", rows.column("pa").take(pa.array(order))).append_column("pb", rows.column("pb").take(pa.array(order)))


def _merged(upper: DataFrame, depth: int) -> DataFrame:
    """Sums over the heavy nodes below each heavy node, by ancestors 1, 2, 4, ... levels up."""
    far = upper.select(*_NODE, F.col("pa").alias("ua"), F.col("pb").alias("ub"), "n_leaves", "saved_tokens")
    reach = 1
    while reach <= depth:
        more = far.filter("ua IS NOT NULL").groupBy(F.col("ua").alias("a"), F.col("ub").alias("b")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        next_up = far.select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("ua").alias("next_a"), F.col("ub").alias("next_b"))
        far = far.join(more, _NODE, "left").join(next_up, ["ua", "ub"], "left")
        far = far.select(*_NODE, F.col("next_a").alias("ua"), F.col("next_b").alias("ub"), *((F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))))
        far, reach = settled(far, "trie-upper"), 2 * reach
    return far.select(*_NODE, "n_leaves", "saved_tokens")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that come in ascending order, joined by node for each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, ids = (c.to_numpy() for c in batch.columns)
        order = np.lexsort((ids, b, a))
        a, b, ids = a[order], b[order], ids[order]
        cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        joined = [",".join(map(str, x)) for x in np.split(ids, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(a[cuts]), pa.array(b[cuts]), pa.array(ids[cuts]), pa.array(joined)], names=["a", "b", "least", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's stretches, which come in order."""

    def out(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0][k] for x in done], pa.int64()) for k in (0, 1)] + [pa.array([x[1] for x in done], pa.string())], names=["a", "b", "ends_sha256"])

    node, state, done = None, None, []
    for batch in batches:
        for key, rows in groupby(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))), key=lambda r: r[:2]):
            if key != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
                first = True
            for *_, ids in rows:
                state.update(ids.encode() if first else b"," + ids.encode())
                first = False
        yield out(done)
        done = []
    if node is not None:
        yield out([(node, state.hexdigest())])


def ends(found: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of nodes in which conversations end."""
    n = cluster_width(found.sparkSession)
    last = found.filter("ended = 1").select(*_NODE, "conv_id").repartitionByRange(n, "conv_id").sortWithinPartitions("conv_id")
    packed = last.mapInArrow(_stretches, "a long, b long, least long, ids string")
    return packed.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "least").mapInArrow(_hashed, "a long, b long, ends_sha256 string")


def trie(turns: DataFrame, sizes: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """A row for each node of the trie of ``turns`` (conv_id, at, role_text, n_bytes, size); ``sizes`` has every conversation."""
    spark = turns.sparkSession
    found = settled(paths(turns, sizes), "trie-paths")
    nodes = found.groupBy(*_NODE).agg(*(F.min(c).alias(c) for c in (*_UP, "depth", "n_bytes", "conv_id")), F.count("*").alias("n_convs"), F.sum("rest").alias("weight"))
    nodes = settled(nodes, "trie-nodes")
    upper, light = nodes.filter(F.col("weight") > heavy), nodes.filter(F.col("weight") <= heavy)

    names = upper.select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    tops = light.join(names, _UP, "left_semi").unionByName(light.filter("depth = 0"))
    tops = tops.select(*_NODE, F.col("depth").alias("top_depth"))
    shards = max(cluster_width(spark), -(-light.count() // SHARD_NODES))
    shard = F.pmod(F.xxhash64(*_NODE), F.lit(shards)).alias("shard")
    homes = found.join(tops, _NODE).select("conv_id", shard, "top_depth")
    rolled = light.join(homes, "conv_id").groupBy("shard").applyInArrow(
        _shard, "a long, b long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, is_top boolean, pa long, pb long"
    )
    rolled = settled(rolled, "trie-light")

    below = rolled.filter("is_top").groupBy(*_UP).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    kin = upper.groupBy(*_UP).agg(F.count("*").alias("kin"))

    def named(df: DataFrame) -> DataFrame:
        return df.filter("pa IS NOT NULL").withColumnsRenamed({"pa": "a", "pb": "b"})

    upper = upper.join(named(below), _NODE, "left").join(named(kin), _NODE, "left").na.fill(0, ["tops", "leaves", "saved", "kin"])
    children = F.col("tops") + F.col("kin")
    upper = upper.select(*_NODE, *_UP, "conv_id", "depth", "n_convs", children.alias("n_children"), (F.col("leaves") + (children == 0).cast("long")).alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    upper = settled(upper, "trie-heavy")
    sums = _merged(upper, upper.agg(F.max("depth")).first()[0] or 0)
    upper = upper.drop("n_leaves", "saved_tokens").join(sums, _NODE)

    parents = upper.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    columns = [*_NODE, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    out = rolled.filter("NOT is_top").select(columns)
    out = out.unionByName(rolled.filter("is_top").drop("parent_conv_id").join(parents, _UP, "left").select(columns))
    out = out.unionByName(upper.join(parents, _UP, "left").select(columns))
    out = out.join(ends(found), _NODE, "left")
    return out.select(*columns[2:], F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rollups(conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The contract's rows: the trie of the conversations of :func:`branched`."""
    turns = settled(turns_of(conversations), "trie-turns")
    return trie(*branched(turns), heavy=heavy)


#: The same by prefixes as joined digests; a node's ancestors are those on the path of its least member.
SQL = r"""
WITH d AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, left(sha, 32)) - 1 AS pos, sha, size
  FROM (SELECT *, sha256(concat(length(role), ':', role, text)) AS sha, strlen(text) AS size FROM d)),
s AS (
  SELECT c, count(*) AS n, c - c % 5 AS lead,
    xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END)) % 9 AS h
  FROM t GROUP BY c),
m AS (SELECT s.c, s.n, s.lead, s.h, least(s.h, coalesce(l.n, 0)) AS taken FROM s LEFT JOIN s l ON l.c = s.lead),
r AS (
  SELECT m.c, t.pos - m.h + m.taken AS pos, sha, size FROM m JOIN t ON t.c = m.c AND t.pos >= m.h
  UNION ALL
  SELECT m.c, t.pos, sha, size FROM m JOIN t ON t.c = m.lead AND t.pos < m.h),
p AS (
  SELECT c, 0 AS depth, '' AS k, 0 AS size FROM m
  UNION ALL
  SELECT c, pos + 1, sha256(string_agg(sha, ',') OVER (PARTITION BY c ORDER BY pos)), size FROM r),
q AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY depth) AS up, max(depth) OVER (PARTITION BY c) = depth AS ended FROM p),
n AS (
  SELECT k, any_value(up) AS up, min(depth) AS depth, min(c) AS c, count(*) AS members, min(size) AS size,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends
  FROM q GROUP BY k),
ch AS (SELECT up, count(*) AS children FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT n.*, coalesce(ch.children, 0) AS children FROM n LEFT JOIN ch ON ch.up = n.k),
below AS (
  SELECT p.k, count(*) FILTER (WHERE f.children = 0) AS leaves, sum((f.members - 1) * f.size) AS saved
  FROM f JOIN p ON p.c = f.c AND p.depth <= f.depth GROUP BY p.k)
SELECT f.c AS conv_id, f.depth::BIGINT AS depth, u.c AS parent_conv_id, f.members::BIGINT AS n_convs, f.children::BIGINT AS n_children,
  below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN below ON below.k = f.k LEFT JOIN n u ON u.k = f.up
"""
