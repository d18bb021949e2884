"""Exact histogram of encoded lengths.

Every whole text is encoded once; documents are counted by their number of ids (the end id
included). The histogram has one row a distinct length, so it is small beside the corpus, and
all later answers come from suffix sums over it: how many documents reach a context limit, how
many ids are kept when each document is cut there, how many are lost, exact quantiles.

Null and empty texts have length 1, the end id. Repeated rows count once each. An empty table
has an empty histogram. Other columns are not read. Suffix sums are taken by splitting lengths
into ranges: totals of each range first, then sums inside a range, so that no task gets all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, pieces, settled
from .tokens import encoder

#: Lengths are dealt out in ranges of so many values.
RANGE = 1024
QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.99)
#: Context limits of the report.
LIMITS = (512, 1024, 2048, 4096, 8192)


def lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in pieces(batches):
            n = [len(encode(t)) // 4 + 1 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): counted inside each task first, then summed by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = encoder(vocabulary).encode, Counter()
        for batch in pieces(batches):
            counts.update(len(encode(t)) // 4 + 1 for t in batch.column(0).to_pylist())
        keys = np.array(sorted(counts), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([counts[k] for k in keys.tolist()], pa.int64())], names=["n_tokens", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long, n long")
    return counted.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def answers(hist: DataFrame) -> DataFrame:
    """One row a distinct length L, taken as context limit, by suffix sums.

    docs_at_least: documents of L ids or more; tokens_at_least: their ids; docs_over: of more than
    L; kept_tokens: ids left when every document is cut at L; lost_tokens: the rest; share_below:
    documents shorter than or equal to L over all; total_docs, total_tokens.
    """
    ranged = hist.withColumn("part", F.floor(F.col("n_tokens") / RANGE)).withColumn("mass", F.col("n_tokens") * F.col("n_docs"))
    totals = ranged.groupBy("part").agg(F.sum("n_docs").alias("pd"), F.sum("mass").alias("pm"))
    # One row for RANGE possible lengths: the sums over later ranges are over few rows.
    later = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("pd").over(later), F.lit(0)).alias("later_d"),
        F.coalesce(F.sum("pm").over(later), F.lit(0)).alias("later_m"),
        F.sum("pd").over(whole).alias("total_docs"),
        F.sum("pm").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("n_tokens").desc())
    out = ranged.join(totals, "part").select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("later_d")).alias("docs_at_least"),
        (F.sum("mass").over(inside) + F.col("later_m")).alias("tokens_at_least"),
        "mass",
        "total_docs",
        "total_tokens",
    )
    over_docs, over_mass = F.col("docs_at_least") - F.col("n_docs"), F.col("tokens_at_least") - F.col("mass")
    lost = over_mass - over_docs * F.col("context_limit")
    return out.select(
        "context_limit",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        over_docs.alias("docs_over"),
        (F.col("total_tokens") - lost).alias("kept_tokens"),
        lost.alias("lost_tokens"),
        ((F.col("total_docs") - over_docs) / F.col("total_docs")).alias("share_within"),
        "total_docs",
        "total_tokens",
    )


def quantiles(answered: DataFrame, points: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(quantile, n_tokens): the least length within which so large a share of documents lies."""
    picks = [F.min(F.when(F.col("total_docs") - F.col("docs_over") >= F.ceil(F.lit(q) * F.col("total_docs")), F.col("context_limit"))) for q in points]
    one = answered.agg(*[p.alias(f"q{k}") for k, p in enumerate(picks)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"q{k}").alias("n_tokens")) for k, q in enumerate(points)])).alias("x")).select("x.*")


def truncated(answered: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, kept_tokens, lost_tokens) for any limits, also lengths that no document has.

    A limit's suffix starts at the least present length above it.
    """
    picks = []
    for k, limit in enumerate(limits):
        above = F.col("context_limit") > limit
        picks += [F.max(F.when(above, F.col("docs_at_least"))).alias(f"d{k}"), F.max(F.when(above, F.col("tokens_at_least"))).alias(f"m{k}")]
    one = answered.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("t"), *picks)
    rows = []
    for k, limit in enumerate(limits):
        d, m = F.coalesce(f"d{k}", F.lit(0)), F.coalesce(f"m{k}", F.lit(0))
        lost = m - d * F.lit(limit)
        rows.append(F.struct(F.lit(limit).cast("long").alias("limit"), d.alias("docs_over"), (F.col("t") - lost).alias("kept_tokens"), lost.alias("lost_tokens")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def report(hist: DataFrame, points: tuple[float, ...] = QUANTILES, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """The answers, and on every row the quantiles (``quantile_50``, ...) and, for each limit, the documents
    over it and the ids kept and lost there (``docs_over_512``, ``kept_at_512``, ``lost_at_512``, ...)."""
    answered = answers(settled(hist, "token-histogram"))
    q, t = quantiles(answered, points), truncated(answered, list(limits))
    of = lambda c, key, v: F.max(F.when(F.col(key) == F.lit(v), F.col(c)))
    one = q.agg(*[of("n_tokens", "quantile", p).alias(f"quantile_{p * 100:g}") for p in points])
    two = t.agg(*[of(c, "limit", k).alias(f"{c.split('_')[0]}_{'over' if c == 'docs_over' else 'at'}_{k}") for k in limits for c in ("docs_over", "kept_tokens", "lost_tokens")])
    return answered.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(two))
