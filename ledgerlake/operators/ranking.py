"""First, last and best rows by explicit ordinals; top-k; key sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return _pick(df, keys, [F.col(c).asc_nulls_first() for c in order])


def last_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, [F.col(c).desc_nulls_last() for c in order])


def best_per(df: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """The row of each key with the highest score; the first of equals."""
    return _pick(df, keys, [F.col(score).desc(), *[F.col(c).asc() for c in order]])


def first_by_aggregate(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """As :func:`first_per`, but by a partial aggregate: a hot key moves one row a task."""
    packed = F.min(F.struct(*order, *values)).alias("_m")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in (*order, *values)])


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def retained(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The rows to keep of versions; order from newest to oldest."""
    return df.orderBy(*order).limit(n)


def ema(df: DataFrame, keys: list[str], order: str, value: str, seconds: str, alpha: float = 0.25, least: float = 0.5) -> DataFrame:
    """(keys..., ema): exponential mean of the samples in order, the first one as it is; short samples don't count.

    A sample's weight follows from how many come after it, so the mean is a sum over rows: a key with many samples
    is sorted, but never held as one value.
    """
    good = F.col(seconds) >= least
    w = Window.partitionBy(*keys, good.alias("_good"))
    after = F.row_number().over(w.orderBy(F.col(order).desc())) - 1
    first = F.row_number().over(w.orderBy(F.col(order).asc())) == 1
    ranked = df.select(*keys, F.col(value).cast("double").alias("_v"), F.coalesce(good, F.lit(False)).alias("_use"), after.alias("_after"), first.alias("_first"))
    weight = F.pow(F.lit(1 - alpha), F.col("_after")) * F.when(F.col("_first"), 1.0).otherwise(alpha)
    return ranked.groupBy(*keys).agg(F.sum(F.when(F.col("_use"), F.col("_v") * weight)).alias("ema"))
