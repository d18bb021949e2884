"""Joins over time: as of a moment, moments in intervals, overlaps of intervals.

Work is dealt out by key and stretch of time, so one key may hold any share of the rows. Times are
timestamps, or whole numbers of one unit; widths are in microseconds or in that unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

DAY = 86_400_000_000


def ticks(rows: DataFrame, name: str) -> Column:
    """A time as a long: microseconds of a timestamp, the number itself otherwise."""
    kind = rows.schema[name].dataType
    if isinstance(kind, TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, TimestampNTZType):  # by its own calendar, whatever the session's zone
        inside = (F.hour(name) * 3600 + F.minute(name) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(name)) * 1_000_000).cast("long")
        return F.unix_date(F.to_date(name)).cast("long") * DAY + inside
    return F.unix_date(F.col(name)).cast("long") * DAY if isinstance(kind, DateType) else F.col(name).cast("long")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, take: list[str], *, forward: bool = False, strict: bool = False, within: int | None = None, width: int = DAY) -> DataFrame:
    """Each row of ``left`` with the columns ``take`` of the row of ``right`` in force at its time.

    In force is the last one of the same key at or before the time (``forward``: the first at or after it;
    ``strict``: not at it), of equal times the one with the greatest ``take``. ``within`` is the most that may lie
    between. All rows of ``left`` stay, repeated ones too; keys match as they are equal, nulls with nothing, and
    rows of ``right`` without a time are passed over. ``take`` must not name columns of ``left``.

    Both sides are cut into stretches of ``width``. The last row of each stretch goes on to the next ones that
    hold rows of ``left``; inside a stretch one sort of both sides decides. What is ordered by key alone
    is one row a key and stretch.
    """
    if clash := set(take) & set(left.columns):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    sign = -1 if forward else 1
    # What is looked up goes first among equal times, or last where the join is strict.
    first, then = (1, 0) if strict else (0, 1)
    keys = [f"_k{k}" for k in range(len(on))]
    known = " AND ".join(f"{k} IS NOT NULL" for k in ["_t", *keys])

    def keyed(rows: DataFrame, time: str) -> DataFrame:
        return rows.withColumns({"_t": ticks(rows, time) * sign, **{k: F.col(c) for k, c in zip(keys, on)}}).withColumn("_b", F.expr(f"(_t - pmod(_t, {width}L)) div {width}L"))

    found = keyed(right, right_time).filter(known).select(*keys, "_b", F.struct("_t", F.struct(*take).alias("v")).alias("_r"))
    every = keyed(left, left_time)
    asked = every.filter(known).select(*keys, "_b", "_t", F.struct(*[F.col(c) for c in left.columns]).alias("_l"))

    ends = found.groupBy(*keys, "_b").agg(F.max("_r").alias("_end"))
    places = asked.select(*keys, "_b").distinct().withColumn("_asked", F.lit(True))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    both = ends.join(places, [*keys, "_b"], "full_outer")
    carried = both.withColumn("_r", F.last("_end", ignorenulls=True).over(before)).filter("_asked AND _r IS NOT NULL")

    none_l, none_r = F.lit(None).cast(asked.schema["_l"].dataType), F.lit(None).cast(found.schema["_r"].dataType)
    rows = asked.select(*keys, "_b", "_t", F.lit(then).alias("_side"), "_l", none_r.alias("_r"))
    for some in (found, carried):
        rows = rows.unionByName(some.select(*keys, "_b", F.col("_r._t").alias("_t"), F.lit(first).alias("_side"), none_l.alias("_l"), "_r"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.lit(True) if within is None else F.col("_t") - F.col("_m._t") <= within
    matched = rows.withColumn("_m", F.last("_r", ignorenulls=True).over(inside)).filter(F.col("_l").isNotNull())
    out = matched.select("_l.*", *[F.when(near, F.col(f"_m.v.{c}")).alias(c) for c in take])
    alone = every.filter(f"NOT ({known})").select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take])
    return out.unionByName(alone)


def _levels(intervals: DataFrame) -> list[int]:
    """Which powers of two the lengths need; 64 at most."""
    return sorted(r[0] for r in intervals.select("_level").distinct().collect())


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, *, after_start: bool = False) -> DataFrame:
    """Pairs of a point and an interval of the same key with ``start <= at < end`` (``after_start``: start < at).

    An interval is laid on stretches of the power of two that is no shorter than it, of which it meets two at most;
    a point looks into one stretch of each length that occurs. So neither long intervals nor long times between
    points make many rows. Intervals that are empty or have a null bound meet nothing, nor do null keys. Columns of
    the same name but the keys raise an error.
    """
    if clash := (set(points.columns) & set(intervals.columns)) - set(on):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    s, e = ticks(intervals, start), ticks(intervals, end)
    spans = intervals.withColumns({"_s": s, "_e": e}).filter("_s < _e")
    # the bits of length - 1: the least power of two that is no shorter
    spans = spans.withColumn("_level", F.when(F.col("_e") - F.col("_s") <= 1, 0).otherwise(F.length(F.bin(F.col("_e") - F.col("_s") - 1))))
    levels = _levels(spans) or [0]
    cells = F.array_distinct(F.array(F.expr("shiftright(_s, _level)"), F.expr("shiftright(_e - 1, _level)")))
    spans = spans.withColumn("_cell", F.explode(cells))
    looks = F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright("_p", k).alias("_cell")) for k in levels]))
    asked = points.withColumn("_p", ticks(points, at)).filter("_p IS NOT NULL").withColumn("_look", looks).select(*points.columns, "_p", "_look._level", "_look._cell")
    later = (F.col("_s") < F.col("_p")) if after_start else (F.col("_s") <= F.col("_p"))
    hit = asked.join(spans, [*on, "_level", "_cell"]).filter(later & (F.col("_p") < F.col("_e")))
    return hit.select(*on, *[c for c in points.columns if c not in on], *[c for c in intervals.columns if c not in on])


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs of half-open intervals of the same key that share a moment, each once: the later start lies in the other."""
    one = a.filter(ticks(a, a_span[0]) < ticks(a, a_span[1]))
    two = b.filter(ticks(b, b_span[0]) < ticks(b, b_span[1]))
    names = [*on, *[c for c in a.columns if c not in on], *[c for c in b.columns if c not in on]]
    inside = interval_join(one, two, on, a_span[0], *b_span).select(*names)
    return inside.unionByName(interval_join(two, one, on, b_span[0], *a_span, after_start=True).select(*names))
