"""Joins by time: the nearest earlier or later row of the same key, and points in intervals. Neither makes a cross product, and a hot key is split by time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of the largest possible key that a slice of time is meant to hold.
SLICE_ROWS = 1_000_000
#: Each level of intervals is this many times as long as the one below.
FACTOR = 4


def micros(df: DataFrame, c: str, within: str | None = None) -> Column:
    """A time column as a whole number: microseconds of timestamps (without a zone: of the clock's reading) and dates; integers as they are."""
    kind, v = df.schema[c].dataType.typeName(), F.col(f"{within}.`{c}`" if within else f"`{c}`")
    if kind == "timestamp":
        return F.unix_micros(v)
    if kind not in ("date", "timestamp_ntz"):
        return v.cast("long")
    days = F.unix_date(v.cast("date")).cast("long") * F.lit(86_400_000_000)
    return days if kind == "date" else days + (F.hour(v) * 3600 + F.minute(v) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), v) * 1_000_000).cast("long")


def asof(
    left: DataFrame, right: DataFrame, by: dict[str, str], on: tuple[str, str], tie: list[str] | None = None, forward: bool = False, within: int | None = None, slice_width: int | None = None
) -> DataFrame:
    """All rows of left, each with `match`: the row of right, as a struct, of the same key whose time is the last one at or before its own; null without one.

    by: left's key columns and right's. on: the columns of times (timestamps, dates or integers). Of several rows of right at that time the one of
    the greatest `tie`, else of the greatest values. forward: the first one at or after instead. within: the greatest distance, in microseconds,
    days' microseconds, or units of integers. Rows of left with a null key or time have no match, such rows of right match none; repeated rows stay.

    Both sides go through one sort by key, slice of time and time; the last row of right is carried forward in a slice, and from slice to slice by
    one row a slice. So no key is one task, however many rows it has; slice_width: as `within`, from the rows' number and span unless given.
    """
    sign = -1 if forward else 1
    keys = [f"_k{i}" for i in range(len(by))]
    a = left.select(F.struct("*").alias("_row"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], (micros(left, on[0]) * sign).alias("_t"))
    b = right.select(F.struct("*").alias("_match"), *[F.col(c).alias(k) for c, k in zip(by.values(), keys, strict=True)], (micros(right, on[1]) * sign).alias("_t"))
    b = b.withColumn("_tie", F.struct(*[F.col(f"_match.{c}") for c in (tie or [])], F.xxhash64("_match")))
    full = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*keys, "_t"]])
    b = b.filter(full)
    if slice_width is None:
        span = b.agg(F.count("*").alias("n"), F.min("_t").alias("least"), F.max("_t").alias("most")).first()
        slice_width = max(1, ((span["most"] or 0) - (span["least"] or 0)) // max(16, span["n"] // SLICE_ROWS) + 1)
    slice_ = F.expr(f"(_t - pmod(_t, {slice_width}L)) div {slice_width}L")
    a = a.withColumn("_s", slice_).withColumn("_side", F.lit(1))
    b = b.withColumn("_s", slice_).withColumn("_side", F.lit(0))
    order = F.struct("_t", "_tie")
    # One row a key and slice that has rows of right: its last one, carried on to the slices behind it that have rows of left.
    last = b.groupBy(*keys, "_s").agg(F.max_by("_match", order).alias("_last"))
    asked = a.filter(full).select(*keys, "_s").distinct()
    w = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.join(last, [*keys, "_s"], "full").withColumn("_before", F.last("_last", ignorenulls=True).over(w)).select(*keys, "_s", "_before")
    both = a.filter(full).unionByName(b, allowMissingColumns=True)
    within_slice = Window.partitionBy(*keys, "_s").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = both.withColumn("_in", F.last("_match", ignorenulls=True).over(within_slice)).filter("_side = 1").select("_row", *keys, "_s", "_t", "_in")
    d = d.join(carried, [*keys, "_s"], "left").withColumn("match", F.coalesce("_in", "_before")).select("_row", "_t", "match")
    if within is not None:
        far = F.col("_t") - micros(right, on[1], "match") * sign > within
        d = d.withColumn("match", F.when(~far, F.col("match")))
    none = a.filter(~F.coalesce(full, F.lit(False))).select("_row", "_t", F.lit(None).cast(d.schema["match"].dataType).alias("match"))
    names = [c for c in left.columns if c != "match"]
    return d.unionByName(none).select(*[F.col(f"_row.`{c}`").alias(c) for c in names], "match")


def in_intervals(points: DataFrame, intervals: DataFrame, by: dict[str, str], point: str, start: str, end: str, least_width: int = 1) -> DataFrame:
    """(point, interval): a row, two structs, for each point of the same key with start <= its time < end.

    by: the points' key columns and the intervals'. Times as in asof(). Intervals that are empty, end before they start or have a null hold none, nor do
    points with a null. Repeated rows pair each.

    An interval goes to the bins of its own level, whose width is at least its length, so to two at most, whatever its length; a point goes to one
    bin of each level that there is: their number grows with the logarithm of the longest interval. Pairs meet by key, level and bin, so a hot key
    is split by time. least_width: of the lowest level, in microseconds or units.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    p = points.select(F.struct("*").alias("point"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], micros(points, point).alias("_t"))
    i = intervals.select(F.struct("*").alias("interval"), *[F.col(c).alias(k) for c, k in zip(by.values(), keys, strict=True)], micros(intervals, start).alias("_a"), micros(intervals, end).alias("_b"))
    i = i.filter("_b > _a")
    # The level in whole numbers: how often the lowest width has to grow to reach the length.
    grown = [least_width * FACTOR**n for n in range(32) if least_width * FACTOR**n < 1 << 62]
    level = reduce(lambda rest, n: F.when(F.col("_b") - F.col("_a") <= grown[n], n).otherwise(rest), range(len(grown) - 1, -1, -1), F.lit(len(grown)))
    i = i.withColumn("_level", level)
    levels = sorted(r[0] for r in i.select("_level").distinct().collect())
    width = lambda n: grown[n] if n < len(grown) else 1 << 62
    bin_of = lambda t, w: f"({t} - pmod({t}, {w}L)) div {w}L"
    own = reduce(lambda rest, n: F.when(F.col("_level") == n, F.expr(f"sequence({bin_of('_a', width(n))}, {bin_of('(_b - 1)', width(n))})")).otherwise(rest), levels, F.lit(None).cast("array<long>"))
    i = i.withColumn("_bin", F.explode(own))
    places = [F.struct(F.lit(n).alias("_level"), F.expr(bin_of("_t", width(n))).alias("_bin")) for n in levels]
    if not places:
        return p.join(i, keys).select("point", "interval").limit(0)
    p = p.filter("_t IS NOT NULL").withColumn("_x", F.explode(F.array(*places))).select("point", *keys, "_t", "_x._level", "_x._bin")
    return p.join(i, [*keys, "_level", "_bin"]).filter("_a <= _t AND _t < _b").select("point", "interval")
