"""Runs of stages, and joins of events and samples to intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bouts(epochs: DataFrame, member: Column, keys: list[str], index: str = "epoch_idx", epoch_sec: float = 30.0, min_sec: float = 200.0) -> DataFrame:
    """Longest runs of member epochs that last at least ``min_sec``: keys, bout_idx, first, last, epochs, start, stop."""
    order = Window.partitionBy(*keys).orderBy(index)
    island = epochs.filter(member).select(*keys, index, (F.col(index) - F.row_number().over(order)).alias("_island"))
    runs = island.groupBy(*keys, "_island").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("epochs"))
    runs = runs.filter(F.col("epochs") * epoch_sec >= min_sec)
    numbered = runs.withColumn("bout_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1)
    return numbered.select(*keys, "bout_idx", "first", "last", "epochs", (F.col("first") * epoch_sec).alias("start"), ((F.col("last") + 1) * epoch_sec).alias("stop"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Each point with the disjoint interval that holds it, start <= at < stop.

    Intervals and points are laid in one sequence for each key, and a point takes the last interval that
    started: one sort, no product of points and intervals.
    """
    rest = [c for c in intervals.columns if c not in keys]
    left = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(intervals.select(F.struct(*rest).alias("s")).schema["s"].dataType).alias("_interval"))
    right = intervals.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_point"].dataType).alias("_point"), F.struct(*rest).alias("_interval"))
    order = Window.partitionBy(*keys).orderBy("_at", "_kind")
    laid = left.unionByName(right).withColumn("_in", F.last("_interval", ignorenulls=True).over(order))
    held = laid.filter((F.col("_kind") == 1) & (F.col("_at") < F.col(f"_in.{stop}")))
    return held.select("_point.*", *(F.col(f"_in.{c}").alias(c) for c in rest if c not in points.columns))


def intervals_with_points(intervals: DataFrame, points: DataFrame, keys: list[str], at: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """The intervals that hold a point, with ``n_points``."""
    counted = points_in_intervals(points, intervals, keys, at, start, stop).groupBy(*keys, start).agg(F.count("*").alias("n_points"))
    return intervals.join(counted, [*keys, start])


def overlapping(events: DataFrame, lo: float, hi: float, start: str = "start", stop: str = "stop") -> DataFrame:
    """Events that overlap a window: start < hi and stop > lo."""
    return events.filter((F.col(start) < hi) & (F.col(stop) > lo))


def event_times(events: DataFrame, mark: str = "peak", channel: str | None = None) -> DataFrame:
    """Adds ``time``: each event's mark (peak, start or stop), its start where there is no such column; of one channel if it is named."""
    name = mark if mark in events.columns else "start"
    if name not in events.columns:
        raise KeyError(f"events have neither {mark} nor start")
    if channel is not None and "channel" in events.columns:
        events = events.filter(F.col("channel").cast("string") == channel)
    return events.withColumn("time", F.col(name).cast("double"))


def interpolate_at(points: DataFrame, series: DataFrame, keys: list[str], at: str, t: str, value: str, out: str = "interpolated") -> DataFrame:
    """The series' value at each point by linear interpolation; beyond its ends the end values.

    Both are laid in one sequence, and each point sees the last sample at or before it and the first after it.
    """
    left = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"), F.lit(None).cast("struct<t:double,v:double>").alias("_s"))
    right = series.select(*keys, F.col(t).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_point"].dataType).alias("_point"), F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("_s"))
    order = Window.partitionBy(*keys).orderBy("_at", "_kind")
    laid = left.unionByName(right)
    laid = laid.withColumn("_a", F.last("_s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("_b", F.first("_s", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    a, b, x = F.col("_a"), F.col("_b"), F.col("_at").cast("double")
    lerp = a["v"] + (b["v"] - a["v"]) * (x - a["t"]) / (b["t"] - a["t"])
    return laid.filter("_kind = 1").select("_point.*", F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == x), a["v"]).otherwise(lerp).alias(out))


def phase_bins(series: DataFrame, keys: list[str], t: str, value: str, low: float = 25.0, high: float = 100.0) -> DataFrame:
    """Each key's first cycle from one falling zero crossing of the z-score to the next whose period lies in [low, high].

    Crossings are placed between samples by interpolation; the rising crossing between them cuts the cycle in
    two half-waves of four equal bins: keys, begin, rise, finish, edges (nine times).
    """
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(t)
    z = series.withColumn("_z", (F.col(value) - F.avg(value).over(whole)) / F.stddev_pop(value).over(whole))
    z = z.withColumn("_next", F.lead("_z").over(order)).withColumn("_t2", F.lead(t).over(order))
    sign = F.when((F.col("_z") >= 0) & (F.col("_next") < 0), -1).when((F.col("_z") < 0) & (F.col("_next") >= 0), 1)
    cross = z.withColumn("_sign", sign).filter("_sign is not null").select(*keys, "_sign", (F.col(t) + F.col("_z") / (F.col("_z") - F.col("_next")) * (F.col("_t2") - F.col(t))).alias("_x"))
    by = whole.orderBy("_x")
    cycle = cross.withColumn("rise", F.lead("_x").over(by)).withColumn("finish", F.lead("_x", 2).over(by)).filter("_sign = -1")
    cycle = cycle.filter((F.col("finish") - F.col("_x")).between(low, high))
    first = cycle.groupBy(*keys).agg(F.min(F.struct(F.col("_x").alias("begin"), "rise", "finish")).alias("c")).select(*keys, "c.*")
    fall = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("begin") + (F.col("rise") - F.col("begin")) * i / 4)
    lift = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("rise") + (F.col("finish") - F.col("rise")) * i / 4)
    return first.withColumn("edges", F.concat(fall, lift))


def extrema(series: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Local peaks and troughs; a plateau counts at its first sample."""
    order = Window.partitionBy(*keys).orderBy(t)
    moved = series.withColumn("_p", F.lag(value).over(order)).filter(F.col("_p").isNull() | (F.col("_p") != F.col(value)))
    moved = moved.drop("_p").withColumn("_p", F.lag(value).over(order)).withColumn("_n", F.lead(value).over(order))
    kind = F.when((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n")), "peak").when((F.col(value) < F.col("_p")) & (F.col(value) < F.col("_n")), "trough")
    return moved.withColumn("kind", kind).filter("kind is not null").select(*keys, t, value, "kind")
