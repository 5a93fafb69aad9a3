"""Operators on time series (key, t, value) and intervals (key, start, stop): runs, crossings, passes, coalescing, as-of.

Times are whole numbers (hours or seconds). Every window is partitioned by the key, so a
task holds one key's series at a time and keys spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.sources.tables import sized_broadcast

#: Cells that are filled up at once.
FILLED = 64


def reduced(cube: DataFrame, key: str = "cell") -> DataFrame:
    """Minimum, maximum, mean and population deviation over time; nodata is ignored."""
    return cube.groupBy(key).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def time_axes(series: DataFrame, step: int, key: str = "cell", t: str = "t", most: int = 1_000_000) -> DataFrame:
    """key and t: each series' times from its first to its last, every `step`; over `most` of them are an error."""
    if step <= 0:
        raise ValueError(f"a step of {step} leads nowhere")
    ends = series.groupBy(key).agg(F.min(t).alias("_a"), F.max(t).alias("_b")).where("_a is not null")
    times = F.when((F.col("_b") - F.col("_a")) / step < most, F.sequence("_a", "_b", F.lit(step).cast("long"))).otherwise(F.raise_error(F.lit(f"a series has over {most} times")))
    return ends.select(key, F.explode(times).alias(t))


def filled(series: DataFrame) -> DataFrame:
    """cell, t and value of every cell at every whole t from the first to the last of all, NULL where series (cell, t, value; a row a cell and t) has none.

    A cell's rows are packed and filled up in one task: only rows that are there are shuffled.
    """
    span = series.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    a, n = (0, 0) if span.a is None else (span.a, span.b - span.a + 1)
    row = F.when(F.col("t").isNotNull() & F.col("cell").isNotNull(), F.struct(F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value")))
    packed = series.groupBy("cell").agg(F.collect_list(row).alias("x"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), FILLED):
                some = batch.slice(at, FILLED)
                size, x = some.column("x").value_lengths().to_numpy(), some.column("x").flatten()
                place = np.repeat(np.arange(len(some)), size) * n + x.field("t").to_numpy() - a
                source = np.full(len(some) * n, -1)
                source[place] = np.arange(len(x))
                value = x.field("value").take(pa.array(source, mask=source < 0))
                cell = some.column("cell").take(pa.array(np.repeat(np.arange(len(some)), n)))
                yield pa.RecordBatch.from_arrays([cell, pa.array(np.tile(np.arange(a, a + n), len(some))), value], names=["cell", "t", "value"])

    return packed.mapInArrow(fill, f"cell {series.schema['cell'].dataType.simpleString()}, t long, value double")


def runs(series: DataFrame, flag: Column, key: str = "cell", t: str = "t") -> DataFrame:
    """Maximal runs of rows where flag holds: key, first, last and n rows. A NULL flag ends a run."""
    own, same = Window.partitionBy(key).orderBy(t), Window.partitionBy(key, "_f").orderBy(t)
    s = series.select(key, F.col(t).alias("_t"), F.coalesce(flag, F.lit(False)).alias("_f"))
    own, same = Window.partitionBy(key).orderBy("_t"), Window.partitionBy(key, "_f").orderBy("_t")
    s = s.withColumn("_g", F.row_number().over(own) - F.row_number().over(same)).where("_f")
    return s.groupBy(key, "_g").agg(F.min("_t").alias("first"), F.max("_t").alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def longest_run(series: DataFrame, flag: Column, step: float = 1.0, key: str = "cell", t: str = "t") -> DataFrame:
    """Every key with `duration`, its longest run times step; 0 without one."""
    best = runs(series, flag, key, t).groupBy(key).agg(F.max("n").alias("_n"))
    return series.select(key).distinct().join(best, key, "left").select(key, (F.coalesce("_n", F.lit(0)) * step).alias("duration"))


def total_duration(series: DataFrame, flag: Column, step: float = 1.0, key: str = "cell") -> DataFrame:
    return series.groupBy(key).agg(F.coalesce(F.sum(F.when(flag, step)), F.lit(0.0)).alias("duration"))


def local_minima(series: DataFrame, key: str = "cell", t: str = "t") -> DataFrame:
    """Interior rows below the row before and not above the row after."""
    w = Window.partitionBy(key).orderBy(t)
    s = series.withColumns({"_b": F.lag("value").over(w), "_a": F.lead("value").over(w)})
    return s.where("_b > value and value <= _a").drop("_b", "_a")


def crossings(series: DataFrame, threshold: float, key: str = "cell", t: str = "t") -> DataFrame:
    """Where the series reaches or leaves threshold: key, before, after, rising and `at`, by linear interpolation."""
    w = Window.partitionBy(key).orderBy(t)
    s = series.where("value is not null").withColumns({"_v": F.lag("value").over(w), "_t": F.lag(t).over(w)})
    s = s.where((F.col("_v") >= threshold) != (F.col("value") >= threshold))
    at = F.col("_t") + (threshold - F.col("_v")) / (F.col("value") - F.col("_v")) * (F.col(t) - F.col("_t"))
    return s.select(key, F.col("_t").alias("before"), F.col(t).alias("after"), (F.col("value") >= threshold).alias("rising"), at.alias("at"))


def passes(series: DataFrame, threshold: float, key: str = "cell", t: str = "t") -> DataFrame:
    """Runs at or above threshold that begin after a row below it and end before another: key, start, stop."""
    have = series.where("value is not null")
    ends = have.groupBy(key).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    r = runs(have, F.col("value") >= threshold, key, t)
    return r.join(ends, key).where("first > _a and last < _b").select(key, F.col("first").alias("start"), F.col("last").alias("stop"))


def coalesced(intervals: DataFrame, key: str) -> DataFrame:
    """Union of each key's closed intervals; touching ones merge."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = intervals.withColumn("_n", F.when(before >= F.col("start"), 0).otherwise(1))
    s = s.withColumn("_n", F.sum("_n").over(w))
    return s.groupBy(key, "_n").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_n")


def gaps(intervals: DataFrame, key: str) -> DataFrame:
    """The times between a key's coalesced intervals."""
    w = Window.partitionBy(key).orderBy("start")
    return coalesced(intervals, key).select(key, F.col("stop").alias("start"), F.lead("start").over(w).alias("stop")).where("stop is not null")


def as_of(left: DataFrame, right: DataFrame, key: str, t: str = "t", value: str = "value") -> DataFrame:
    """left with the value of right's latest row at or before t, NULL before the first: a union and one window, no range join."""
    both = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_o")).unionByName(
        right.select(key, t, F.col(value).alias("_v"), F.lit(0).alias("_o")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(t, "_o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_o = 1").drop("_v", "_o")


def lowest_windows(series: DataFrame, threshold: float, limit: float, key: str = "cell", t: str = "t") -> DataFrame:
    """For each run below threshold, the longest run of values over `limit` in it (half-open at its end): key, first, last, duration."""
    low = runs(series.where("value is not null"), F.col("value") < threshold, key, t).withColumn("event", F.col("first"))
    inside = series.join(low.select(key, "event", "first", "last"), key).where((F.col(t) >= F.col("first")) & (F.col(t) < F.col("last")))
    best = runs(inside.withColumn("_k", F.struct(key, "event")), F.col("value") > limit, "_k", t).groupBy("_k").agg(F.max("n").alias("_n"))
    best = best.select(F.col(f"_k.{key}").alias(key), F.col("_k.event").alias("event"), "_n")
    hours = F.least(F.coalesce("_n", F.lit(0)), F.lit(255)).cast("int")
    return low.join(best, [key, "event"], "left").select(key, "first", "last", hours.alias("duration"))


def light_curves(series: DataFrame, lists: DataFrame, reducers: dict[str, Callable[[Column], Column]], key: str = "cell", t: str = "t") -> DataFrame:
    """key, list and a column a reducer: each takes the array of a series' values at a list's times, in their order.

    lists: list, t (a time of several lists counts in each; repeated ones once). Series are read once for all lists;
    times without a row or without a value are not in the arrays, and a list that a series has none of gives no row.
    """
    times = lists.select("list", F.col("t").alias(t)).distinct()
    met = series.where("value is not null").select(key, t, "value").join(sized_broadcast(times, times.count()), t)
    packed = met.groupBy(key, "list").agg(F.sort_array(F.collect_list(F.struct(t, "value"))).alias("_x"))
    return packed.select(key, "list", *[f(F.transform("_x", lambda x: x["value"])).alias(name) for name, f in reducers.items()])


def share_above(threshold: float) -> Callable[[Column], Column]:
    """Share of an array's values that are at or above threshold."""
    return lambda v: F.size(F.filter(v, lambda x: x >= threshold)) / F.size(v)


def longest_above(threshold: float) -> Callable[[Column], Column]:
    """The longest run of an array's values at or above threshold."""

    def of(v: Column) -> Column:
        start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

        def step(s: Column, x: Column) -> Column:
            now = F.when(x >= threshold, s["now"] + 1).otherwise(0)
            return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

        return F.aggregate(v, start, step)["best"]

    return of


def largest_step(v: Column) -> Column:
    """The largest difference between neighbours of an array; 0 of a single value."""
    pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v)), lambda a, b: F.abs(b - a))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))
