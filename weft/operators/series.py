"""Ordered operators: rolling means, smoothing, bins, cumulative counts, arrival novelty.

Every window is partitioned by a series key; a series without one (a whole
training history) is first cut down to one row per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(df: DataFrame, by: list[str], order: str, value: str, width: int) -> DataFrame:
    """Centred mean over ``width`` rows, fewer at the ends; an even width has one row more before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn("rolling", F.avg(value).over(w))


def smoothed(df: DataFrame, by: list[str], order: str, value: str, span: int) -> DataFrame:
    """Exponential smoothing from the first value; one row per series with the arrays of steps and values.

    The fold runs over a series' own array, so a series must fit a row.
    """
    a = 2.0 / (span + 1)
    s = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"))
    fold = F.aggregate(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), F.array(F.col("s")[0].v), lambda acc, x: F.concat(acc, F.array((1 - a) * F.element_at(acc, -1) + a * x.v)))
    return s.select(*by, F.transform("s", lambda x: x.o).alias("steps"), fold.alias("ema"))


def step_bins(df: DataFrame, by: list[str], step: str, value: str, width: int) -> DataFrame:
    """Bins of ``width`` steps from step 1: mean, deviation (ddof 1, 0 for one row), standard error, n, last step of the bin."""
    b = F.floor((F.greatest(F.col(step), F.lit(1)) - 1) / width)
    g = df.groupBy(*by, b.alias("bin")).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))
    return g.withColumns({"sem": F.col("std") / F.sqrt("n"), "x": (F.col("bin") + 1) * width})


def first_last(df: DataFrame, by: list[str], step: str, value: str, width: int) -> DataFrame:
    """Means of the first and last ``width`` steps, and their change."""
    ends = df.groupBy(*by).agg(F.min(step).alias("lo"), F.max(step).alias("hi"))
    x = df.join(ends, by)
    g = x.groupBy(*by).agg(F.avg(F.when(F.col(step) < F.col("lo") + width, F.col(value))).alias("first"), F.avg(F.when(F.col(step) > F.col("hi") - width, F.col(value))).alias("last"))
    return g.withColumns({"change": F.col("last") - F.col("first"), "percent": 100 * (F.col("last") - F.col("first")) / F.abs(F.nullif("first", F.lit(0.0)))})


def cumulative(df: DataFrame, step: str, spine: DataFrame) -> DataFrame:
    """Running node and edge counts on a spine of steps; ``df`` has step, nodes, edges."""
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)  # a row per step
    x = spine.join(df, step, "left").na.fill(0)
    out = x.select(step, F.sum("nodes").over(w).alias("nodes"), F.sum("edges").over(w).alias("edges"))
    return out.withColumn("avg_degree", F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0))


def percentile_rank(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Place in the sorted group over its size."""
    w = Window.partitionBy(*by)
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order)) / F.count("*").over(w))


def interpolate(points: DataFrame, at: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """y at every x of ``at``, linear between the neighbouring points and constant beyond them."""
    both = points.select(*by, F.col(x), F.col(y), F.lit(0).alias("ask")).unionByName(at.select(*by, F.col(x), F.lit(None).cast("double").alias(y), F.lit(1).alias("ask")))
    w = Window.partitionBy(*by).orderBy(x, "ask")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("ask") == 0, F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    z = both.withColumns({"l": F.last(known, True).over(back), "h": F.first(known, True).over(ahead)}).where("ask = 1")
    gap = F.col("h.x") - F.col("l.x")
    mixed = F.col("l.y") + (F.col("h.y") - F.col("l.y")) * (F.col(x) - F.col("l.x")) / F.nullif(gap, F.lit(0.0))
    return z.select(*by, x, F.coalesce(mixed, "l.y", "h.y").alias(y))


def stop_index(df: DataFrame, by: list[str], order: str, new: str, window: int, least: float) -> DataFrame:
    """First step at which the last ``window`` steps brought fewer than ``least * window`` new nodes."""
    w = Window.partitionBy(*by).orderBy(order)
    x = df.withColumns({"s": F.sum(new).over(w.rowsBetween(-(window - 1), 0)), "i": F.row_number().over(w)})
    return x.groupBy(*by).agg(F.min(F.when((F.col("i") >= window) & (F.col("s") < least * window), F.col(order))).alias("stop_at"), F.count("*").alias("steps"))
