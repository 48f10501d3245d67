"""Places and running sums in a global order, without bringing the rows to one task.

Rows are sorted by ranges; within a partition a window counts on, and what lies
before a partition comes from a table with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.shared import written


def _ranged(rows: DataFrame, order: list) -> DataFrame:
    return written(rows.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "sorted")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place in an order, from 0."""
    spread = _ranged(rows, order)
    start = spread.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = start.select("__p", (before - F.col("first")).alias("__s"))
    return spread.join(F.broadcast(start), "__p").withColumn(name, F.col("__i") + F.col("__s")).drop("__p", "__i", "__s")


def running_sums(rows: DataFrame, order: list, values: list[str], suffix: str = "_before") -> DataFrame:
    """``rows`` with, for each of ``values`` (whole numbers), its sum over all earlier rows of an order."""
    spread = _ranged(rows, order)
    totals = spread.groupBy("__p").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__p", *[F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    own = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    inside = spread.select("*", *[F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"__own_{v}") for v in values])
    done = inside.join(F.broadcast(totals), "__p")
    return done.select(*rows.columns, *[(F.col(f"__own_{v}") + F.col(f"__{v}")).alias(v + suffix) for v in values])
