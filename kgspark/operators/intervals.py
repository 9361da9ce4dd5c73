"""Dense ranks of sorted rows, and joins of intervals with the ranks inside them.

The order is cut into ranges, one task each; a rank is the place in the range plus the rows of earlier ranges.
An interval meets the ranks inside it through a grid: it is repeated once for every grid cell it touches, so the
rows exchanged grow with the hits and not with the number of possible keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

CELL = 256


def with_rank(rows: DataFrame, order: list[str], weight: Column | None = None, name: str = "rank") -> DataFrame:
    """Adds how many rows (or how much weight) come before each row in the order; equal rows in any order."""
    amount = weight if weight is not None else F.lit(1)
    cut = rows.withColumn("_amount", amount.cast("long")).repartitionByRange(*order)
    ranges = stored(cut.withColumn("_range", F.spark_partition_id()), "ranges")
    across = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = ranges.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("_amount").over(inside), F.lit(0))
    local = ranges.withColumn(name, place).join(offsets, "_range")
    return local.withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_amount", "_offset")


def in_intervals(intervals: DataFrame, points: DataFrame, low: str = "low", high: str = "high", at: str = "at") -> DataFrame:
    """Pairs of an interval (low <= at < high) and a point; all columns of both, whose names must differ."""
    last = F.col(high) - 1
    cells = F.sequence(F.floor(F.col(low) / CELL), F.floor(last / CELL))
    wide = intervals.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(cells))
    met = wide.join(points.withColumn("_cell", F.floor(F.col(at) / CELL)), "_cell")
    return met.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")
