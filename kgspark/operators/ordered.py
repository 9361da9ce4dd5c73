"""Ordered scans over groups that may be too large for one task.

A window over a group sorts the whole group in one task, which fails when one stream holds a
third of all rows. Here the order of a group is cut into blocks: a column that never falls as
the order rises, such as ``turn div 100000`` or the hour of a timestamp. Windows run inside
(group, block); a second, small scan over one row per block carries sums and last values
across. The result is exact for every choice of blocks; they should be fine enough that the
rows of the largest group in one block fit a task, and no finer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_GROUP, _BLOCK = "_group", "_block_no"


def _blocked(rows: DataFrame, keys: list[str], block: Column) -> DataFrame:
    # as structures, keys and blocks that are null compare equal in joins too
    return rows.withColumn(_GROUP, F.struct(*keys)).withColumn(_BLOCK, F.struct(block.alias("no")))


def _inside(order: list[str]) -> Window:
    return Window.partitionBy(_GROUP, _BLOCK).orderBy(*order)


def _across() -> Window:
    return Window.partitionBy(_GROUP).orderBy(_BLOCK)


def _so_far(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(rows: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, name: str, most: int | None = None):
    """Add the sum of ``value`` over the group up to and including each row.

    With ``most``, rows of blocks whose sum begins above it are left out before they are sorted.
    """
    blocked = _blocked(rows, keys, block).withColumn("_value", value)
    totals = blocked.groupBy(_GROUP, _BLOCK).agg(F.sum("_value").alias("_total"))
    offsets = totals.select(
        _GROUP, _BLOCK, F.coalesce(F.sum("_total").over(_earlier(_across())), F.lit(0)).alias("_offset")
    )
    if most is not None:
        offsets = offsets.filter(F.col("_offset") <= most)
        blocked = blocked.join(offsets.select(_GROUP, _BLOCK), [_GROUP, _BLOCK], "left_semi")
    local = blocked.withColumn(name, F.coalesce(F.sum("_value").over(_so_far(_inside(order))), F.lit(0)))
    total = F.col(name) + F.col("_offset")
    return local.join(offsets, [_GROUP, _BLOCK]).withColumn(name, total).drop(_GROUP, _BLOCK, "_value", "_offset")


def previous(rows: DataFrame, keys: list[str], order: list[str], block: Column, value: str, name: str):
    """Add, as a one-field structure, the value of the row before in the group; null on the first row."""
    blocked = _blocked(rows, keys, block)
    held = F.struct(F.col(value).alias("value"))
    lasts = blocked.groupBy(_GROUP, _BLOCK).agg(F.max_by(held, F.struct(*order)).alias("_last"))
    before = lasts.select(_GROUP, _BLOCK, F.lag("_last").over(_across()).alias("_before"))
    local = blocked.withColumn(name, F.lag(held).over(_inside(order)))
    found = F.coalesce(F.col(name), F.col("_before"))
    return local.join(before, [_GROUP, _BLOCK]).withColumn(name, found).drop(_GROUP, _BLOCK, "_before")


def islands(rows: DataFrame, keys: list[str], order: list[str], block: Column, value: str, name: str):
    """Number the runs of equal ``value`` in each group, from 1."""
    blocked = _blocked(rows, keys, block)
    held = F.struct(F.col(value).alias("value"))
    before = F.lag(held).over(_inside(order))
    changed = F.when(before.isNotNull() & ~before.eqNullSafe(held), 1).otherwise(0)
    local = blocked.withColumn("_changed", changed).withColumn(
        name, F.sum("_changed").over(_so_far(_inside(order)))
    )
    blocks = local.groupBy(_GROUP, _BLOCK).agg(
        F.min_by(held, F.struct(*order)).alias("_first"),
        F.max_by(held, F.struct(*order)).alias("_last"),
        F.sum("_changed").alias("_inside"),
    )
    # a block opens a run of its own unless it starts as the block before ended
    joins = F.lag("_last").over(_across()).eqNullSafe(F.col("_first"))
    opened = blocks.withColumn("_opens", F.when(joins, 0).otherwise(1))
    offsets = opened.select(
        _GROUP,
        _BLOCK,
        (
            F.coalesce(F.sum(F.col("_inside") + F.col("_opens")).over(_earlier(_across())), F.lit(0))
            + F.col("_opens")
        ).alias("_offset"),
    )
    number = F.col(name) + F.col("_offset")
    return local.join(offsets, [_GROUP, _BLOCK]).withColumn(name, number).drop(_GROUP, _BLOCK, "_changed", "_offset")


def drop_repeats(rows: DataFrame, keys: list[str], order: list[str], block: Column, value: str) -> DataFrame:
    """Leave out rows whose value equals that of the row before in the group."""
    found = previous(rows, keys, order, block, value, "_previous")
    same = F.col("_previous").isNotNull() & F.col("_previous.value").eqNullSafe(F.col(value))
    return found.filter(~same).drop("_previous")


def last_rows(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group.

    The rank filter lets Spark cut every group to n rows per task before the shuffle.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")
