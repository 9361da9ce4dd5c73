"""Ancestry in trees as intervals: an ancestor test is a range check, and no pairs are stored.

Pointers double: after k rounds each node knows its 2^k-th ancestor, so a chain of n nodes takes log n rounds. The
same rounds give roots, depths and sizes of subtrees: the nodes below v within 2^(k+1) steps are those within 2^k
and what hangs, within 2^k, under the nodes whose 2^k-th ancestor v is. A node's place in pre-order is the sum, up
its path, of the sizes of earlier siblings, which a second doubling adds up. Every table has one row per node; nodes
that have reached their root take no further part in joins. Every round joins by sorting: a broadcast would pass
through the driver, each round again.

Where pointers never end they have run into a cycle. After as many steps as there are nodes they stand on all of
its nodes, which are then contracted to the smallest: it becomes a root, and the others take its place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .intervals import in_intervals
from .ordered import running_sum

ROWS_PER_BLOCK = 100_000


def _pointers(parents: DataFrame) -> DataFrame:
    """(node, parent) with one row for every node; of several parents the smallest counts."""
    known = parents.select("node", "parent").where("node IS NOT NULL")
    one = known.where("parent IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent"))
    nodes = known.select("node").union(known.select("parent").where("parent IS NOT NULL")).distinct()
    return stored(nodes.join(one.hint("merge"), "node", "left"), "tree-pointers")


def _doubled(pointers: DataFrame, n: int) -> DataFrame:
    """(node, above, depth, root, least, size): above is null where the root is known.

    ``least`` is the smallest node on the path so far. Rows whose pointer is still set after so many
    rounds that n steps are passed lead into a cycle.
    """
    isroot = F.col("parent").isNull()
    now = pointers.select(
        "node",
        F.col("parent").alias("above"),
        F.when(isroot, 0).otherwise(1).cast("long").alias("depth"),
        F.when(isroot, F.col("node")).alias("root"),
        F.col("node").alias("least"),
        F.lit(1).cast("long").alias("size"),
    )
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        open_ = now.where("above IS NOT NULL")
        if open_.isEmpty():
            return now
        ahead = now.select(*(F.col(c).alias(f"_{c}") for c in ("node", "above", "depth", "root", "least")))
        moved = open_.join(ahead.hint("merge"), F.col("above") == F.col("_node")).select(
            "node", F.col("_above").alias("above"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_root").alias("root"),
            F.least("least", "_least").alias("least"), "size",
        )
        gained = open_.groupBy(F.col("above").alias("node")).agg(F.sum("size").alias("_gained"))
        grown = now.where("above IS NULL").unionByName(moved).join(gained.hint("merge"), "node", "left")
        now = stored(grown.withColumn("size", F.col("size") + F.coalesce("_gained", F.lit(0))).drop("_gained"), "tree-round")
    return now


def _first_places(pointers: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """(node, first): each node's place in pre-order."""
    bits = max(0, math.ceil(math.log2(max(1, n / ROWS_PER_BLOCK))))
    block = F.shiftright(F.col("_hash"), 64 - bits) if bits else F.lit(0)
    sized = pointers.join(sizes.select("node", "size").hint("merge"), "node").withColumn("_hash", F.xxhash64("node"))
    after = running_sum(sized, ["parent"], ["_hash", "node"], block, F.col("size"), "_after")
    own = F.when(F.col("parent").isNull(), 0).otherwise(1)  # a root has no parent's place before it
    now = stored(after.select("node", F.col("parent").alias("above"), (F.col("_after") - F.col("size") + own).alias("first")), "tree-places")
    while not (open_ := now.where("above IS NOT NULL")).isEmpty():
        ahead = now.select(F.col("node").alias("_node"), F.col("above").alias("_above"), F.col("first").alias("_first"))
        moved = open_.join(ahead.hint("merge"), F.col("above") == F.col("_node")).select(
            "node", F.col("_above").alias("above"), (F.col("first") + F.col("_first")).alias("first")
        )
        now = stored(now.where("above IS NULL").unionByName(moved), "tree-round")
    return now.select("node", "first")


def tree_intervals(parents: DataFrame) -> DataFrame:
    """(node, root, depth, first, last, cycle) for rows (node, parent); a null parent makes no edge.

    a is above or equal to b where ``a.first <= b.first < a.last``. Nodes of a cycle share one place, that of
    the smallest of them, which stands in ``cycle`` (null elsewhere); their depth is 0.
    """
    pointers = _pointers(parents)
    n = pointers.count()
    found = _doubled(pointers, n)
    looping = found.where("above IS NOT NULL")
    if looping.isEmpty():
        members = None
        trees, labels = pointers, found
    else:
        on_cycle = looping.select(F.col("above").alias("node")).distinct()
        members = stored(found.join(on_cycle, "node").select("node", F.col("least").alias("cycle")), "tree-cycles")
        # a parent on a cycle becomes the cycle's smallest node; that node loses its parent, the others go
        to = members.select(F.col("node").alias("parent"), F.col("cycle").alias("_cycle"))
        outside = pointers.join(members, "node", "left_anti").join(to, "parent", "left")
        outside = outside.select("node", F.coalesce("_cycle", "parent").alias("parent"))
        tops = members.select(F.col("cycle").alias("node")).distinct()
        trees = stored(outside.unionByName(tops.withColumn("parent", F.lit(None).cast(pointers.schema["parent"].dataType))), "tree-pointers")
        labels = _doubled(trees, n)
    placed = labels.join(_first_places(trees, labels, n).hint("merge"), "node")
    own = placed.select("node", "root", "depth", "first", (F.col("first") + F.col("size")).alias("last"))
    if members is None:
        return own.withColumn("cycle", F.lit(None).cast(pointers.schema["node"].dataType))
    top = own.withColumnRenamed("node", "cycle")
    shared = members.join(top, "cycle").select("node", "root", "depth", "first", "last", "cycle")
    rest = own.join(members, "node", "left_anti").withColumn("cycle", F.lit(None).cast(pointers.schema["node"].dataType))
    return shared.unionByName(rest)


def below(asked: DataFrame, intervals: DataFrame) -> DataFrame:
    """(ancestor, node) for the asked nodes (column ``node``): everything below each, itself left out.

    Nodes of one cycle are below each other. Pass all nodes to get the closure: only then it is as large.
    """
    wide = asked.select("node").join(intervals.hint("merge"), "node").select(F.col("node").alias("ancestor"), F.col("first").alias("low"), F.col("last").alias("high"))
    points = intervals.select("node", F.col("first").alias("at"))
    return in_intervals(wide, points.hint("merge")).where("ancestor != node").select("ancestor", "node")
