"""Connected components by alternating stars, on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties the larger (or the smaller) neighbours of every node to its smallest one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    met = both.join(least, "u")
    tied = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        tied = tied.unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least): for every node that has an edge, the smallest node it is connected with.

    ``edges`` has two columns of one type. A node's neighbours meet in a partial aggregate and a join that
    adaptive execution can split, never in one group; every round is a stored table.
    """
    a, b = edges.columns
    now = stored(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components-0"
    )
    state, round_ = None, 0
    while True:
        round_ += 1
        now = stored(_star(_star(now, large=True), large=False), f"components-{round_}")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct()
            )
        state = seen
