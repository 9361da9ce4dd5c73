"""Small helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCKS = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered(frame: DataFrame, group: list[str], weight: str | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Adds ``pos``, the row's place in its group from 0, and ``start``, the sum of ``weight`` before it.

    The order is pseudorandom (a hash of the row) and repeatable; equal rows lie side by side. A group
    is cut into ``blocks`` by that hash: one small row per block carries counts and sums across, so a
    group that holds a third of all rows is still worked on by up to ``blocks`` tasks. Give a frame
    that is cheap to read twice, such as a stored one.
    """
    names = frame.columns
    amount = F.col(weight) if weight else F.lit(0).cast("long")
    cut = frame.withColumn("_hash", F.xxhash64(*names)).withColumn("_block", F.pmod(F.col("_hash"), F.lit(blocks)).cast("int"))
    keys = [*group, "_block"]
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks_before = (
        cut.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_w"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_pos"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy(*keys).orderBy("_hash", *names)
    rows = cut.withColumn("_place", F.row_number().over(inside) - 1).withColumn(
        "_sum", F.coalesce(F.sum(amount).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    same = [rows[k].eqNullSafe(blocks_before[k]) for k in keys]
    joined = rows.join(blocks_before, same, "inner")
    return joined.select(
        *(rows[n] for n in names),
        (F.col("_pos") + F.col("_place")).cast("long").alias("pos"),
        (F.col("_start") + F.col("_sum")).cast("long").alias("start"),
    )


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash."""
    return docs.select(*names)


def rows_of(batch: pa.RecordBatch, size: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in slices, so that what is made of a slice stays small."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(parts: Iterable[np.ndarray], dtype=np.int64) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def text_bytes(column: str = "text") -> Column:
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")
