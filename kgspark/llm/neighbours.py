"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

A unit vector goes through rounds of random signs and a fast Hadamard transform, and into the bucket of
the signed axis nearest to it. A query probes its PROBES nearest axes in each of TABLES tables; what it
meets there is ranked by the true distance of the original vectors, in double precision. Every vector is
in every table. Buckets are cut into blocks of BLOCK vectors by their counted sizes, and a query visits all
blocks of its buckets, so no task holds a bucket that grows with the data. A query that meets fewer vectors
than asked for is compared with all of them, block by block.

Equal vectors fold to one class with its smallest ids: ties go to the smaller id, so the k + 1 smallest ids
of a class are all that any answer can name. Queries with equal vectors are answered once.

Defined results: vectors that are null, empty, all zero, or hold a null or a number that is not finite take
no part, as queries or as candidates, nor do rows with a null id; vectors of different lengths never meet;
repeated rows are candidates each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import stored

from .common import rows_of

TABLES = 12
PROBES = 12
ROUNDS = 3
BLOCK = 8192
SEED = 20
PLACED = "key long, class_id long, vector array<double>"
FOUND = "asker long, class_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Unit vectors, padded to a power of two, after the table's pseudo-rotation."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = x / np.abs(x).max(1, keepdims=True)
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    signs = np.random.default_rng([SEED, table]).choice([-1.0, 1.0], (ROUNDS, width))
    for r in range(ROUNDS):
        out = hadamard(out * signs[r])
    return out


def axes(x: np.ndarray, table: int, count: int) -> np.ndarray:
    """For each vector its ``count`` nearest signed axes, nearest first."""
    turned = rotated(x, table)
    signed = np.concatenate([turned, -turned], 1)
    count = min(count, signed.shape[1])
    return np.argsort(-signed, axis=1, kind="stable")[:, :count]


def valid(vector: str) -> Column:
    v = F.col(vector)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def place(tables: int, probes: int):
    """Each vector's keys: one for each table and probed axis; the length of the vector is part of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 1024):
                widths = np.array([len(v) for v in part.column(1)], np.int64)
                for width in np.unique(widths).tolist():
                    rows = np.flatnonzero(widths == width)
                    own = part.take(pa.array(rows))
                    x = np.array(own.column(1).to_pylist(), np.float64)
                    for t in range(tables):
                        near = axes(x, t, probes)
                        for p in range(near.shape[1]):
                            key = (width * tables + t) * (1 << 21) + near[:, p]
                            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), own.column(0), own.column(1)], names=["key", "class_id", "vector"])

    return run


def rank_in_block(k: int):
    def run(askers: pa.Table, others: pa.Table) -> pa.Table:
        out_a, out_c, out_s = [], [], []
        if askers.num_rows and others.num_rows:
            ids = others.column("class_id").to_numpy()
            x = np.array(others.column("vector").to_pylist(), np.float64)
            for asker, vector in zip(askers.column("class_id").to_pylist(), askers.column("vector").to_pylist()):
                away = np.sqrt(((x - np.array(vector, np.float64)) ** 2).sum(1))
                if len(away) > k:
                    near = np.flatnonzero(away <= np.partition(away, k - 1)[k - 1])
                else:
                    near = np.arange(len(away))
                near = near[np.lexsort((ids[near], away[near]))][:k]
                out_a.append(np.full(len(near), asker)), out_c.append(ids[near]), out_s.append(away[near])
        flat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"asker": flat(out_a, np.int64), "class_id": flat(out_c, np.int64), "score": flat(out_s, np.float64)})

    return run


def nearest(vectors: DataFrame, asks: Column, k: int = 10, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row where ``asks`` holds.

    ``vectors`` has vec_id and vector. The driver learns one count for each bucket: tables times axes.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), asks.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & valid("vector")).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    smallest = W.partitionBy("vector").orderBy("vec_id")
    first = rows.select("vector", "vec_id").withColumn("no", F.row_number().over(smallest)).where(F.col("no") <= k + 1)
    classes = stored(
        first.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.array_sort(F.collect_list("vec_id")).alias("members")), "neighbour-classes"
    )
    queries = stored(rows.where("asks").select(F.col("vec_id").alias("query_id"), "vector").join(classes.select("vector", "class_id"), "vector").select("query_id", "class_id"), "neighbour-queries")
    askers = classes.select("class_id", "vector").join(queries.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "vector")
    own = stored(classes.select("class_id", "vector").mapInArrow(place(tables, 1), PLACED), "neighbour-index")
    asked = askers.mapInArrow(place(tables, probes), PLACED)
    sizes = {r["key"]: -(-r["count"] // block) for r in own.groupBy("key").count().collect()}  # tables times axes
    parts = lambda: F.broadcast(spark.createDataFrame(list(sizes.items()) or [(0, 1)], "key long, parts int"))
    block_of = F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")
    salted = own.join(parts(), "key").select("key", "class_id", "vector", block_of.alias("part"))
    visits = asked.join(parts(), "key").select("key", "class_id", "vector", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = visits.groupBy("key", "part").cogroup(salted.groupBy("key", "part"))
    found = stored(met.applyInArrow(rank_in_block(k + 1), FOUND).groupBy("asker", "class_id").agg(F.min("score").alias("score")), "neighbour-found")
    members = classes.select("class_id", "members")
    enough = found.join(members, "class_id").groupBy("asker").agg(F.sum(F.size("members")).alias("n")).where(F.col("n") > k).select("asker")
    few = stored(askers.join(enough, F.col("class_id") == F.col("asker"), "left_anti"), "neighbour-few")
    if not few.isEmpty():
        all_parts = max(1, -(-classes.count() // block))
        width = F.size("vector").cast("long").alias("key")
        every = classes.select(width, "class_id", "vector", F.pmod(F.xxhash64("class_id"), F.lit(all_parts)).cast("int").alias("part"))
        each = few.select(width, "class_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(all_parts - 1))).alias("part"))
        exact = each.groupBy("key", "part").cogroup(every.groupBy("key", "part")).applyInArrow(rank_in_block(k + 1), FOUND)
        found = found.join(few.select(F.col("class_id").alias("asker")), "asker", "left_anti").select("asker", "class_id", "score").unionByName(exact)
    best = W.partitionBy("asker").orderBy("score", "class_id")
    kept = found.withColumn("no", F.row_number().over(best)).where(F.col("no") <= k + 1).join(members, "class_id")
    near = kept.select("asker", "score", F.explode("members").alias("vec_id"))
    line = W.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = queries.join(near, F.col("class_id") == F.col("asker")).where(F.col("vec_id") != F.col("query_id"))
    return pairs.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
