import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kgspark.llm import queries, resharding

FOLDER = "/root/testdata/sf0.001"


def fewest_moved(old, new):
    """What a shard cannot keep has to move, and nothing else."""
    return sum(max(0, size - (new[i] if i < len(new) else 0)) for i, size in enumerate(old))


def test_flow_moves_the_fewest_bytes():
    draw = random.Random(5)
    for _ in range(60):
        old = [draw.randrange(0, 90) for _ in range(draw.randrange(1, 7))]
        new = resharding.even(sum(old) + draw.randrange(0, 20), draw.randrange(1, 7))
        moves = resharding.transfers(old, new)
        out, into = Counter(), Counter()
        for i, j, n in moves:
            assert n > 0
            out[i] += n
            into[j] += n
        assert [out[i] for i in range(len(old))] == old
        assert all(into[j] <= new[j] for j in range(len(new)))
        assert sum(n for i, j, n in moves if i != j) == fewest_moved(old, new)


def check(rows, expected, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(expected)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    total, largest = sum(sizes.values()), max(x[1] for x in expected)
    for j in range(shards):
        assert abs(sizes[j] - total / shards) <= largest


def expected_of(rows):
    return [(r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows]


def test_query_deals_every_document(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = queries.op1(spark, FOLDER).collect()
    check(rows, expected_of(docs), 24)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert sorted(rows) == sorted(queries.op1(spark, FOLDER).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("home", F.when(F.col("doc_id") > 4, "b").when(F.col("doc_id") > 2, "a"))
    plan = resharding.reshard(resharding.shard_rows(docs, "home"), 3)
    rows = [r for r in plan.rows.collect()]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows) == sorted(expected_of(docs.collect()))
    assert resharding.reshard(resharding.shard_rows(no_docs, "source"), 3).rows.collect() == []


def test_rewrite_touches_only_affected_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 92, "ab"[i % 2]) for i in range(40)] + [(99, "t" * 92, "a"), (99, "t" * 92, "a")], "doc_id long, text string, home string")
    plan = resharding.reshard(resharding.shard_rows(docs, "home"), 3, capacities=[1600, 2000, 600])
    assert plan.affected == [0, 2]  # the second shard keeps what it has
    resharding.rewrite(docs, plan, str(tmp_path / "shards"))
    found = spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("s")).collect()
    assert sorted((r.shard, r.n, r.s) for r in found) == [(0, 16, 16), (2, 6, 6)]
