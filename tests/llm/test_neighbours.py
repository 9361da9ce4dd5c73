import numpy as np
from pyspark.sql import functions as F

from kgspark.llm import neighbours, queries

FOLDER = "/root/testdata/sf0.1"


def plain(rows, ask, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for q, x in good:
        if ask(q):
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = [(i, s) for s, i in near[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect()):
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return out


def test_query_finds_nine_of_ten(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want, got = plain(rows, lambda q: q % 100 == 0), found(queries.op9(spark, FOLDER))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    true = {q: dict((i, float(np.sqrt(((np.array(x, float) - np.array(y, float)) ** 2).sum()))) for i, y in rows) for q, x in rows if q in got}
    for q, own in got.items():
        assert all(abs(s - true[q][i]) < 1e-12 for i, s in own)
        assert own == sorted(own, key=lambda r: (r[1], r[0]))


def test_equal_vectors_ties_and_bad_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(0, 60)]
    rows += [(100 + i, draw.normal(0, 1, 3).tolist()) for i in range(30)]
    rows += [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 2.0]), (204, [float("nan"), 1.0, 1.0]), (205, [float("inf"), 1.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(210, [1.0, -0.0, 0.0]), (211, [1.0, 0.0, 0.0]), (300, [1.0, 2.0]), (301, [2.0, 2.0]), (7, [1.0, 2.0, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("key", F.lit(1)).withColumn("class_id", F.lit("x")).repartition(4)
    want = plain(rows, lambda q: q % 10 == 0)
    got = found(neighbours.nearest(frame, F.col("vec_id") % 10 == 0, tables=4, probes=6, block=7))
    assert set(got) == set(want)
    for q in want:
        if q < 60:  # an equal vector is always met
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert len(got[q]) == len(want[q])
    assert got[300] == want[300]


def test_too_few_met_means_all_are_compared(spark):
    rows = [(i, np.eye(16)[i % 16].tolist()) for i in range(16)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    want = plain(rows, lambda q: q == 3)
    got = found(neighbours.nearest(frame, F.col("vec_id") == 3, tables=1, probes=1, block=4))
    assert [i for i, _ in got[3]] == [i for i, _ in want[3]]


def test_empty_table(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, vector array<float>"), F.lit(True)).count() == 0


def test_transform_is_orthogonal():
    x = np.random.default_rng(1).normal(0, 1, (5, 24))
    turned = neighbours.rotated(x, 3)
    assert turned.shape == (5, 32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(turned @ turned.T, unit @ unit.T)
