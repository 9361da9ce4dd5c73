import zlib

import numpy as np

from kgspark.llm import quality, queries

FOLDER = "/root/testdata/sf0.1"


def area(y, score):
    order = np.argsort(score, kind="stable")
    place = np.empty(len(score))
    place[order] = np.arange(len(score))
    n = (y == 1).sum()
    return (place[y == 1].sum() - n * (n - 1) / 2) / n / (len(y) - n)


def test_query_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.op7(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    apart = [r for r in rows if r.held_out and r.doc_id in labels]
    y, score = np.array([labels[r.doc_id] for r in apart]), np.array([r.score for r in apart])
    assert area(y, score) > 0.97
    assert np.mean([r.predicted == labels[r.doc_id] for r in apart]) > 0.97


def test_cached_factors_give_the_density_ratio():
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.normal(0, 1, (300, 3)), draw.normal(1, 2, (200, 3))])
    y = np.repeat([0, 1], [300, 200])
    model = quality.discriminant(x, y, 0.0, 0.0)

    def log_density(c):
        own = x[y == c]
        spread = np.cov(own.T, bias=True) + 1e-9 * np.eye(3)
        gap = x - own.mean(0)
        return np.log(len(own) / len(x)) - 0.5 * np.linalg.slogdet(spread)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(spread), gap)

    assert np.allclose(model.difference(x), log_density(1) - log_density(0))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(1, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.judge(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert quality.judge(no_docs, labels).count() == 0
    none = quality.judge(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
