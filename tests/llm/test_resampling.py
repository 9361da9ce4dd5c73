import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import queries, resampling

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def runs(text):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target):
    corpus, wanted = Counter(), Counter()
    for _, text in docs:
        corpus.update(runs(text))
    for text in target:
        wanted.update(runs(text))
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        found = runs(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words_of(text))])
    ranked = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(ranked[: 5 * len(ranked) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def listed(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_equals_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert listed(queries.op13(spark, FOLDER)) == plain(docs, target)


@pytest.mark.parametrize("piece", [None, 50])
def test_odd_rows_equal_plain(spark, odd_docs, no_docs, monkeypatch, piece):
    if piece:
        monkeypatch.setattr(resampling, "PIECE", piece)
    many = spark.createDataFrame([(100 + i // 2, f"{'Wörter und mehr ' * 9} {i // 2 % 7}") for i in range(80)], "doc_id long, text string")
    docs = odd_docs.unionByName(many, allowMissingColumns=True)
    target = spark.createDataFrame([("wörter und",), (None,), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert listed(resampling.resample(docs, target)) == plain(rows, ["wörter und"])
    assert resampling.resample(no_docs, target.limit(0)).count() == 0


def test_prefixes_cancel():
    draw = np.random.default_rng(5)
    for _ in range(200):
        a, b = (bytes(draw.integers(0, 256, draw.integers(0, 300)).astype(np.uint8)) for _ in range(2))
        moved = resampling.shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
        assert zlib.crc32(a + b) ^ int(moved[0]) == zlib.crc32(b)


def test_features_of_words(spark):
    texts = ["", None, "one", "One TWO", "a-b_c9", "漢字 é"]
    for piece in (None, 2):
        found = Counter()
        for document, buckets, _ in resampling.features(texts, piece):
            found.update(zip(document.tolist(), buckets.tolist()))
        assert found == Counter((i, b) for i, t in enumerate(texts) for b in runs(t))
