import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kgspark.llm import language_model, queries

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def plain(docs, order, prior):
    """docs: (doc_id, text, training). The recursion itself, on counts of tuples; None is the end, 0 the beginning."""
    counts = Counter()
    for _, text, training in docs:
        if training:
            words = [0, *tokens(text)]
            counts.update(tuple(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1))
    single = {g[0]: c for g, c in counts.items() if len(g) == 1 and g != (0,)}
    total = sum(single.values())

    def p(word, history):
        if not history:
            return (single.get(word, 0) + 1) / (total + len(single) + 1)
        lower = p(word, history[1:])
        return (counts[(*history, word)] + prior * lower) / (counts[history] + prior) if counts[history] else lower

    rows = []
    for doc_id, text, _ in docs:
        words = [0, *tokens(text)]
        base = sum(math.log10(p(w, ())) for w in words[1:])
        score = sum(math.log10(p(words[i], tuple(words[max(0, i - order + 1) : i]))) for i in range(1, len(words)))
        rows.append((doc_id, len(words) - 1, sum(w in single for w in words[1:]), total, base, score))
    return sorted(rows, key=str)


def same(found, wanted):
    found = sorted(map(tuple, found), key=str)
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    for a, b in zip(found, wanted):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_query_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 300_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = queries.op12(spark, FOLDER).collect()
    same([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows], plain([(d, t, not held_out(d)) for d, t in docs], language_model.ORDER, language_model.PRIOR))
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    # the model tells more than single words do, also on texts it has not learnt
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


@pytest.mark.parametrize("order, size", [(1, 10**6), (2, 2_000), (3, 10**6), (4, 500)])
def test_odd_rows_equal_plain(spark, odd_docs, no_docs, monkeypatch, order, size):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", size)
    copies = spark.createDataFrame([(200 + i, "one group of Copies of one text" if i % 3 else f"text {i} of copies") for i in range(60)], "doc_id long, text string")
    docs = odd_docs.unionByName(copies, allowMissingColumns=True)
    training = (F.col("doc_id") % 4 != 3) | F.col("doc_id").isNull()
    rows = [(r.doc_id, r.text, r.t) for r in docs.select("doc_id", "text", training.alias("t")).collect()]
    same(language_model.scores(docs, training, order=order).collect(), plain(rows, order, language_model.PRIOR))
    assert language_model.scores(no_docs, training, order=order).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = language_model.scores(docs, F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 3, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]
