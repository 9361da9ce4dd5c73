import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kgspark.llm import quality_rules, queries

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    again = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeat), failed


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query_counts_and_verdicts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op10(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert base(r) == plain(docs[r.doc_id])
        assert not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r.kept for r in rows if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.3


def test_repeated_words():
    draw = np.random.default_rng(4)
    for _ in range(200):
        words = [str(x) for x in draw.integers(0, 3, draw.integers(0, 14))]
        assert quality_rules.repeated_words(words) == plain(" ".join(words))[4]


def test_divergence():
    p, q = np.array([1.0, 0, 0]), np.array([0, 2.0, 2.0])
    assert quality_rules.divergence(p, p) == 0 and abs(quality_rules.divergence(p, q) - 1) < 1e-12
    m = (np.array([0.5, 0.5, 0]) + np.array([1.0, 0, 0])) / 2
    want = (0.5 * np.log2(0.5 / m[0]) + 0.5 * np.log2(0.5 / m[1]) + np.log2(1 / m[0])) / 2
    assert abs(quality_rules.divergence(np.array([3.0, 3, 0]), np.array([9.0, 0, 0])) - want**0.5) < 1e-12


def test_references_count_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    usual = quality_rules.references(docs)
    rows = docs.collect()
    assert set(usual) == {r.lang for r in rows}
    for lang, (classes, place, counts) in usual.items():
        words = Counter(quality_rules.bare(w) for r in rows if r.lang == lang for w in WORD.findall(r.text))
        total = sum(words.values())
        words.pop("", None)
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON]
        assert {w: counts[i] for w, i in place.items()} == dict(top) and counts.sum() == total
        assert classes.tolist() == sum(quality_rules.class_counts(r.text) for r in rows if r.lang == lang).tolist()


def test_odd_rows(spark, odd_docs, no_docs):
    usual = quality_rules.references(odd_docs)
    rows = quality_rules.judged(odd_docs, usual).collect()
    texts = Counter((r.doc_id, *plain(r.text)) for r in odd_docs.collect())
    assert Counter((r.doc_id, *base(r)) for r in rows) == texts
    assert quality_rules.judged(no_docs, usual).count() == 0
    assert quality_rules.references(no_docs) == {}
    bare = quality_rules.judged(odd_docs, {})
    assert bare.where(F.col("class_divergence").isNotNull()).count() == 0 and bare.where("kept = base_failed").count() == 0
