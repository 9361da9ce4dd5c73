import re
from collections import Counter, defaultdict

import numpy as np

from kgspark.llm import mixing, queries

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped and sizes[s]]
        target = {s: 3.0 * sizes[s] if s in capped else 0.0 for s in order}
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def check(rows, docs, near):
    words = Counter()
    for d in docs:
        words[d.source] += len(WORD.findall(d.text or ""))
    target = plain_targets(words)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d.doc_id, len(WORD.findall(d.text or ""))) for d in docs)
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == words[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= near * t + 1


def test_query_meets_the_targets_and_repeats_itself(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = queries.op8(spark, FOLDER).collect()
    check(rows, docs, 0.01)
    assert sorted(rows) == sorted(queries.op8(spark, FOLDER).collect())


def test_excess_is_shared_again():
    for sizes in ({"a": 1, "b": 1000, "c": 2, None: 50}, {"a": 0, "b": 5}, {"x": 7}, {str(i): 10**i for i in range(6)}):
        found = mixing.targets_of(sizes, mixing.weights_of(list(sizes)))
        want = plain_targets(sizes)
        assert all(abs(found[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_permutations_and_draws():
    for n in (1, 2, 3, 17, 64, 1000):
        orders = [mixing.permuted(np.arange(n), n, key) for key in range(3)]
        assert all(sorted(o.tolist()) == list(range(n)) for o in orders)
    assert orders[0].tolist() != orders[1].tolist()
    counts = mixing.drawn([5, 0, 1000, 77], 7)
    assert counts.sum(0).tolist() == [5, 0, 1000, 77] and max(counts.sum(1)) - min(counts.sum(1)) <= 1
    assert mixing.drawn([0, 0], 3).sum() == 0


def test_slots_hold_each_block_evenly(spark, odd_docs):
    made = mixing.mix(odd_docs, shards=5)
    times = Counter((r.source_no, r.block) for r in made.slots.collect())
    by = defaultdict(list)
    for (s, _), n in times.items():
        by[s].append(n)
    assert all(max(n) - min(n) <= 1 and max(n) <= 3 for n in by.values())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).taken.collect()
    check(rows, odd_docs.collect(), 0.02)
    assert mixing.mix(no_docs).taken.count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0


def test_mixed_documents_hold_the_words_taken(spark, odd_docs):
    docs = odd_docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True).cache()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    found, words = Counter(), Counter()
    text = {(r.doc_id, r.source): r.text for r in docs.collect()}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        own = Counter(WORD.findall(r.text))
        found[r.doc_id, r.source] += sum(own.values())
        assert not own - Counter(WORD.findall(text[r.doc_id, r.source]))
    for r in mixing.mix(docs).taken.collect():
        words[r.doc_id, r.source] += r.taken
    assert found == +words
