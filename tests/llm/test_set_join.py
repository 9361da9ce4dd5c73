import os
import random
from collections import Counter

import pytest

from kgspark import session
from kgspark.llm import queries, set_join
from kgspark.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def plain_set(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    wide = min(width, len(words))
    return frozenset(tuple(words[i : i + wide]) for i in range(len(words) - wide + 1))


def plain(docs, num=90, den=100, width=3):
    sets = [(d, plain_set(t, width)) for d, t in docs]
    home = {d: d for d, _ in sets if d is not None}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(known):
        for b, y in known[i + 1 :]:
            if den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                home[q] = p
    return Counter((d, len(s), None if d is None else find(d)) for d, s in sets)


def found(frame):
    return Counter(map(tuple, frame.select("doc_id", "n_shingles", "component_id").collect()))


def near_copies(seed, n=120):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [draw.choices(words, k=draw.choice([3, 8, 12, 25, 60, 200, 400])) for _ in range(8)]
    common = draw.choices(words, k=40)
    texts = []
    for _ in range(n):
        t = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
            k = draw.randrange(len(t))
            t[k : k + draw.randrange(0, 2)] = [draw.choice(words)]
        if draw.random() < 0.2:
            t += common
        texts.append(" ".join(w.upper() if draw.random() < 0.1 else w for w in t))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_random_copies(spark, seed):
    texts = near_copies(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    docs = list(zip(ids, texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rule = set_join.Rule(*[(90, 100), (4, 5), (90, 100), (95, 100)][seed - 1])
    assert found(set_join.document_components(frame, rule)) == plain(docs, rule.num, rule.den)


def test_query_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert found(queries.op6(spark, FOLDER)) == plain(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(set_join.document_components(odd_docs)) == plain(docs)
    assert set_join.document_components(no_docs).count() == 0
    kept = set_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7, 8]


def test_copy_without_an_id_hides_no_links(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(None, " ".join(words)), (1, " ".join(words)), (2, " ".join([*words, "more"]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert found(set_join.document_components(frame)) == plain(docs)
    assert set_join.document_components(frame).where("doc_id = 2").first().component_id == 1


def test_tables_go_when_a_step_ends(spark, monkeypatch):
    """Lists in several passes and pairs in slices give the same; what is left is the result alone."""
    monkeypatch.setattr(set_join, "FEW", 0)
    monkeypatch.setattr(set_join, "PASSES", 3)
    monkeypatch.setattr(set_join, "SENT", 0.2)
    monkeypatch.setattr(set_join, "release_shuffles", lambda spark: None)
    written = []
    monkeypatch.setattr(session, "staging_path", lambda spark, name, make=session.staging_path: written.append(make(spark, name)) or written[-1])
    docs = list(enumerate(near_copies(7, 90)))
    frame = set_join.document_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    names = [os.path.basename(x).rsplit("-", 1)[0] for x in written]
    assert names.count("set-shared-lists") == 3 and names.count("set-measured") > 3
    left = {name for name, x in zip(names, written) if os.path.isdir(x)}
    assert left <= {"set-documents", "set-members", "set-links", *(x for x in names if x.startswith("components"))}
    assert found(frame) == plain(docs)


def test_shingles_of_five_words(spark):
    """Two words replaced far apart: 86 of 106 five-word shingles are shared, but 92 of 104 three-word ones."""
    words = [f"w{i}" for i in range(100)]
    other = list(words)
    other[30], other[70] = "x", "y"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "some other words")], "doc_id long, text string")
    assert [r.doc_id for r in set_join.one_of_each(docs, set_join.Rule(80, 100, 5)).orderBy("doc_id").collect()] == [1, 3]
    assert set_join.one_of_each(docs).count() == 3


def test_one_id_with_two_texts(spark):
    docs = [(1, "a b c d e f g h i j k l m n o p q r s t u v w"), (1, "other words here"), (2, "a b c d e f g h i j k l m n o p q r s t u v w x"), (2, "a b c d e f g h i j k l m n o p q r s t u v w x")]
    rows = set_join.document_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 1), (1, 21, 1), (2, 22, 1), (2, 22, 1)]


def test_links_carry_true_distances(spark):
    docs = list(enumerate(near_copies(9, 40)))
    joined = set_join.join_sets(spark.createDataFrame(docs, "doc_id long, text string"))
    of = {set_join.set_id(set_join.shingles(t)): plain_set(t) for _, t in docs}
    rows = joined.links.collect()
    assert rows
    for r in rows:
        assert r.apart == len(of[r.a] ^ of[r.b])


def plain_links(docs, num=90, den=100):
    """The linked pairs of different sets; of each row the number of linked other (document, set) pairs."""
    known = {(d, s) for d, t in docs if d is not None and (s := plain_set(t))}
    of = {s: frozenset(y for _, y in known if den * len(s & y) >= num * len(s | y)) for s in {s for _, s in known}}
    times = Counter(s for _, s in known)
    return of, Counter((d, None if d is None else sum(times[y] for y in of.get(s, ())) - ((d, s) in known)) for d, s in ((d, plain_set(t)) for d, t in docs))


@pytest.mark.parametrize("block", [4, 256])
@pytest.mark.parametrize("seed", [1, 2])
def test_every_link_is_found(spark, seed, block, monkeypatch):
    """Components alone would leave out most links of a group of near copies."""
    monkeypatch.setattr(set_join, "BLOCK", block)
    docs = list(enumerate(near_copies(seed))) + [(1, near_copies(seed)[2]), (None, near_copies(seed)[3]), (500, None), (501, near_copies(seed)[0])]
    rule = set_join.Rule(*[(90, 100), (4, 5)][seed - 1])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    of, counts = plain_links(docs, rule.num, rule.den)
    name = {set_join.set_id(set_join.shingles(t)): plain_set(t) for _, t in docs}
    rows = set_join.answers(set_join.join_sets(frame, rule), rule).collect()
    got = Counter((name[r.sid], name[b]) for r in rows for b in r.found)
    assert got == Counter((x, y) for x, ys in of.items() for y in ys if x != y)
    assert Counter((r.doc_id, r.n_links) for r in set_join.document_links(frame, rule).collect()) == counts


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    """No task gets a long list as a whole, and no link between components is lost."""
    monkeypatch.setattr(set_join, "LIST", 8)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = near_copies(3, 40)
    for _ in range(80):
        t = list(base)
        for k in draw.sample(range(300), draw.choice([1, 2, 6, 9])):
            t[k] = f"x{draw.randrange(99)}"
        texts.append(" ".join(t))
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(set_join.document_components(frame)) == plain(docs)

    rows = [(k, s, 100, s % 3) for k in (1, 2) for s in range(60)] + [(2, 60 + s, 100, 60 + s) for s in range(20)]
    long = spark.createDataFrame([(*r, 60 if r[0] == 1 else 80) for r in rows], "list long, sid long, n long, home long, total long")
    for made in (set_join.dealt(long, 0), set_join.against(long)):
        assert max(r["count"] for r in made.groupBy("met").count().collect()) < 60
    together = {}
    for r in set_join.against(long).collect():
        together.setdefault(r.met, []).append(r)
    pairs = Counter((min(x.sid, y.sid), max(x.sid, y.sid)) for m in together.values() for i, x in enumerate(m) for y in m[i + 1 :] if x.home != y.home and (x.side < 0 or x.side != y.side))
    want = Counter((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[3] != b[3])
    assert pairs == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert Counter((r.node, r.least) for r in rows) == Counter([(i, 0) for i in range(61)] + [(100 + i, 100) for i in range(40)])
