"""Text search and entity resolution against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from kgspark.operators import intervals
from kgspark.operators.fuzzy import similar_terms, terms_with_prefix
from kgspark.operators.resolve import best_exact, best_fuzzy, dispatched, match_metabolites, match_names, synonym_hits
from kgspark.operators.text_index import build_index, load_index, tokens


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def scramble(rng, word):
    for _ in range(rng.randint(0, 2)):
        at = rng.randrange(len(word) + 1)
        word = rng.choice([word[:at] + rng.choice("abc") + word[at:], word[:at] + word[at + 1:] or "a"])
    return word


def test_similar_terms_equals_comparing_all(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 44))) for _ in range(300)}
    asked = {scramble(rng, word) for word in words} | {"école", "a"}
    words |= {"ecole", "écol"}
    queries = spark.createDataFrame([(w, 1 + len(w) % 2) for w in asked], "term string, edits int")
    dictionary = spark.createDataFrame([(w,) for w in words], "match string")
    found = {tuple(row) for row in similar_terms(queries, dictionary).collect()}
    expected = set()
    for q in asked:
        for w in words:
            d = edit_distance(q, w)
            if d <= 1 + len(q) % 2:
                expected.add((q, w, d))
    assert found == expected
    assert any(len(q) > 30 for q, _, d in found if d)


def test_prefixes(spark):
    terms = ["acid", "acetate", "ac", "citrate"]
    found = terms_with_prefix(
        spark.createDataFrame([("ac",), ("cit",), ("x",)], "term string"),
        spark.createDataFrame([(t,) for t in terms], "match string"),
    )
    assert {tuple(r) for r in found.collect()} == {("ac", "acid"), ("ac", "acetate"), ("ac", "ac"), ("cit", "citrate")}


def test_prefixes_equal_comparing_all(spark, monkeypatch):
    monkeypatch.setattr(intervals, "CELL", 7)
    rng = random.Random(11)
    words = {"".join(rng.choice("abé漢\U0001f600") for _ in range(rng.randint(1, 6))) for _ in range(400)} | {"a" * 500}
    asked = {w[: rng.randint(1, 3)] for w in words} | {"zz", "", "a" * 400}
    found = terms_with_prefix(
        spark.createDataFrame([(w,) for w in asked], "term string").repartition(3),
        spark.createDataFrame([(w,) for w in words], "match string").repartition(3),
    )
    assert sorted(map(tuple, found.collect())) == sorted((p, w) for p in asked for w in words if w.startswith(p))
    assert terms_with_prefix(spark.createDataFrame([], "term string"), spark.createDataFrame([("a",)], "match string")).count() == 0


def test_candidates_do_not_grow_with_the_nodes(spark):
    per_query = []
    for n in (300, 3000):
        index = build_index(spark.createDataFrame([(i, f"Supplier#{i:09d} group {i % 2}", f"{i}") for i in range(n)], "pk bigint, text string, shown string"))
        asked = spark.createDataFrame([(f"{i:09d} supplier",) for i in range(0, n, n // 20)], "query string")
        words = index._words(asked.withColumn("query", F.array_join(tokens(F.col("query")), " ")), "exact", None)
        first = index._scored(index._first_candidates(words, 3), words)
        further = index._further_candidates(words, first, 3)
        per_query.append((first.count() + further.count()) / asked.count())
    assert per_query[1] <= per_query[0] <= 8


def test_alike_terms(spark):
    words = ["a", "b", "ab", "ba", "abc", "xbc", "abcd", "", "acd"]
    queries = spark.createDataFrame([(w, 2) for w in words], "term string, edits int")
    found = similar_terms(queries, spark.createDataFrame([(w,) for w in words], "match string"), alike=True)
    wanted = {(q, w, edit_distance(q, w)) for q in words for w in words if edit_distance(q, w) <= 2 and edit_distance(q, w) < min(len(q), len(w))}
    assert {tuple(r) for r in found.collect()} == wanted


def brute_force(entries, queries, last, similarity, k):
    bags = [(pk, re.findall(r"[^\W_]+", text.lower()), text) for pk, text in entries]
    bags = [bag for bag in bags if bag[1]]
    n = len(bags)
    avgdl = sum(len(t) for _, t, _ in bags) / n
    df = {}
    for _, toks, _ in bags:
        for t in set(toks):
            df[t] = df.get(t, 0) + 1

    def bm25(t, toks):
        tf = toks.count(t)
        idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        return idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))

    result = set()
    for qid, text in queries:
        words = re.findall(r"[^\W_]+", text.lower())
        rows = []
        for pk, toks, shown in bags:
            score, hit = 0.0, False
            for i, w in enumerate(words):
                final = i == len(words) - 1 and last != "exact"
                options = []
                for t in set(toks):
                    if final and last == "prefix":
                        if t.startswith(w):
                            options.append(1.0)
                    elif final:
                        limit = 2 if similarity is None else min(2, math.floor((1 - similarity) * len(w)))
                        d = edit_distance(w, t)
                        weight = 1 - d / min(len(w), len(t))
                        if d <= limit and weight > 0:
                            options.append(weight * bm25(t, toks))
                    elif t == w:
                        options.append(bm25(t, toks))
                if options:
                    score, hit = score + max(options), True
            if hit:
                rows.append((-round(score, 6), pk, shown))
        for rank, (score, pk, shown) in enumerate(sorted(rows)[:k], 1):
            result.add((qid, rank, pk, shown, -score))
    return result


@pytest.fixture(scope="module")
def entries():
    rng = random.Random(3)
    words = ["acid", "citric", "acetic", "kinase", "creatine", "beta", "acids", "glucose", "d", "phosphate"]
    names = [" ".join(rng.choices(words, weights=[30, 4, 4, 3, 2, 5, 4, 2, 9, 3], k=rng.randint(1, 4))) for _ in range(220)]
    names += ["Citric Acid"] * 60 + ["acid citric"] * 5 + ["---"]
    return list(enumerate(names))


@pytest.mark.parametrize("last,similarity", [("fuzzy", 0.5), ("fuzzy", None), ("prefix", None), ("exact", None)])
def test_search_equals_scoring_everything(spark, entries, last, similarity):
    index = build_index(spark.createDataFrame([(i, t, t) for i, t in entries], "pk bigint, text string, shown string"))
    texts = ["citric acid", "acid", "acd", "creatine kinas", "citirc", "beta d glucse", "zzz acid", "zzz", "!!", "d",
             "acid acid", "Phosphate  KINASE", "ace", "beta d acid acetic"]
    queries = list(enumerate(texts))
    hits = index.search(spark.createDataFrame(queries, "query_id bigint, text string"), last, similarity)
    found = {tuple(r) for r in hits.select("query_id", "rank", "pk", "shown", "score").collect()}
    assert found == brute_force(entries, queries, last, similarity, 3)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def index_of(spark, names):
    return build_index(frame(spark, [(n, n, n) for n in names], "pk string, text string, shown string"))


def test_cascade(spark):
    fillers = [f"filler{i} word{i}" for i in range(200)]
    names = index_of(spark, ["citric acid", "glucose"] + fillers)
    synonyms = index_of(spark, ["dextrose", "Orphan sugar", "blood sugar", "longprefixed thing"] + fillers)
    aliases = frame(spark, [("m2", "Dextrose"), ("m2", "blood sugar"), ("m0", "BLOOD sugar")], "pk string, alias string")
    owners = frame(spark, [("m1", "citric acid"), ("m2", "glucose"), ("m0", "first")], "pk string, name string")
    asked = ["citric acd", "dextrse", "blood sugar", "orphan sugar", "longpref", "nothing", None]
    mentions = frame(spark, list(enumerate(asked)), "mention_id bigint, name string")
    found = {r.mention_id: r.matched for r in match_metabolites(mentions, names, synonyms, aliases, owners).collect()}
    # an alias of several nodes takes the smallest key; "Orphan sugar" has no owner, so the
    # next best synonym counts
    assert found[0] == "citric acid" and found[1] == "glucose" and found[2] == found[3] == "first"
    assert 4 not in found and 5 not in found and 6 not in found
    hits = synonym_hits(frame(spark, [(1, "longpref")], "query_id bigint, text string"), synonyms)
    assert [(r.shown, r.score) for r in hits.collect()] == [("longprefixed thing", 1.0)]


def test_dispatch_keeps_every_mention(spark):
    names = index_of(spark, ["gout", "pancreatic cancer"] + [f"other{i}" for i in range(30)])
    mentions = frame(
        spark,
        [(1, "pancreatic cancr", "Disease"), (2, "unknown", "Disease"), (3, "liver", "Tissue"), (4, None, None)],
        "mention_id bigint, name string, type string",
    )
    found = dispatched(mentions, {"Disease": lambda m: match_names(m, names)})
    assert sorted(map(tuple, found.collect())) == [
        (1, "pancreatic cancr", "Disease", "pancreatic cancer"),
        (2, "unknown", "Disease", None),
        (3, "liver", "Tissue", "liver"),
        (4, None, None, None),
    ]
    q = frame(spark, [(1, "goat"), (2, "cancer")], "query_id bigint, text string")
    assert [(r.query_id, r.shown) for r in best_fuzzy(q, names).orderBy("query_id").collect()] == [
        (1, "gout"), (2, "pancreatic cancer")]
    assert [(r.query_id, r.shown) for r in best_exact(q, names).collect()] == [(2, "pancreatic cancer")]


def test_stored_index_knows_its_k(spark, tmp_path):
    entries = spark.createDataFrame([(i, "same words", f"n{i}") for i in range(10)], "pk bigint, text string, shown string")
    built = build_index(entries, str(tmp_path / "index"), k=4)
    asked = spark.createDataFrame([(1, "words")], "query_id int, text string")
    for index in (built, load_index(spark, str(tmp_path / "index"))):
        assert [r.pk for r in index.search(asked, "exact", k=4).orderBy("rank").collect()] == [0, 1, 2, 3]
        with pytest.raises(ValueError, match="k=5"):
            index.search(asked, "exact", k=5)
