"""Scored full-text lookup of many queries at once.

Score. Tokens are lower-cased runs of letters and digits. A query is a list of words that are
OR-ed; the last may be fuzzy or a prefix. A word scores BM25 of the best dictionary term it
stands for, times ``1 - edits / shorter length`` for a fuzzy one; a prefix scores 1. Scores of
the words add up and are rounded to six places; ties go to the smaller key.

Scale. Nodes with the same tokens score the same, so they are folded into one *bag* that keeps
its size and its first keys: a name that a third of all nodes carry is one row. Queries are
folded by their tokens too. The bags of a term are cut into *blocks* of equal norm, and each block
names its first bags. The best blocks of a query's words give its first candidates, and the k-th
best of these is a score to beat. Then a block is opened only if its norm, with all that weaker
words can add, reaches that score. The weakest word of a query opens none: bags that have no
other word of the query are found through its first candidates. The result equals scoring every
pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staging_path, stored
from .fuzzy import max_edits, similar_terms, terms_with_prefix

# BM25 and the matching thresholds.
K1, B = 1.2, 0.75
TOP = 3
NAME_SIMILARITY, NAME_SCORE = 0.5, 0.5
SYNONYM_SIMILARITY, SYNONYM_SCORE = 0.3, 2.0
PREFIX_SCORE = 1.0
PLACES = 6
MARGIN = 2 * 10.0**-PLACES  # scores this close may round to the same value


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@dataclass(frozen=True)
class TextIndex:
    """Four stored tables.

    bags: (bag, words, dl, copies, firsts), bag being a hash that names the words and firsts the
    smallest keys with what they show;
    postings: (term, bag, norm), norm being the part of BM25 that depends on the bag;
    blocks: (term, norm, firsts), the first (pk, bag) of all bags where the term has that norm;
    terms: (term, idf, best, kth, firsts), the best norm of a term, its k-th best if it has k bags,
    and its first (pk, bag).
    """

    bags: DataFrame
    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    k: int = TOP

    def search(
        self, queries: DataFrame, last: str = "fuzzy", similarity: float | None = None, k: int = TOP
    ) -> DataFrame:
        """The k best nodes per query: (query_id, rank, pk, shown, score).

        queries: (query_id, text). ``last`` says what the last word of a query is: fuzzy,
        prefix or exact. The tables hold what the ``k`` best hits need and no more, so a larger
        k than the index was built with is refused.
        """
        if k > self.k:
            raise ValueError(f"the index answers for the {self.k} best hits; build it with k={k}")
        asked = queries.select("query_id", F.array_join(tokens(F.col("text")), " ").alias("query"))
        asked = stored(asked.filter(F.col("query") != ""), "search-queries")
        hits = self._hits(asked.select("query").distinct(), last, similarity, k)
        return asked.join(hits, "query").drop("query")

    def _weights(self, asked: DataFrame, last: str, similarity: float | None) -> DataFrame:
        """(query, word, term, weight): dictionary terms each word of a query stands for.

        ``weight`` is null for a prefix, whose score is constant.
        """
        split = asked.withColumn("words", F.split("query", " "))
        words = split.select("query", F.size("words").alias("n"), F.posexplode("words").alias("word", "text"))
        special = (F.col("word") == F.col("n") - 1) if last != "exact" else F.lit(False)
        plain = words.filter(~special).select("query", "word", F.col("text").alias("term"), F.lit(1.0).alias("weight"))
        if last == "exact":
            return plain
        ends = words.filter(special)
        distinct_ends = ends.select(F.col("text").alias("term")).distinct()
        vocabulary = self.terms.select(F.col("term").alias("match"))
        if last == "fuzzy":
            wanted = distinct_ends.withColumn("edits", max_edits(F.col("term"), similarity))
            shorter = F.least(F.length("term"), F.length("match"))
            found = similar_terms(wanted, vocabulary, alike=True).withColumn("weight", 1 - F.col("distance") / shorter)
        elif last == "prefix":
            found = terms_with_prefix(distinct_ends, vocabulary).withColumn("weight", F.lit(None).cast("double"))
        else:
            raise ValueError(f"last must be fuzzy, prefix or exact, not {last!r}")
        expanded = ends.select("query", "word", F.col("text").alias("term")).join(found, "term")
        return plain.union(expanded.select("query", "word", F.col("match").alias("term"), "weight"))

    def _words(self, asked: DataFrame, last: str, similarity: float | None) -> DataFrame:
        """Terms of each word with their factor (null for a prefix) and the most they can score."""
        weights = self._weights(asked, last, similarity).join(self.terms.drop("firsts"), "term")
        factor = F.col("weight") * F.col("idf")
        upper = F.coalesce(factor * F.col("best"), F.lit(PREFIX_SCORE))
        return weights.select("query", "word", "term", factor.alias("factor"), upper.alias("upper"), (factor * F.col("kth")).alias("kth"))

    def _first_candidates(self, words: DataFrame, k: int) -> DataFrame:
        """The k best bags of each word of a query, judged by that word alone: (query, bag)."""
        at_least = F.coalesce(F.col("kth") - MARGIN, F.lit(0.0))
        own = F.col("factor") * F.col("norm")
        of_blocks = words.filter("factor IS NOT NULL").join(self.blocks, "term").filter(own >= at_least)
        scored = of_blocks.select("query", "word", F.round(own, PLACES).alias("own"), F.explode("firsts").alias("node"))
        by_prefix = words.filter("factor IS NULL").join(self.terms.select("term", "firsts"), "term")
        equal = by_prefix.select("query", "word", F.lit(PREFIX_SCORE).alias("own"), F.explode("firsts").alias("node"))
        each = scored.union(equal).groupBy("query", "word", "node").agg(F.max("own").alias("own"))
        order = Window.partitionBy("query", "word").orderBy(F.col("own").desc(), "node")
        first = each.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
        return first.select("query", "node.bag").distinct()

    def _scored(self, candidates: DataFrame, words: DataFrame) -> DataFrame:
        contribution = F.coalesce(F.col("factor") * F.col("norm"), F.lit(PREFIX_SCORE))
        return (
            candidates.join(self.postings, "bag")
            .join(words.select("query", "word", "term", "factor"), ["query", "term"])
            .groupBy("query", "bag", "word")
            .agg(F.max(contribution).alias("score"))
            .groupBy("query", "bag")
            .agg(F.round(F.sum("score"), PLACES).alias("score"))
        )

    def _further_candidates(self, words: DataFrame, first: DataFrame, k: int) -> DataFrame:
        """Bags of the blocks that may still hold one of the k best: (query, bag)."""
        by_score = Window.partitionBy("query").orderBy(F.col("score").desc())
        to_beat = first.withColumn("_r", F.row_number().over(by_score)).filter(F.col("_r") == k)
        to_beat = to_beat.select("query", (F.col("score") - MARGIN).alias("to_beat"))
        # words of a query by rising best score; what all weaker words can add to a word's own
        per_word = words.groupBy("query", "word").agg(F.max("upper").alias("upper"))
        rising = Window.partitionBy("query").orderBy("upper", "word")
        weaker = F.sum("upper").over(rising.rowsBetween(Window.unboundedPreceding, -1))
        open_words = (
            per_word.select("query", "word", "upper", weaker.alias("weaker"))  # null for the weakest
            .join(to_beat, "query")
            .filter(F.col("weaker") + F.col("upper") >= F.col("to_beat"))
            .select("query", "word", "weaker", "to_beat")
        )
        most = F.coalesce(F.col("factor") * F.col("norm"), F.lit(PREFIX_SCORE)) + F.col("weaker")
        opened = (
            words.join(open_words, ["query", "word"])
            .join(self.blocks.select("term", "norm"), "term")
            .filter(most >= F.col("to_beat"))
            .select("query", "term", "norm")
        )
        found = opened.join(self.postings, ["term", "norm"]).select("query", "bag").distinct()
        return found.join(first, ["query", "bag"], "left_anti")

    def _hits(self, asked: DataFrame, last: str, similarity: float | None, k: int) -> DataFrame:
        words = stored(self._words(asked, last, similarity), "search-words")
        first = stored(self._scored(self._first_candidates(words, k), words), "search-first")
        scored = first.union(self._scored(self._further_candidates(words, first, k), words))
        # any of the k best nodes is in one of the k best bags, ordered by score and first key
        firsts = self.bags.select("bag", F.slice("firsts", 1, k).alias("firsts"))
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("firsts")[0]["pk"])
        bags = scored.join(firsts, "bag").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
        nodes = bags.select("query", "score", F.explode("firsts").alias("node")).select("query", "score", "node.*")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "pk")
        return (
            nodes.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select("query", "rank", "pk", "shown", "score")
        )


def _bags(entries: DataFrame, k: int) -> DataFrame:
    bagged = entries.select(
        "pk", "shown", F.array_join(F.array_sort(tokens(F.col("text"))), " ").alias("words")
    ).filter(F.col("words") != "")
    bagged = bagged.withColumn("bag", F.unhex(F.md5("words")))
    # the rank filter cuts every bag to k rows per task before the shuffle
    first = Window.partitionBy("bag").orderBy("pk")
    firsts = (
        bagged.withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= k)
        .groupBy("bag")
        .agg(F.array_sort(F.collect_list(F.struct("pk", "shown"))).alias("firsts"))
    )
    counts = bagged.groupBy("bag").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"))
    return counts.join(firsts, "bag").withColumn("dl", F.size(F.split("words", " ")))


def _postings(bags: DataFrame) -> DataFrame:
    average = bags.agg((F.sum(F.col("copies") * F.col("dl")) / F.sum("copies")).alias("avgdl")).scalar()
    words = F.split("words", " ")
    counted = F.transform(
        F.array_distinct(words),
        lambda term: F.struct(term.alias("term"), F.size(F.filter(words, lambda word: word == term)).alias("tf")),
    )
    rows = bags.select("bag", "dl", F.explode(counted).alias("t"))
    norm = F.col("t.tf") / (F.col("t.tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / average))
    return rows.select("t.term", "bag", norm.alias("norm"))


def _firsts(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k smallest (pk, bag) for each key; tasks hand on no more than k rows of each."""
    order = Window.partitionBy(*keys).orderBy("pk", "bag")
    some = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    return some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pk", "bag"))).alias("firsts"))


def _blocks(bags: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    keyed = postings.join(bags.select("bag", F.col("firsts")[0]["pk"].alias("pk")), "bag")
    return _firsts(keyed, ["term", "norm"], k)


def _terms(bags: DataFrame, postings: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    n_nodes = bags.agg(F.sum("copies").alias("n")).scalar()
    df = F.sum("copies")
    stats = (
        postings.join(bags.select("bag", "copies"), "bag")
        .groupBy("term")
        .agg(df.alias("df"), F.max("norm").alias("best"))
        .withColumn("idf", F.ln(1 + (n_nodes - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    )
    # the k-th best norm is among the first k bags of the best blocks
    listed = blocks.select("term", "norm", F.explode("firsts").alias("node")).select("term", "norm", "node.*")
    ordered = Window.partitionBy("term").orderBy(F.col("norm").desc())
    ranked = listed.select("term", "norm").withColumn("_r", F.row_number().over(ordered)).filter(F.col("_r") == k)
    kth = ranked.select("term", F.col("norm").alias("kth"))
    firsts = _firsts(listed, ["term"], k)
    return stats.select("term", "idf", "best").join(kth, "term", "left").join(firsts, "term")


def build_index(entries: DataFrame, path: str | None = None, k: int = TOP) -> TextIndex:
    """Index of nodes (pk, text, shown): ``text`` is searched, ``shown`` is what a hit returns.

    Its tables are written to ``path``, or to the shared folder, and read by every search.
    """
    target = path or staging_path(entries.sparkSession, "text-index")

    bags = stored(_bags(entries, k), "bags", f"{target}/bags")
    postings = stored(_postings(bags), "postings", f"{target}/postings")
    blocks = stored(_blocks(bags, postings, k), "blocks", f"{target}/blocks")
    terms = stored(_terms(bags, postings, blocks, k), "terms", f"{target}/terms")
    entries.sparkSession.createDataFrame([(k,)], "k int").write.parquet(f"{target}/made")
    return TextIndex(bags, postings, blocks, terms, k)


def load_index(spark: SparkSession, path: str) -> TextIndex:
    """An index that ``build_index`` wrote to ``path``."""
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("bags", "postings", "blocks", "terms")]
    return TextIndex(*tables, spark.read.parquet(f"{path}/made").first()["k"])


def first_above(hits: DataFrame, threshold: float) -> DataFrame:
    """The best hit of each query if its score is above the threshold."""
    return hits.filter((F.col("rank") == 1) & (F.col("score") > threshold))


def best(hits: DataFrame) -> DataFrame:
    """The best hit of each query, whatever its score."""
    return hits.filter(F.col("rank") == 1)
