"""Pairs of terms within an edit distance, found by equi-joins.

Comparing every query term with every dictionary term does not scale, so both sides are
turned into keys that any two terms within two edits must share; only pairs that meet in a
key are compared. Two key families together cover all lengths, so nothing is left out:

* short query terms: what remains after deleting up to two characters;
* long query terms: thirds. Two edits leave one third of the dictionary term untouched, and
  move it by at most two places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import in_intervals, with_rank

MAX_EDITS = 2
# Query terms up to this length use deletion keys. Terms meet in such a key only if they are
# nearly equal, so no key is hot; thirds are shared by all terms with a common start.
SHORT = 30


def max_edits(term: Column, similarity: float | None) -> Column:
    """Edits allowed for a term: two, or fewer where the similarity asks for it."""
    if similarity is None:
        return F.lit(MAX_EDITS)
    return F.least(F.lit(MAX_EDITS), F.floor(F.lit(1 - similarity) * F.length(term))).cast("int")


def _without_one(term: Column) -> Column:
    """The term without its 1st, 2nd, ... character."""
    places = F.when(F.length(term) > 0, F.sequence(F.lit(1), F.length(term))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places, lambda i: F.concat(F.substr(term, F.lit(1), i - 1), F.substr(term, i + 1))
    )


def _deletion_keys(term: Column, edits: Column) -> Column:
    none = F.array().cast("array<string>")
    one = F.array_distinct(_without_one(term))
    two = F.flatten(F.transform(one, _without_one))
    return F.array_distinct(
        F.concat(
            F.array(term),
            F.when(edits >= 1, one).otherwise(none),
            F.when(edits >= 2, two).otherwise(none),
        )
    )


# third i (0, 1, 2) of a term of n characters: where it starts, from 1, and how long it is
_START = "(n DIV 3) * i + 1"
_SIZE = "CAST(if(i < 2, n DIV 3, n - 2 * (n DIV 3)) AS INT)"

# keys of a dictionary term: its length and each of its thirds
_THIRD_KEYS = f"""
  transform(array(length(match)), n -> transform(array(0, 1, 2), i ->
    concat_ws(':', n, i, substr(match, CAST({_START} AS INT), {_SIZE}))))[0]"""

# keys of a query term: what a third could be, for every length and shift two edits allow
_WINDOW_KEYS = f"""
  array_distinct(array_compact(flatten(flatten(
    transform(sequence(length(term) - {MAX_EDITS}, length(term) + {MAX_EDITS}), n ->
      transform(array(0, 1, 2), i ->
        transform(sequence(-{MAX_EDITS}, {MAX_EDITS}), shift ->
          CASE WHEN {_START} + shift >= 1 AND {_START} + shift + {_SIZE} - 1 <= length(term)
          THEN concat_ws(':', n, i, substr(term, CAST({_START} + shift AS INT), {_SIZE})) END)))))))"""


def similar_terms(queries: DataFrame, dictionary: DataFrame, alike: bool = False) -> DataFrame:
    """(term, match, distance) for queries (term, edits) and a dictionary (match), both distinct.

    With ``alike`` only pairs whose distance is below the shorter length: then no term loses all its
    characters, and short terms do not meet in an empty key.
    """
    # few bytes make many keys: spread the terms over all tasks before they are expanded
    spark = queries.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries, dictionary = queries.repartition(n, "term"), dictionary.repartition(n, "match")
    q, m = F.col("term"), F.col("match")
    length = F.length
    own_edits = F.lit(MAX_EDITS)
    if alike:
        queries = queries.withColumn("edits", F.least("edits", length("term") - 1)).where("edits >= 0")
        own_edits = F.least(own_edits, length("match") - 1)
    pairs = (
        queries.filter(length(q) <= SHORT)
        .select("term", "edits", F.explode(_deletion_keys(q, F.col("edits"))).alias("key"))
        .join(
            dictionary.filter(length(m) <= SHORT + MAX_EDITS).select(
                "match", F.explode(_deletion_keys(m, own_edits)).alias("key")
            ),
            "key",
        )
        .drop("key")
    )
    long_pairs = (
        queries.filter(length(q) > SHORT)
        .select("term", "edits", F.explode(F.expr(_WINDOW_KEYS)).alias("key"))
        .join(
            dictionary.filter(length(m) > SHORT - MAX_EDITS).select("match", F.explode(F.expr(_THIRD_KEYS)).alias("key")),
            "key",
        )
        .drop("key")
    )
    distance = F.levenshtein(q, m, MAX_EDITS)
    both = pairs.union(long_pairs).withColumn("distance", distance)
    close = both.filter((F.col("distance") >= 0) & (F.col("distance") <= F.col("edits")))
    if alike:
        close = close.filter(F.col("distance") < F.least(length(q), length(m)))
    return close.select("term", "match", "distance").distinct()


# sorts after every character that a term can hold
_LAST = "\U0010ffff"


def terms_with_prefix(prefixes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(term, match) where the dictionary term starts with the query term; both sides distinct.

    Terms and the two ends of every prefix are sorted together; a prefix is then an interval of
    ranks, and its terms are the ranks inside. No term is cut into its prefixes.
    """
    asked = prefixes.select("term")
    words = dictionary.select(F.col("match").alias("text"), F.lit(None).cast("string").alias("term"))
    ends = [asked.select(end.alias("text"), "term") for end in (F.col("term"), F.concat("term", F.lit(_LAST)))]
    # a prefix comes before the term that equals it
    both = words.union(ends[0]).union(ends[1]).withColumn("is_word", F.col("term").isNull())
    ranked = with_rank(both, ["text", "is_word"], F.col("is_word").cast("int"), "at")
    intervals = ranked.where(~F.col("is_word")).groupBy("term").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    found = in_intervals(intervals, ranked.where("is_word").select(F.col("text").alias("match"), "at"))
    return found.select("term", "match")
