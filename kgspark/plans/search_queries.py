"""Text search and entity resolution over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fuzzy import similar_terms, terms_with_prefix
from ..operators.resolve import best_fuzzy, dispatched, match_metabolites, match_names, synonym_hits
from ..operators.text_index import NAME_SIMILARITY, SYNONYM_SIMILARITY, TextIndex, build_index, tokens
from .registry import query, table

_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def search_sql(entries: str, queries: str, last: str, similarity: float | None = None, k: int = 3) -> str:
    """SQL that scores every query with every entry: (query_id, rank, pk, shown, score).

    entries selects (pk, text, shown), queries selects (query_id, text).
    """
    edits = "2" if similarity is None else f"least(2, floor({1 - similarity} * length(w)))"
    final = {
        "exact": "SELECT toks, pos, w AS term, CAST(1 AS DOUBLE) AS weight FROM qw WHERE pos = n",
        "prefix": "SELECT toks, pos, term, CAST(NULL AS DOUBLE) AS weight FROM qw, df WHERE pos = n AND starts_with(term, w)",
        "fuzzy": f"""SELECT toks, pos, term, 1 - levenshtein(w, term) / least(length(w), length(term)) AS weight FROM qw, df
          WHERE pos = n AND levenshtein(w, term) <= {edits} AND levenshtein(w, term) < least(length(w), length(term))""",
    }[last]
    return f"""
WITH dt AS (SELECT pk, shown, {_TOKENS.format('text')} AS toks FROM ({entries})),
db AS (SELECT pk, shown, array_to_string(list_sort(toks), ' ') AS bag, len(toks) AS dl FROM dt WHERE len(toks) > 0),
b AS (SELECT bag, dl, count(*) AS copies FROM db GROUP BY 1, 2),
tot AS (SELECT sum(copies) AS total, sum(copies * dl) / sum(copies) AS avgdl FROM b),
p AS (SELECT term, bag, dl, copies, count(*) AS tf FROM (SELECT bag, dl, copies, unnest(string_split(bag, ' ')) AS term FROM b) GROUP BY ALL),
df AS (SELECT term, sum(copies) AS df FROM p GROUP BY 1),
imp AS (SELECT p.term, bag, ln(1 + (total - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM p JOIN df ON df.term = p.term, tot),
qs AS (SELECT query_id, {_TOKENS.format('text')} AS toks FROM ({queries})),
qw AS (SELECT toks, len(toks) AS n, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM (SELECT DISTINCT toks FROM qs WHERE len(toks) > 0)),
m AS (SELECT toks, pos, w AS term, CAST(1 AS DOUBLE) AS weight FROM qw WHERE pos < n UNION ALL {final}),
sc AS (SELECT toks, pos, bag, max(coalesce(weight * s, 1.0)) AS sc FROM m JOIN imp ON imp.term = m.term GROUP BY 1, 2, 3),
tt AS (SELECT toks, bag, round(sum(sc), 6) AS score FROM sc GROUP BY 1, 2),
f AS (SELECT bag, pk, shown FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY pk) AS rb FROM db) WHERE rb <= {k}),
r AS (SELECT toks, pk, shown, score, row_number() OVER (PARTITION BY toks ORDER BY score DESC, pk) AS rank FROM tt JOIN f ON f.bag = tt.bag)
SELECT query_id, CAST(rank AS INTEGER) AS rank, pk, shown, score FROM qs JOIN r ON r.toks = qs.toks WHERE rank <= {k}"""


# Names with the slips a reader makes; which slip depends on the size of the part.
_MISSPELT = """CASE WHEN p_size <= 12 THEN p_name
  WHEN p_size <= 25 THEN concat(substr(p_name, 1, length(p_name) - 2), substr(p_name, length(p_name), 1))
  WHEN p_size <= 38 THEN concat(p_name, 'x') ELSE upper(p_name) END"""
_PART_ENTRIES = "SELECT p_partkey AS pk, p_name AS text, p_name AS shown FROM part"
_MENTIONS = f"SELECT p_partkey AS query_id, {_MISSPELT} AS text FROM part"


def _part_index(spark: SparkSession, folder: str) -> TextIndex:
    name = F.col("p_name")
    return build_index(table(spark, folder, "part").select(F.col("p_partkey").alias("pk"), name.alias("text"), name.alias("shown")))


def _supplier_index(spark: SparkSession, folder: str) -> TextIndex:
    name = F.col("s_name")
    return build_index(table(spark, folder, "supplier").select(name.alias("pk"), name.alias("text"), name.alias("shown")))


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("query_id"), F.expr(_MISSPELT).alias("text"))


@query("fuzzy_topk", search_sql(_PART_ENTRIES, _MENTIONS, "fuzzy", NAME_SIMILARITY))
def fuzzy_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _part_index(spark, folder).search(_mentions(spark, folder), "fuzzy", NAME_SIMILARITY)


@query("fuzzy_best", f"SELECT * FROM ({search_sql(_PART_ENTRIES, _MENTIONS, 'fuzzy')}) WHERE rank = 1")
def fuzzy_best(spark: SparkSession, folder: str) -> DataFrame:
    return best_fuzzy(_mentions(spark, folder), _part_index(spark, folder))


_DETAILED = "concat(p_brand, ' ', p_type, ' ', p_name)"


@query(
    "exact_terms_topk",
    search_sql(
        f"SELECT p_partkey AS pk, {_DETAILED} AS text, p_brand AS shown FROM part",
        "SELECT DISTINCT concat(p_type, ' ', p_name) AS query_id, concat(p_type, ' ', p_name) AS text FROM part",
        "exact",
    ),
)
def exact_terms_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    index = build_index(parts.select(F.col("p_partkey").alias("pk"), F.expr(_DETAILED).alias("text"), F.col("p_brand").alias("shown")))
    asked = F.concat_ws(" ", "p_type", "p_name")
    return index.search(parts.select(asked.alias("query_id"), asked.alias("text")).distinct(), "exact")


_STARTS = "substr(string_split(p_name, ' ')[2], 1, 2)"
_START_QUERIES = f"SELECT p_partkey AS query_id, {_STARTS} AS text FROM part"
_FUZZY_STARTS = search_sql(_PART_ENTRIES, _START_QUERIES, "fuzzy", SYNONYM_SIMILARITY)


@query(
    "prefix_fallback",
    f"""SELECT * FROM ({_FUZZY_STARTS}) UNION ALL SELECT * FROM ({search_sql(_PART_ENTRIES, _START_QUERIES, 'prefix')})
     WHERE query_id NOT IN (SELECT query_id FROM ({_FUZZY_STARTS}))""",
)
def prefix_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """First letters of a name: fuzzy where that finds anything, else by prefix."""
    start = F.substring(F.split("p_name", " ")[1], 1, 2)
    queries = table(spark, folder, "part").select(F.col("p_partkey").alias("query_id"), start.alias("text"))
    return synonym_hits(queries, _part_index(spark, folder))


_WORDS = "SELECT DISTINCT unnest({0}) AS {1} FROM {2}"
_PART_WORDS = _WORDS.format(_TOKENS.format("concat(p_name, ' ', p_type)"), "match", "part")


@query(
    "similar_words",
    f"""SELECT term, match, CAST(levenshtein(regexp_replace(term, '[^a-z0-9]', '#', 'g'), match) AS INTEGER) AS distance
     FROM ({_WORDS.format(_TOKENS.format("text"), "term", "documents")}), ({_PART_WORDS}) WHERE distance <= 2""",
)
def similar_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents within two edits of words in part names.

    The SQL engine counts edits in bytes; part names are ASCII, so there any other letter counts as one
    that no name has.
    """
    words = table(spark, folder, "documents").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    text = F.concat_ws(" ", "p_name", "p_type")
    names = table(spark, folder, "part").select(F.explode(tokens(text)).alias("match")).distinct()
    return similar_terms(words.withColumn("edits", F.lit(2)), names)


@query(
    "prefix_words",
    f"""SELECT term, match FROM (SELECT DISTINCT lower(substr(p_name, 1, 3)) AS term FROM part), ({_PART_WORDS}) WHERE starts_with(match, term)""",
)
def prefix_words(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    prefixes = parts.select(F.lower(F.substring("p_name", 1, 3)).alias("term")).distinct()
    names = parts.select(F.explode(tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("match")).distinct()
    return terms_with_prefix(prefixes, names)


# --- cascades -----------------------------------------------------------------------------------------

_CASCADE = f"""CASE WHEN p_size <= 30 THEN {_MISSPELT}
  WHEN p_size <= 36 THEN concat('supplier#', lpad(CAST(p_size AS STRING), 9, '0'))
  WHEN p_size <= 42 THEN 'suppl' ELSE 'nothing zzz' END"""
_SUPPLIER_ENTRIES = "SELECT s_name AS pk, s_name AS text, s_name AS shown FROM supplier"
_CASCADE_QUERIES = f"SELECT p_partkey AS query_id, {_CASCADE} AS text FROM part"


@query(
    "resolve_cascade",
    f"""WITH named AS (SELECT query_id, shown FROM ({search_sql(_PART_ENTRIES, _CASCADE_QUERIES, 'fuzzy', NAME_SIMILARITY)}) WHERE rank = 1 AND score > 0.5),
     rest AS (SELECT * FROM ({_CASCADE_QUERIES}) WHERE query_id NOT IN (SELECT query_id FROM named)),
     fz AS ({search_sql(_SUPPLIER_ENTRIES, 'SELECT * FROM rest', 'fuzzy', SYNONYM_SIMILARITY)}),
     px AS ({search_sql(_SUPPLIER_ENTRIES, 'SELECT * FROM rest WHERE query_id NOT IN (SELECT query_id FROM fz)', 'prefix')}),
     o AS (SELECT lower(s_name) AS alias_lc, arg_min(p_name, p_partkey) AS owner FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
       JOIN part ON p_partkey = l_partkey GROUP BY 1)
     SELECT query_id AS mention_id, shown AS matched FROM named
     UNION ALL SELECT query_id, arg_min(owner, rank) FROM (SELECT * FROM fz UNION ALL SELECT * FROM px) JOIN o ON alias_lc = lower(shown)
     WHERE score > 0.5 GROUP BY 1""",
)
def resolve_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Part names first, then names of suppliers, which lead to a part they supply."""
    parts = table(spark, folder, "part")
    mentions = parts.select(F.col("p_partkey").alias("mention_id"), F.expr(_CASCADE).alias("name"))
    supplied = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    aliases = supplied.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("pk"), F.col("s_name").alias("alias")
    )
    owners = parts.select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("name"))
    return match_metabolites(
        mentions, _part_index(spark, folder), _supplier_index(spark, folder), aliases, owners, synonym_threshold=0.5
    )


_TYPE = "CASE p_type WHEN 'SMALL' THEN 'Part' WHEN 'LARGE' THEN 'Supplier' ELSE p_type END"
_TYPED = f"CASE p_type WHEN 'LARGE' THEN concat('supplier ', lpad(CAST(p_size AS STRING), 9, '0')) ELSE {_MISSPELT} END"
_TYPED_ROWS = f"SELECT p_partkey AS query_id, {_TYPED} AS text, {_TYPE} AS type FROM part"


def _typed_sql(entries: str, kind: str) -> str:
    hits = search_sql(entries, f"SELECT query_id, text FROM ({_TYPED_ROWS}) WHERE type = '{kind}'", "fuzzy", NAME_SIMILARITY)
    return f"""SELECT a.query_id AS mention_id, a.text AS name, a.type, h.shown AS matched FROM ({_TYPED_ROWS}) a
      LEFT JOIN (SELECT * FROM ({hits}) WHERE rank = 1 AND score > 0.5) h ON h.query_id = a.query_id WHERE a.type = '{kind}'"""


@query(
    "typed_dispatch",
    f"""{_typed_sql(_PART_ENTRIES, 'Part')} UNION ALL {_typed_sql(_SUPPLIER_ENTRIES, 'Supplier')}
     UNION ALL SELECT query_id, text, type, text FROM ({_TYPED_ROWS}) WHERE type NOT IN ('Part', 'Supplier')""",
)
def typed_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    mentions = table(spark, folder, "part").select(
        F.col("p_partkey").alias("mention_id"), F.expr(_TYPED).alias("name"), F.expr(_TYPE).alias("type")
    )
    parts, suppliers = _part_index(spark, folder), _supplier_index(spark, folder)
    return dispatched(
        mentions, {"Part": lambda m: match_names(m, parts), "Supplier": lambda m: match_names(m, suppliers)}
    )
