"""Queries of operators whose data outgrow one task: any XML file, ancestry, shared subgraphs, text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import brackets, conversation, graph, responses, think, tree
from ..operators.fuzzy import terms_with_prefix
from ..operators.resolve import resolved
from ..operators.text_index import build_index, tokens
from ..session import staging_path, stored
from ..sources.graph_store import GraphStore
from ..sources.xml_records import parse_records, scan_nested_records, scan_records
from .ingest import load_metabolites
from .record_queries import ACC, BIG, METABOLITE_FIELDS, METABOLITE_PROPS, xml_records
from .record_queries import _last_sql as last_sql
from .registry import query, table
from .search_queries import search_sql
from .table_queries import _all_nodes as all_nodes

# --- structure of XML files ------------------------------------------------------------------------


def _nation_files(spark: SparkSession, folder: str) -> str:
    """One document for each nation: suppliers, and customers with their orders, in containers of their own.

    Quoted values, CDATA sections, comments and a document type hold what looks like tags.
    """
    supplier, customer = table(spark, folder, "supplier"), table(spark, folder, "customer")
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<x:order key="'), "o_orderkey", F.lit("\"><note>a > b</note></x:order>")))), "").alias("orders")
    )

    def lines(rows: DataFrame, nation: str, place: int, *text) -> DataFrame:
        return rows.select(F.col(nation).alias("nation"), F.lit(place).alias("place"), F.concat(*text).alias("value"))

    nations = table(spark, folder, "nation")
    head = '<?xml version="1.0"?><!DOCTYPE nation [<!ELEMENT nation (any)> <!-- <no> ]> -->]>\n<nation name=\'a > b "\'>'
    some = customer.join(orders, "c_custkey", "left")
    parts = [
        lines(nations, "n_nationkey", 0, F.lit(head)),
        lines(nations, "n_nationkey", 1, F.lit("<!-- <comment><inside/> -->\n<suppliers\n>")),
        lines(supplier, "s_nationkey", 2, F.lit("<supplier title='it\"s >'><name>"), "s_name", F.lit("</name><empty k=\"/\"/></supplier>")),
        lines(nations, "n_nationkey", 3, F.lit("</suppliers><customers>")),
        lines(some, "c_nationkey", 4, F.lit("<customer><name><![CDATA["), "c_name", F.lit(" <b> ]] >]]></name>"), F.coalesce("orders", F.lit("")), F.lit("</customer >")),
        lines(nations, "n_nationkey", 5, F.lit("</customers><?end <tag> ?></nation>")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    path = staging_path(spark, "nation-xml")
    dealt = rows.repartition("nation").sortWithinPartitions("nation", "place", "value").select("nation", "value")
    dealt.write.partitionBy("nation").text(path)
    return path


@query(
    "xml_structure_any",
    """WITH s AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1),
       c AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1),
       o AS (SELECT c_nationkey AS nation, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
       p AS (SELECT n_nationkey AS nation, NULL AS parent, 'nation' AS child, 1 AS n FROM nation
         UNION ALL SELECT n_nationkey, 'nation', 'suppliers', 1 FROM nation
         UNION ALL SELECT n_nationkey, 'nation', 'customers', 1 FROM nation
         UNION ALL SELECT nation, 'suppliers', 'supplier', n FROM s
         UNION ALL SELECT nation, 'supplier', 'name', n FROM s
         UNION ALL SELECT nation, 'supplier', 'empty', n FROM s
         UNION ALL SELECT nation, 'customers', 'customer', n FROM c
         UNION ALL SELECT nation, 'customer', 'name', n FROM c
         UNION ALL SELECT nation, 'customer', 'order', n FROM o
         UNION ALL SELECT nation, 'order', 'note', n FROM o)
     SELECT CAST(nation AS BIGINT) AS nation, parent, child, CAST(n AS BIGINT) AS n FROM p""",
)
def xml_structure_any(spark: SparkSession, folder: str) -> DataFrame:
    pairs = brackets.element_pairs(spark, _nation_files(spark, folder), glob=None)
    nation = F.regexp_extract("file_path", "nation=([0-9]+)/", 1).cast("bigint")
    return pairs.select(nation.alias("nation"), "parent", "child", "n")


@query(
    "xml_nested_records",
    """SELECT r_name AS name, 'region' AS kind, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)
         + (SELECT count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n_inside FROM region
       UNION ALL SELECT n_name, 'nation', (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation
       UNION ALL SELECT s_name, 'supplier', 0 FROM supplier""",
)
def xml_nested_records(spark: SparkSession, folder: str) -> DataFrame:
    """Places inside places, all of one name: every one is a record, with all that is inside it."""
    place = lambda kind, name, inside: F.concat(F.lit("<place kind='a > b'><kind>"), F.lit(kind), F.lit("</kind><name>"), name, F.lit("</name>"), inside, F.lit("</place>"))
    joined = lambda rows, key: rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("xml")), "\n").alias("inside"))
    inside = F.coalesce("inside", F.lit(""))
    suppliers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), place("supplier", F.col("s_name"), F.lit("")).alias("xml"))
    nations = table(spark, folder, "nation").join(joined(suppliers, "n_nationkey"), "n_nationkey", "left")
    nations = nations.select(F.col("n_regionkey").alias("r_regionkey"), place("nation", F.col("n_name"), inside).alias("xml"))
    regions = table(spark, folder, "region").join(joined(nations, "r_regionkey"), "r_regionkey", "left")
    path = staging_path(spark, "places-xml")
    regions.select(place("region", F.col("r_name"), inside).alias("value")).write.text(path)
    records = scan_nested_records(spark, path, "place")
    first = lambda tag: F.regexp_extract("record", f"<{tag}>([^<]*)</{tag}>", 1).alias(tag)
    opened = F.regexp_count("record", F.lit("<place kind")).cast("long")
    return records.select(first("name"), first("kind"), (opened - 1).alias("n_inside"))


# --- text search -----------------------------------------------------------------------------------

_CUSTOMERS = "SELECT c_custkey AS pk, c_name AS text, c_name AS shown FROM customer"
_BUYERS = "SELECT DISTINCT c_name AS query_id, c_name AS text FROM customer JOIN orders ON o_custkey = c_custkey"


@query("search_rare_words", search_sql(_CUSTOMERS, _BUYERS, "exact"))
def search_rare_words(spark: SparkSession, folder: str) -> DataFrame:
    """Names that share one word with all others and have one of their own."""
    customers = table(spark, folder, "customer")
    entries = customers.select(F.col("c_custkey").alias("pk"), F.col("c_name").alias("text"), F.col("c_name").alias("shown"))
    buyers = customers.join(table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    asked = buyers.select(F.col("c_name").alias("query_id"), F.col("c_name").alias("text")).distinct()
    return build_index(entries).search(asked, "exact")


_STARTS = "SELECT DISTINCT lower(substr(c_name, 1, 2)) AS term FROM customer UNION SELECT DISTINCT lower(substr(p_name, 1, 3)) FROM part UNION SELECT DISTINCT lower(substr(p_type, 1, 1)) FROM part"


@query(
    "prefix_intervals",
    f"""SELECT term, count(*) AS n, min(match) AS first, max(match) AS last
     FROM ({_STARTS}), (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS match FROM documents)
     WHERE starts_with(match, term) GROUP BY term""",
)
def prefix_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of all documents begin like names in the tables, and which are first and last."""
    starts = [table(spark, folder, t).select(F.lower(F.substring(c, 1, n)).alias("term")) for t, c, n in (("customer", "c_name", 2), ("part", "p_name", 3), ("part", "p_type", 1))]
    prefixes = starts[0].union(starts[1]).union(starts[2]).distinct()
    words = table(spark, folder, "documents").select(F.explode(tokens(F.col("text"))).alias("match")).distinct()
    found = terms_with_prefix(prefixes, words)
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("match").alias("first"), F.max("match").alias("last"))


# --- ancestry ----------------------------------------------------------------------------------------

_PARENT = "CASE WHEN p_partkey <= 3 THEN p_partkey % 3 + 1 WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_partkey - 1 ELSE floor(p_partkey / 4) END"


@query(
    "tree_intervals",
    f"""WITH RECURSIVE raw AS (SELECT p_partkey AS node, CAST({_PARENT} AS BIGINT) AS parent FROM part),
       inside AS (SELECT node FROM raw UNION SELECT parent FROM raw WHERE parent IS NOT NULL),
       t AS (SELECT i.node, CASE WHEN i.node <= 3 AND i.node > 0 THEN NULL WHEN parent IN (1, 2, 3) THEN 1 ELSE parent END AS parent
         FROM inside i LEFT JOIN raw ON raw.node = i.node),
       up AS (SELECT node, node AS above, 0 AS d FROM t UNION ALL SELECT up.node, t.parent, d + 1 FROM up JOIN t ON t.node = above WHERE t.parent IS NOT NULL),
       c AS (SELECT node, CASE WHEN node BETWEEN 1 AND 3 THEN 1 ELSE node END AS place FROM t),
       top AS (SELECT node, arg_max(above, d) AS root, max(d) AS depth FROM up GROUP BY 1),
       sizes AS (SELECT above AS place, count(*) AS size FROM up WHERE node NOT IN (2, 3) GROUP BY 1),
       n AS (SELECT above AS place, count(*) AS held FROM up GROUP BY 1)
     SELECT c.node, CASE WHEN root BETWEEN 1 AND 3 THEN 1 ELSE root END AS root, CAST(depth AS BIGINT) AS depth, size,
       CASE WHEN c.node BETWEEN 1 AND 3 THEN 1 END AS cycle, CASE WHEN c.node BETWEEN 1 AND 3 THEN held + 1 ELSE held - 1 END AS n_below
     FROM c JOIN top ON top.node = c.node JOIN sizes ON sizes.place = c.place JOIN n ON n.place = c.place""",
)
def tree_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """A forest over parts, with chains and one cycle: what the intervals of all nodes hold."""
    parents = table(spark, folder, "part").select(F.col("p_partkey").alias("node"), F.expr(_PARENT).cast("bigint").alias("parent"))
    labels = stored(tree.tree_intervals(parents), "part-intervals")
    held = tree.below(labels, labels).groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_below"))
    size = (F.col("last") - F.col("first")).alias("size")
    return labels.join(held.hint("merge"), "node", "left").select("node", "root", "depth", size, "cycle", F.coalesce("n_below", F.lit(0)).alias("n_below"))


# --- loads that write what they change -------------------------------------------------------------------

_AGAIN = "p_partkey % 10 = 0"
_CHANGED = {"name": "concat('new ', p_brand)", "status": "CASE WHEN p_size > 25 THEN 'checked' END", "taxonomy": "named_struct('description', CASE WHEN p_size > 40 THEN p_type END)"}


def loaded_twice(spark: SparkSession, folder: str) -> GraphStore:
    """All metabolites, then a few again in records with fewer fields."""
    store = GraphStore(spark, staging_path(spark, "graph-twice"))
    parts = table(spark, folder, "part")
    for chosen, fields in ((parts, METABOLITE_FIELDS), (parts.where(_AGAIN), {"accession": METABOLITE_FIELDS["accession"]} | _CHANGED)):
        path = staging_path(spark, "twice-xml")
        xml_records(chosen, "metabolite", fields).select("record").write.text(path)
        load_metabolites(spark, store, path)
    return store


def _twice_sql() -> str:
    second = {name: _CHANGED.get(name, "CAST(NULL AS STRING)") for name in METABOLITE_PROPS}
    return f"""SELECT coalesce(n.accession, o.accession) AS accession,
      {", ".join(f"CASE WHEN n.accession IS NULL THEN o.{name} ELSE n.{name} END AS {name}" for name in METABOLITE_PROPS)},
      CASE WHEN td.accession IS NULL THEN t.taxonomy_description ELSE td.taxonomy_description END AS taxonomy_description
     FROM ({last_sql(ACC, METABOLITE_PROPS)}) o LEFT JOIN ({last_sql(ACC, second, _AGAIN)}) n ON n.accession = o.accession
     LEFT JOIN ({last_sql(ACC, {"taxonomy_description": "p_name"}, "p_size > 25")}) t ON t.accession = o.accession
     LEFT JOIN ({last_sql(ACC, {"taxonomy_description": "p_type"}, f"p_size > 40 AND {_AGAIN}")}) td ON td.accession = o.accession"""


@query("graph_load_twice", _twice_sql())
def graph_load_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Properties of nodes that two loads have written: the second takes away what it mentions without a value."""
    return loaded_twice(spark, folder).nodes("Metabolite")


def _profile_sql() -> str:
    """Samples of a graph that was loaded once: of each property at the smallest key that has it."""
    rows = []
    for label, key, props, rows_sql in (
        ("Metabolite", "accession", {"accession": ACC, **METABOLITE_PROPS}, last_sql(ACC, METABOLITE_PROPS)),
        ("Metabolite", "accession", {"taxonomy_description": "p_name"}, last_sql(ACC, {"taxonomy_description": "p_name"}, "p_size > 25")),
        ("Disease", "accession", {"diseaseName": "p_type", "omim_id": BIG}, last_sql("p_type", {"diseaseName": "p_type", "omim_id": BIG})),
        ("Tissue", "accession", {"tissueName": "p_name"}, last_sql("p_name", {"tissueName": "p_name"})),
    ):
        rows += [f"SELECT '{label}' AS label, '{name}' AS key, 'STRING' AS type, arg_min({name}, {key}) FILTER ({name} IS NOT NULL) AS sample FROM ({rows_sql}) HAVING count({name}) > 0" for name in props]
    return " UNION ALL ".join(rows)


@query("graph_catalog", _profile_sql())
def graph_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Properties and samples out of the profiles that a load leaves, for the labels that one table can state."""
    store = GraphStore(spark, staging_path(spark, "graph-catalog"))
    path = staging_path(spark, "catalog-xml")
    fields = {name: METABOLITE_FIELDS[name] for name in METABOLITE_FIELDS if name not in ("spectra", "general_references")}
    xml_records(table(spark, folder, "part"), "metabolite", fields).select("record").write.text(path)
    load_metabolites(spark, store, path)
    return store.node_properties().where(F.col("label").isin("Metabolite", "Disease", "Tissue"))


# --- subgraphs of many plans ---------------------------------------------------------------------------

_WANTED = "CASE c_custkey % 4 WHEN 0 THEN ['n_name', 'c_mktsegment'] WHEN 1 THEN ['c_mktsegment', 'n_name', 'n_name'] WHEN 2 THEN ['s_name'] ELSE ['colour'] END"
_LABEL = "CASE WHEN c_custkey % 3 = 0 THEN 'Supplier' ELSE 'Customer' END"


@query(
    "subgraph_classes",
    f"""WITH p AS (SELECT unnest(['Nation', {_LABEL}]) AS label, array_to_string(list_sort(list_distinct({_WANTED})), '+') AS wanted FROM customer),
       c AS (SELECT label, wanted, count(*) AS n FROM p GROUP BY 1, 2),
       l AS (SELECT label, string_agg(wanted || ':' || n, ';' ORDER BY wanted) AS classes, string_agg(wanted, '+') AS wanted FROM c GROUP BY 1)
     SELECT 'Nation' AS label, CAST(n_nationkey AS STRING) AS pk, CASE WHEN contains(wanted, 'n_name') THEN 'n_name=' || n_name ELSE '' END AS props, classes FROM nation, l WHERE label = 'Nation'
     UNION ALL SELECT 'Customer', CAST(c_custkey AS STRING), CASE WHEN contains(wanted, 'c_mktsegment') THEN 'c_mktsegment=' || c_mktsegment ELSE '' END, classes FROM customer, l WHERE label = 'Customer'
     UNION ALL SELECT 'Supplier', CAST(s_suppkey AS STRING), CASE WHEN contains(wanted, 's_name') THEN 's_name=' || s_name ELSE '' END, classes FROM supplier, l WHERE label = 'Supplier'""",
)
def subgraph_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One plan for every customer; they want a few sets of properties of three labels."""
    wanted = F.expr(_WANTED.replace("[", "array(").replace("]", ")"))
    names = F.create_map(F.lit("nodes"), F.array(F.lit("Nation"), F.expr(_LABEL)), F.lit("properties"), wanted)
    plans = table(spark, folder, "customer").select(F.col("c_custkey").alias("plan_id"), names.alias("nodes_and_relationships"))
    classes, _ = graph.plan_classes(plans)
    classes = stored(classes, "plan-classes")
    found = graph.subgraph_classes(classes, all_nodes(spark, folder))
    shown = F.concat(F.array_join("wanted", "+"), F.lit(":"), F.col("n_plans").cast("string"))
    text = classes.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list(shown)), ";").alias("shown"))
    pairs = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.join(text, "label").select("label", "pk", F.array_join(pairs, ",").alias("props"), F.col("shown").alias("classes"))


# --- think blocks --------------------------------------------------------------------------------------

_SPOKEN = """CASE (conv_id + turn) % 5 WHEN 0 THEN concat('a<think>  ', text) WHEN 1 THEN concat(text, ' </think>b<thi', 'nk></think><') WHEN 2 THEN concat('<think>', text, '</thin') ELSE text END"""
_STREAM = "CASE WHEN conv_id % 3 = 0 THEN -1 ELSE conv_id END"
_SLICE = 6


@query(
    "think_pieces",
    f"""WITH s AS (SELECT {_STREAM} AS stream, string_agg({_SPOKEN}, '' ORDER BY conv_id, turn) AS text FROM conversations GROUP BY 1),
       b AS (SELECT stream, text, regexp_extract_all(text, '(?s)<think>(.*?)</think>', 1) AS blocks FROM s)
     SELECT stream, CAST(0 AS BIGINT) AS block, regexp_replace(text, '(?s)<think>.*?</think>', '', 'g') AS text FROM b
     UNION ALL SELECT stream, i, blocks[i] FROM (SELECT stream, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM b) WHERE blocks[i] <> ''""",
)
def think_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as streams of chunks of a few characters, which cut tags at every place; one stream holds a third.

    The pieces are put together only here, to compare them with the whole texts.
    """
    turns = table(spark, folder, "conversations").select(F.expr(_STREAM).alias("stream"), "conv_id", "turn", F.expr(_SPOKEN).alias("text"))
    sliced = turns.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / _SLICE).cast("int"))))
    seq = (F.col("conv_id") * 1_000_000 + F.col("turn")) * 10_000 + F.col("i")
    chunks = sliced.select("stream", seq.alias("seq"), F.substr("text", F.col("i") * _SLICE + 1, F.lit(_SLICE)).alias("text"))
    pieces = think.think_pieces(chunks, ["stream"], F.floor(F.col("seq") / 200_000_000_000))
    parts = F.array_sort(F.collect_list(F.struct("seq", "part", "text")))
    texts = pieces.groupBy("stream", F.coalesce("block", F.lit(0)).alias("block")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    return texts


# --- resolution against a graph ----------------------------------------------------------------------------

_NAMED = """CASE WHEN p_size <= 20 THEN p_name WHEN p_size <= 30 THEN concat('supplier ', lpad(CAST(p_size AS STRING), 9, '0'))
  WHEN p_size <= 40 THEN concat('customer ', lpad(CAST(p_size AS STRING), 9, '0')) ELSE p_type END"""
_KIND = "CASE WHEN p_size <= 30 THEN 'Metabolite' WHEN p_size <= 40 THEN 'Protein' WHEN p_size <= 45 THEN 'Disease' ELSE 'Other' END"
_ASKED = f"SELECT p_partkey AS query_id, {_NAMED} AS text, {_KIND} AS type FROM part"
_METABOLITES = "SELECT concat('M', CAST(p_partkey AS STRING)) AS pk, p_name AS text, p_name AS shown FROM part"
_SYNONYMS = "SELECT s_name AS pk, s_name AS text, s_name AS shown FROM supplier"
_PROTEINS = "SELECT CAST(c_custkey AS STRING) AS pk, concat_ws(' ', CAST(c_custkey AS STRING), c_name, c_mktsegment) AS text, c_name AS shown FROM customer"
_DISEASES = "SELECT DISTINCT p_type AS pk, p_type AS text, p_type AS shown FROM part"


def _asked_sql(kind: str, rest: str = "true") -> str:
    return f"SELECT query_id, text FROM ({_ASKED}) WHERE type = '{kind}' AND {rest}"


@query(
    "graph_resolve",
    f"""WITH m AS (SELECT query_id, shown FROM ({search_sql(_METABOLITES, _asked_sql('Metabolite'), 'fuzzy', 0.5)}) WHERE rank = 1 AND score > 0.5),
       z AS ({search_sql(_SYNONYMS, _asked_sql('Metabolite', 'query_id NOT IN (SELECT query_id FROM m)'), 'fuzzy', 0.3)}),
       x AS ({search_sql(_SYNONYMS, _asked_sql('Metabolite', 'query_id NOT IN (SELECT query_id FROM m) AND query_id NOT IN (SELECT query_id FROM z)'), 'prefix')}),
       o AS (SELECT lower(s_name) AS alias_lc, arg_min(p_name, concat('M', CAST(p_partkey AS STRING))) AS owner
         FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1),
       s AS (SELECT query_id, arg_min(owner, rank) AS shown FROM (SELECT * FROM z UNION ALL SELECT * FROM x) JOIN o ON alias_lc = lower(shown) WHERE score > 2.0 GROUP BY 1),
       p AS (SELECT query_id, shown FROM ({search_sql(_PROTEINS, _asked_sql('Protein'), 'fuzzy', 0.5)}) WHERE rank = 1 AND score > 0.5),
       d AS (SELECT query_id, shown FROM ({search_sql(_DISEASES, _asked_sql('Disease'), 'fuzzy', 0.5)}) WHERE rank = 1 AND score > 0.5),
       hits AS (SELECT * FROM m UNION ALL SELECT * FROM s UNION ALL SELECT * FROM p UNION ALL SELECT * FROM d)
     SELECT a.query_id AS mention_id, a.text AS name, a.type, CASE WHEN a.type = 'Other' THEN a.text ELSE h.shown END AS matched
     FROM ({_ASKED}) a LEFT JOIN hits h ON h.query_id = a.query_id""",
)
def graph_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of four types against a stored graph: parts with their suppliers' names as synonyms, customers, part types."""
    store = GraphStore(spark, staging_path(spark, "graph-resolve"))
    part, supplier, customer = (table(spark, folder, name) for name in ("part", "supplier", "customer"))
    load = store.begin()
    accession = F.concat(F.lit("M"), "p_partkey")
    store.write_nodes("Metabolite", part.select(accession.alias("accession"), F.col("p_name").alias("name")), load)
    store.write_nodes("Synonym", supplier.select(F.col("s_name").alias("synonymText")), load)
    store.write_nodes("Protein", customer.select(F.col("c_custkey").cast("string").alias("proteinAcc"), F.col("c_name").alias("protein_name"), F.col("c_mktsegment").alias("gene_name")), load)
    store.write_nodes("Disease", part.select(F.col("p_type").alias("diseaseName")).distinct(), load)
    pairs = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    ends = F.lit("Metabolite").alias("src_label"), F.concat(F.lit("M"), "l_partkey").alias("src_key"), F.lit("HAS_SYNONYM").alias("rel_type"), F.lit("Synonym").alias("dst_label")
    store.write_edges(pairs.select(*ends, F.col("s_name").alias("dst_key")), load)
    store.publish(load)
    mentions = part.select(F.col("p_partkey").alias("mention_id"), F.expr(_NAMED).alias("name"), F.expr(_KIND).alias("type"))
    return resolved(store, mentions)


# --- small rows of operators that had none ---------------------------------------------------------------------


@query("graph_reset", "SELECT n_name AS name, CAST(2 AS BIGINT) AS finished FROM nation")
def graph_reset(spark: SparkSession, folder: str) -> DataFrame:
    """Two loads with a reset between them: what the first wrote is gone."""
    store = GraphStore(spark, staging_path(spark, "graph-reset"))
    for name, column in (("supplier", "s_name"), ("nation", "n_name")):
        load = store.begin()
        store.write_nodes("Tissue", table(spark, folder, name).select(F.col(column).alias("tissueName")), load)
        store.publish(load)
        if name == "supplier":
            store.reset()
    return store.nodes("Tissue").select(F.col("tissueName").alias("name"), F.lit(store.snapshot() - 1).cast("bigint").alias("finished"))


_ENTITY_TYPE = "CASE WHEN p_size > 25 THEN 'Metabolite' ELSE p_type END"


@query(
    "entities_of_type",
    f"""SELECT p_partkey AS question_id, CAST(0 AS INTEGER) AS pos, p_name AS name FROM part WHERE {_ENTITY_TYPE} = 'Metabolite' AND p_size % 9 <> 0
     UNION ALL SELECT p_partkey, 1, p_brand FROM part WHERE p_size % 9 <> 0""",
)
def entities_of_type(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of one type out of structured responses; responses that lack a field are rejected as a whole."""
    entity = lambda name, kind, sure: F.struct(name.alias("name"), kind.alias("type"), sure.alias("confidence"))
    sure = F.when(F.expr("p_size % 9 <> 0"), F.lit(0.5))
    listed = F.array(entity(F.col("p_name"), F.expr(_ENTITY_TYPE), sure), entity(F.col("p_brand"), F.lit("Metabolite"), F.lit(1.0)))
    said = table(spark, folder, "part").select(F.col("p_partkey").alias("question_id"), F.to_json(F.struct(listed.alias("entities"))).alias("said"))
    found = responses.of_type(responses.mentions(responses.parsed_entities(said, "said")))
    return found.select("question_id", "pos", "name")


@query(
    "nested_markup_text",
    "SELECT p_partkey AS accession, concat('about ', p_brand, ' <') AS description, CASE WHEN p_size > 25 THEN '' END AS status FROM part",
)
def nested_markup_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text of an element ends where its first child begins; an escaped sign is text."""
    xml = F.concat(
        F.lit("<metabolite><accession>"), "p_partkey", F.lit("</accession><description> about "), "p_brand", F.lit(" &lt; <i>more</i> and "), "p_type",
        F.lit("</description>"), F.expr("CASE WHEN p_size > 25 THEN '<status> <!-- none --> </status>' ELSE '<status/>' END"), F.lit("</metabolite>"),
    )
    path = staging_path(spark, "markup-xml")
    table(spark, folder, "part").select(xml.alias("value")).write.text(path)
    parsed = stored(parse_records(scan_records(spark, path, "metabolite"), {"accession": "text", "description": "text", "status": "text"}), "markup-records")
    return parsed.select(F.col("accession").cast("bigint").alias("accession"), "description", "status")


@query(
    "turn_chunk_rows",
    """WITH s AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS chunk
         FROM conversations WHERE role IN ('user', 'assistant'))
     SELECT conv_id, chunk, turn, CASE WHEN role = 'user' THEN 'user' WHEN turn % 3 = 0 THEN 'summary' ELSE 'code' END AS kind,
       CASE WHEN role = 'user' OR turn % 3 = 0 THEN text ELSE concat('```json', chr(10), text, chr(10), '```') END AS text FROM s""",
)
def turn_chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every third turn of an assistant is a summary; nothing is gathered."""
    section = F.when(F.expr("turn % 3 = 0"), conversation.SUMMARY).otherwise("Plan")
    chunks = conversation.turn_chunks(table(spark, folder, "conversations").withColumn("section", section))
    return conversation.chunk_rows(chunks).select("conv_id", "chunk", "turn", "kind", "text")
