"""Queries over the driver tables: sources, merges, catalog, patterns, ordered scans, messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import joined, or_empty, or_none, text_length
from ..operators import attempts, budget, catalog, conversation, graph, merge, ordered, responses, structure
from ..session import staging_path, stored
from ..sources import sse
from ..sources.graph_store import as_property_maps, run_query
from ..sources.xml_records import count_elements, parse_records, scan_records
from .registry import query, table

# --- XML files made from the tables ------------------------------------------------------------

LINE_SHAPE = {"orderkey": "text", "lines": {"line": [{"partkey": "text", "suppkey": "text", "linenumber": "text"}]}}
LINES_PER_RECORD = 1000


def _write_xml(records: DataFrame, tag: str, name: str) -> str:
    """Records (one structure column) as XML files in the shared folder."""
    path = staging_path(records.sparkSession, name)
    text = F.to_xml(F.col(records.columns[0]), {"rowTag": tag, "indent": ""})
    records.select(text.alias("value")).write.text(path)
    return path


def _order_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their lines; an order of very many lines becomes several records."""
    lines = table(spark, folder, "lineitem")
    line = F.struct(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_linenumber").alias("linenumber"))
    part_no = F.floor(F.col("l_linenumber") / LINES_PER_RECORD)
    grouped = lines.groupBy("l_orderkey", part_no.alias("part_no")).agg(F.collect_list(line).alias("line"))
    return grouped.select(F.struct(F.col("l_orderkey").alias("orderkey"), F.struct("line").alias("lines")).alias("record"))


@query("xml_record_count", "SELECT count(*) AS n FROM orders")
def xml_record_count(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    record = F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    path = _write_xml(orders.select(record.alias("record")), "order", "orders-xml")
    return count_elements(spark, path, "order").agg(F.sum("n").alias("n"))


@query(
    "xml_nested_lines",
    """SELECT CAST(l_orderkey AS BIGINT) AS orderkey, CAST(l_partkey AS BIGINT) AS partkey, count(*) AS n,
       CAST(max(l_linenumber) AS BIGINT) AS last_line FROM lineitem GROUP BY 1, 2""",
)
def xml_nested_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_xml(_order_records(spark, folder), "order", "lines-xml")
    records = stored(parse_records(scan_records(spark, path, "order"), LINE_SHAPE), "order-records")
    lines = records.select(F.col("orderkey").cast("bigint").alias("orderkey"), F.explode("lines.line").alias("l"))
    return lines.groupBy("orderkey", F.col("l.partkey").cast("bigint").alias("partkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("l.linenumber").cast("bigint")).alias("last_line")
    )


@query(
    "xml_tag_pairs",
    """SELECT * FROM (VALUES ('line', 'linenumber'), ('line', 'partkey'), ('line', 'suppkey'), ('lines', 'line'),
       ('order', 'lines'), ('order', 'orderkey')) AS t(parent, child)""",
)
def xml_tag_pairs(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_xml(_order_records(spark, folder), "order", "tags-xml")
    return structure.xml_structure(spark, path, "order", glob=None).select("parent", "child").distinct()


# --- merges ----------------------------------------------------------------------------------------


def _order_writes(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select(
        "o_custkey",
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("priority"),
        F.struct("o_orderdate", "o_orderkey").alias("_order"),
    )


@query(
    "node_merge_last_write",
    """WITH w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
         row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC) AS rf
       FROM orders)
     SELECT a.o_custkey, a.o_orderstatus AS status,
       CASE WHEN b.o_orderpriority <> '4-NOT SPECIFIED' THEN b.o_orderpriority END AS priority
     FROM w a LEFT JOIN w b ON b.o_custkey = a.o_custkey AND b.o_orderstatus = 'F' AND b.rf = 1 WHERE a.rn = 1""",
)
def node_merge_last_write(spark: SparkSession, folder: str) -> DataFrame:
    """Every order sets the status of its customer; finished ones set, or clear, the priority too."""
    writes = _order_writes(spark, folder)
    finished = F.col("status") == "F"
    return merge.merge_writers([writes.filter(~finished).drop("priority"), writes.filter(finished)], "o_custkey")


@query(
    "node_merge_maps",
    """SELECT user_id, event_type AS name, CAST(event_id AS STRING) AS value FROM (
       SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
     WHERE rn = 1 AND value >= 10""",
)
def node_merge_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Each event sets one property of its user; small values remove it."""
    events = table(spark, folder, "events")
    value = F.when(F.col("value") >= 10, F.col("event_id").cast("string"))
    writes = events.select(
        "user_id", F.struct("ts", "event_id").alias("_order"), F.create_map("event_type", value).alias("props")
    )
    return merge.merge_property_maps(writes, ["user_id"]).select("user_id", F.explode("props").alias("name", "value"))


def _supplied(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.lit("Part").alias("src_label"), F.col("l_partkey").cast("string").alias("src_key"),
        F.lit("SUPPLIED_BY").alias("rel_type"), F.lit("Supplier").alias("dst_label"),
        F.col("l_suppkey").cast("string").alias("dst_key"),
    )


@query(
    "edge_merge_distinct",
    """SELECT DISTINCT 'Part' AS src_label, CAST(l_partkey AS STRING) AS src_key, 'SUPPLIED_BY' AS rel_type,
       'Supplier' AS dst_label, CAST(l_suppkey AS STRING) AS dst_key FROM lineitem""",
)
def edge_merge_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return merge.distinct_edges([_supplied(spark, folder)])


@query(
    "edge_merge_props",
    """SELECT 'Part' AS src_label, CAST(l_partkey AS STRING) AS src_key, 'SUPPLIED_BY' AS rel_type, 'Supplier' AS dst_label,
       CAST(l_suppkey AS STRING) AS dst_key, name, value FROM (
       SELECT *, concat('shipped_', l_linestatus) AS name, CAST(l_shipdate AS STRING) AS value, row_number() OVER (
         PARTITION BY l_partkey, l_suppkey, l_linestatus ORDER BY l_orderkey DESC, l_linenumber DESC, l_shipdate DESC) AS rn FROM lineitem)
     WHERE rn = 1 AND l_quantity >= 10""",
)
def edge_merge_props(spark: SparkSession, folder: str) -> DataFrame:
    """Each line sets one property of its edge; small quantities remove it."""
    lines = table(spark, folder, "lineitem")
    value = F.when(F.col("l_quantity") >= 10, F.col("l_shipdate").cast("string"))
    writes = lines.select(
        F.lit("Part").alias("src_label"), F.col("l_partkey").cast("string").alias("src_key"),
        F.lit("SUPPLIED_BY").alias("rel_type"), F.lit("Supplier").alias("dst_label"), F.col("l_suppkey").cast("string").alias("dst_key"),
        F.struct("l_orderkey", "l_linenumber", "l_shipdate").alias("_order"),
        F.create_map(F.concat(F.lit("shipped_"), "l_linestatus"), value).alias("props"),
    )
    edges = merge.merge_edges(writes)
    return edges.select("src_label", "src_key", "rel_type", "dst_label", "dst_key", F.explode("props").alias("name", "value"))


@query(
    "edge_endpoint_check",
    """SELECT DISTINCT CAST(l_partkey AS STRING) AS src_key, CAST(l_suppkey AS STRING) AS dst_key FROM lineitem
     WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)
       AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)""",
)
def edge_endpoint_check(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").filter("p_size > 10")
    suppliers = table(spark, folder, "supplier").filter("s_acctbal > 0")
    nodes = parts.select(F.lit("Part").alias("label"), F.col("p_partkey").cast("string").alias("pk")).union(
        suppliers.select(F.lit("Supplier").alias("label"), F.col("s_suppkey").cast("string").alias("pk"))
    )
    edges = merge.distinct_edges([_supplied(spark, folder)])
    return merge.with_endpoints(edges, nodes).select("src_key", "dst_key")


@query(
    "conditional_update",
    """WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
       FROM orders) WHERE rn = 1)
     SELECT c_custkey, CASE WHEN u.o_custkey IS NULL THEN c_mktsegment WHEN u.o_orderpriority <> '4-NOT SPECIFIED'
       THEN u.o_orderpriority END AS c_mktsegment
     FROM customer LEFT JOIN u ON u.o_custkey = c_custkey""",
)
def conditional_update(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    updates = _order_writes(spark, folder).select(
        F.col("o_custkey").alias("c_custkey"), F.col("priority").alias("c_mktsegment"), "_order"
    )
    return merge.update_matching(customers, updates, "c_custkey")


@query(
    "already_loaded_anti",
    """SELECT c_custkey, c_name FROM customer
     WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def already_loaded_anti(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'")
    return merge.not_loaded(customers, urgent, "c_custkey", "o_custkey")


@query(
    "synthetic_keys",
    """SELECT concat('genRef_', source, '_', coalesce(nullif(lang, 'en'), ''), '_', CAST(length(text) AS STRING)) AS ref_key,
       concat(source, '_', coalesce(nullif(lang, 'en'), 'None')) AS kind_key, count(*) AS n, min(doc_id) AS first_doc
     FROM documents GROUP BY 1, 2""",
)
def synthetic_keys(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lang = F.nullif(F.col("lang"), F.lit("en"))
    ref = joined(F.lit("genRef"), F.col("source"), or_empty(lang), text_length(F.col("text")))
    keyed = docs.select(ref.alias("ref_key"), joined(F.col("source"), or_none(lang)).alias("kind_key"), "doc_id")
    return keyed.groupBy("ref_key", "kind_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    "list_positions",
    """SELECT concat(CAST(doc_id AS STRING), '_tm_', CAST(pos AS STRING)) AS region_id, line AS description FROM (
       SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""",
)
def list_positions(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = joined(F.col("doc_id").cast("string"), F.lit("tm"), (F.col("pos") + 1).cast("string"))
    return lines.select(key.alias("region_id"), F.col("line").alias("description"))


# --- catalog over the tables as a graph ----------------------------------------------------------------

NODE_TABLES = {"Customer": "customer", "Nation": "nation", "Order": "orders", "Part": "part", "Region": "region", "Supplier": "supplier"}
NODE_FIELDS = {
    "Customer": {"c_custkey": "INTEGER", "c_name": "STRING", "c_nationkey": "INTEGER", "c_acctbal": "FLOAT", "c_mktsegment": "STRING"},
    "Nation": {"n_nationkey": "INTEGER", "n_name": "STRING", "n_regionkey": "INTEGER"},
    "Order": {"o_orderkey": "INTEGER", "o_custkey": "INTEGER", "o_orderstatus": "STRING", "o_totalprice": "FLOAT",
              "o_orderdate": "DATETIME", "o_orderpriority": "STRING"},
    "Part": {"p_partkey": "INTEGER", "p_name": "STRING", "p_brand": "STRING", "p_type": "STRING", "p_size": "INTEGER", "p_retailprice": "FLOAT"},
    "Region": {"r_regionkey": "INTEGER", "r_name": "STRING"},
    "Supplier": {"s_suppkey": "INTEGER", "s_name": "STRING", "s_nationkey": "INTEGER", "s_acctbal": "FLOAT"},
}
EDGE_TABLES = {  # type: (table, source label and key, target label and key)
    "IN_NATION": [("customer", "Customer", "c_custkey", "Nation", "c_nationkey"), ("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey")],
    "IN_REGION": [("nation", "Nation", "n_nationkey", "Region", "n_regionkey")],
    "PLACED_BY": [("orders", "Order", "o_orderkey", "Customer", "o_custkey")],
    "SUPPLIED_BY": [("lineitem", "Part", "l_partkey", "Supplier", "l_suppkey")],
}


def _node_tables(spark: SparkSession, folder: str) -> catalog.Tables:
    return {label: (table(spark, folder, name), next(iter(NODE_FIELDS[label]))) for label, name in NODE_TABLES.items()}


def _graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    frames = [
        table(spark, folder, name).select(
            F.lit(src).alias("src_label"), F.col(src_key).cast("string").alias("src_key"), F.lit(rel).alias("rel_type"),
            F.lit(dst).alias("dst_label"), F.col(dst_key).cast("string").alias("dst_key"),
        )
        for rel, sources in EDGE_TABLES.items()
        for name, src, src_key, dst, dst_key in sources
    ]
    return reduce(DataFrame.union, frames)


def _props_sql(with_sample: bool) -> str:
    parts = []
    for label, fields in NODE_FIELDS.items():
        key = next(iter(fields))
        for name, kind in fields.items():
            shown = {"FLOAT": f"printf('%.6f', {name})", "DATETIME": f"strftime({name}, '%Y-%m-%d %H:%M:%S')"}.get(kind, f"CAST({name} AS STRING)")
            sample = f"arg_min({shown}, {key}) FILTER ({name} IS NOT NULL)"
            extra = f", {sample} AS sample" if with_sample else ""
            parts.append(f"SELECT '{label}' AS label, '{name}' AS key, '{kind}' AS type{extra} FROM {NODE_TABLES[label]} HAVING count({name}) > 0")
    return " UNION ALL ".join(parts)


_MAPPINGS_SQL = " UNION ".join(
    f"SELECT '{src}' AS src_label, '{rel}' AS rel_type, '{dst}' AS dst_label,"
    f" '(:{src})-[:{rel}]->(:{dst})' AS mapping FROM {name} WHERE {key} IS NOT NULL"
    for rel, sources in EDGE_TABLES.items()
    for name, src, key, dst, _ in sources
)


@query("catalog_node_props", _props_sql(True))
def catalog_node_props(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.node_properties(_node_tables(spark, folder), catalog.sample_text)


@query("catalog_mappings", _MAPPINGS_SQL)
def catalog_mappings(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.edge_mappings(_graph_edges(spark, folder))


@query("catalog_labels", " UNION ".join(f"SELECT '{label}' AS label FROM {name}" for label, name in NODE_TABLES.items()))
def catalog_labels(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.labels(_node_tables(spark, folder))


@query("catalog_edge_types", f"SELECT DISTINCT rel_type FROM ({_MAPPINGS_SQL})")
def catalog_edge_types(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.edge_types(_graph_edges(spark, folder))


@query(
    "catalog_text",
    f"""WITH p AS ({_props_sql(False)}), m AS ({_MAPPINGS_SQL}),
    blocks AS (SELECT label, '(:' || label || ') {{' || chr(10) || string_agg('  ' || key || ': ' || type, ',' || chr(10) ORDER BY key)
      || chr(10) || '}}' || chr(10) AS line FROM p GROUP BY label),
    lines AS (SELECT 0 AS s, '' AS name, '## Node Definitions' AS line UNION ALL SELECT 1, label, line FROM blocks
      UNION ALL SELECT 2, '', '## Relationship Definitions'
      UNION ALL SELECT DISTINCT 3, rel_type, '[:' || rel_type || '] {{ -- No properties -- }}' || chr(10) FROM m
      UNION ALL SELECT 4, '', '## Relationship Mappings'
      UNION ALL SELECT 5, rel_type || chr(31) || src_label || chr(31) || dst_label, mapping FROM m)
    SELECT string_agg(line, chr(10) ORDER BY s, name) AS catalog FROM lines""",
)
def catalog_text(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.catalog_text(_node_tables(spark, folder), _graph_edges(spark, folder))


@query(
    "catalog_map_props",
    """SELECT rel_type, key, arg_min(value, src_key) AS sample FROM (
       SELECT l_returnflag AS rel_type, 'status' AS key, l_linestatus AS value,
         concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING), '/', l_linestatus) AS src_key FROM lineitem)
     GROUP BY 1, 2""",
)
def catalog_map_props(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    edges = lines.select(
        F.col("l_returnflag").alias("rel_type"),
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus").alias("src_key"),
        F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("unset"), F.lit(None).cast("string")).alias("props"),
    )
    return catalog.map_properties(edges, "rel_type", "src_key")


@query(
    "label_list_pairs",
    """SELECT l_returnflag AS src_label, 'Line' AS dst_label, count(*) AS n FROM lineitem GROUP BY 1
     UNION ALL SELECT l_returnflag, l_linestatus, count(*) FROM lineitem GROUP BY 1, 2
     UNION ALL SELECT 'Flag', 'Line', count(*) FROM lineitem UNION ALL SELECT 'Flag', l_linestatus, count(*) FROM lineitem GROUP BY 2""",
)
def label_list_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between nodes of two labels each: every label pair counts once."""
    lines = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    pairs = lines.select(
        F.array("l_returnflag", F.lit("Flag")).alias("src_labels"), F.array("l_linestatus", F.lit("Line")).alias("dst_labels"), "n"
    )
    return catalog.label_pairs(pairs).groupBy("src_label", "dst_label").agg(F.sum("n").alias("n"))


@query(
    "runtime_types",
    """SELECT 'INTEGER' AS type, count(*) AS n FROM events WHERE event_type IN ('click', 'view')
     UNION ALL SELECT 'MAP', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'STRING', count(*) FROM events WHERE event_type = 'signup'
     UNION ALL SELECT 'LIST', count(*) FROM events WHERE event_type = 'purchase'""",
)
def runtime_types(spark: SparkSession, folder: str) -> DataFrame:
    """Types decided per value: the JSON of an event differs by its kind."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", F.col("props"))
        .when(kind == "signup", F.concat(F.lit('"'), kind, F.lit('"')))
        .when(kind == "purchase", F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")))
        .otherwise(F.col("event_id").cast("string"))
    )
    value = F.try_parse_json(text)
    return table(spark, folder, "events").groupBy(catalog.variant_type_name(value).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "key_violations",
    """SELECT 'Line' AS label, 'l_orderkey' AS key_name, CAST(l_orderkey AS STRING) AS key_value, count(*) AS n FROM lineitem GROUP BY 3 HAVING count(*) > 1
     UNION ALL SELECT 'Part', 'p_name', p_name, count(*) FROM part GROUP BY 3 HAVING count(*) > 1
     UNION ALL SELECT 'Customer', 'c_custkey', CAST(c_custkey AS STRING), count(*) FROM customer GROUP BY 3 HAVING count(*) > 1""",
)
def key_violations(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"Line": ("lineitem", "l_orderkey"), "Part": ("part", "p_name"), "Customer": ("customer", "c_custkey")}
    return catalog.key_violations({label: (table(spark, folder, name), key) for label, (name, key) in keys.items()})


@query(
    "graph_counts",
    "SELECT rel_type, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{rel}' AS rel_type FROM {s[0]}" for rel, sources in EDGE_TABLES.items() for s in sources)
    + ") GROUP BY 1",
)
def graph_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _graph_edges(spark, folder).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


# --- patterns -------------------------------------------------------------------------------------------


@query(
    "one_hop_ci",
    """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
     WHERE lower(n_name) IN (SELECT lower(replace(r_name, r_name, concat('nation_', CAST(r_regionkey AS STRING)))) FROM region)""",
)
def one_hop_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in nations that are named, in another case, after a region number."""
    names = table(spark, folder, "region").select(F.concat(F.lit("nation_"), "r_regionkey").alias("name"))
    nations = graph.matching_name(table(spark, folder, "nation"), names, "n_name")
    hops = graph.one_hop(
        graph.of_type(_graph_edges(spark, folder), "IN_NATION", "Customer", "Nation"),
        table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("src_key"), "c_custkey"),
        nations.select(F.col("n_nationkey").cast("string").alias("dst_key"), "n_name"),
    )
    return hops.select("c_custkey", "n_name")


@query(
    "or_exists_lookup",
    """WITH m AS (SELECT concat('S', CAST(s_suppkey AS STRING)) AS mention_id, upper(s_name) AS name FROM supplier
       UNION ALL SELECT DISTINCT p_name, upper(p_name) FROM part)
     SELECT mention_id, p_partkey, p_type AS description FROM m JOIN part ON lower(p_name) = lower(name)
     UNION SELECT mention_id, p_partkey, p_type FROM m JOIN supplier ON lower(s_name) = lower(name)
       JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey""",
)
def or_exists_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Parts called by their own name or by the name of a supplier of theirs."""
    parts = table(spark, folder, "part")
    suppliers = table(spark, folder, "supplier")
    mentions = suppliers.select(
        F.concat(F.lit("S"), "s_suppkey").alias("mention_id"), F.upper("s_name").alias("name")
    ).union(parts.select("p_name", F.upper("p_name")).distinct())
    supplied = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    aliases = supplied.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("pk"), F.col("s_name").alias("alias")
    )
    nodes = parts.select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return graph.described(mentions, nodes, aliases).select("mention_id", F.col("pk").alias("p_partkey"), "description")


@query(
    "tree_closure",
    """WITH RECURSIVE e AS (SELECT concat('R', CAST(n_regionkey AS STRING)) AS src, concat('N', CAST(n_nationkey AS STRING)) AS dst FROM nation
       UNION ALL SELECT concat('N', CAST(c_nationkey AS STRING)), concat('C', CAST(c_custkey AS STRING)) FROM customer),
     t AS (SELECT src AS ancestor, dst AS descendant, 1 AS depth FROM e
       UNION ALL SELECT ancestor, dst, depth + 1 FROM t JOIN e ON src = descendant)
     SELECT ancestor, descendant, min(depth) AS depth FROM t GROUP BY 1, 2""",
)
def tree_closure(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select(
        F.concat(F.lit("R"), "n_regionkey").alias("src"), F.concat(F.lit("N"), "n_nationkey").alias("dst")
    )
    customers = table(spark, folder, "customer").select(
        F.concat(F.lit("N"), "c_nationkey").alias("src"), F.concat(F.lit("C"), "c_custkey").alias("dst")
    )
    return graph.closure(nations.union(customers))


def _plans(spark: SparkSession, folder: str) -> DataFrame:
    names = F.create_map(
        F.lit("nodes"), F.array(F.lit("Nation"), F.when(F.col("r_regionkey") > 1, "Customer").otherwise("Supplier"), F.col("r_name")),
        F.lit("relationships"), F.array(F.lit("IN_NATION"), F.concat(F.lit("IN_"), "r_name")),
        F.lit("properties"), F.array(F.lit("n_name"), F.lit("c_mktsegment"), F.lit("colour")),
    )
    return table(spark, folder, "region").select(F.col("r_regionkey").alias("plan_id"), names.alias("nodes_and_relationships"))


def _all_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(DataFrame.union, [as_property_maps(t, label, key) for label, (t, key) in _node_tables(spark, folder).items()])


@query(
    "subgraph_by_plan",
    """SELECT r_regionkey AS plan_id, 'Nation' AS label, CAST(n_nationkey AS STRING) AS pk, concat('n_name=', n_name) AS props FROM region, nation
     UNION ALL SELECT r_regionkey, 'Customer', CAST(c_custkey AS STRING), concat('c_mktsegment=', c_mktsegment) FROM region, customer WHERE r_regionkey > 1
     UNION ALL SELECT r_regionkey, 'Supplier', CAST(s_suppkey AS STRING), '' FROM region, supplier WHERE r_regionkey <= 1""",
)
def subgraph_by_plan(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.subgraph_nodes(_plans(spark, folder), _all_nodes(spark, folder))
    pairs = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.withColumn("props", F.array_join(pairs, ","))


@query(
    "subgraph_edges_by_plan",
    """SELECT r_regionkey AS plan_id, 'Customer' AS src_label, CAST(c_custkey AS STRING) AS src_key, CAST(c_nationkey AS STRING) AS dst_key FROM region, customer
     UNION ALL SELECT r_regionkey, 'Supplier', CAST(s_suppkey AS STRING), CAST(s_nationkey AS STRING) FROM region, supplier""",
)
def subgraph_edges_by_plan(spark: SparkSession, folder: str) -> DataFrame:
    return graph.subgraph_edges(_plans(spark, folder), _graph_edges(spark, folder)).select("plan_id", "src_label", "src_key", "dst_key")


@query(
    "plan_unknown_names",
    """SELECT r_regionkey AS plan_id, 'nodes' AS kind, r_name AS name FROM region
     UNION ALL SELECT r_regionkey, 'relationships', concat('IN_', r_name) FROM region UNION ALL SELECT r_regionkey, 'properties', 'colour' FROM region""",
)
def plan_unknown_names(spark: SparkSession, folder: str) -> DataFrame:
    tables = _node_tables(spark, folder)
    edges = _graph_edges(spark, folder)
    return graph.unknown_names(
        _plans(spark, folder), catalog.labels(tables), edges.select("rel_type"), catalog.node_properties(tables).select("key")
    )


# --- budgets, limits, unions -------------------------------------------------------------------------------

_RECORD_JSON = "CAST(to_json({'doc_id': doc_id, 'lang': lang, 'text': text}) AS STRING)"


@query(
    "size_budget_prefix",
    f"""WITH d AS (SELECT doc_id, source, {_RECORD_JSON} AS j FROM documents),
     s AS (SELECT doc_id, source, length(j) + 5 + 5 * length(regexp_replace(j, '[\\x00-\\x7e]', '', 'g'))
       + 6 * length(regexp_replace(j, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS size FROM d),
     r AS (SELECT doc_id, source, sum(size) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM s)
     SELECT source, doc_id FROM r WHERE used <= 5000""",
)
def size_budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("source", "doc_id", F.struct("doc_id", "lang", "text").alias("record"))
    size = budget.spaced_json_length(F.col("record"), 3)
    block = F.floor(F.col("doc_id") / 1000)
    return budget.within_budget(docs, ["source"], ["doc_id"], size, block=block).select("source", "doc_id")


@query(
    "budget_small_rows",
    """WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, 1 + l_orderkey % 3 AS size FROM lineitem)
     SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, sum(size) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS used FROM s) WHERE used <= 700""",
)
def budget_small_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one to three characters: hundreds of them fit a budget."""
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    size, block = 1 + F.col("l_orderkey") % 3, F.floor(F.col("l_orderkey") / 1000)
    return budget.within_budget(items, ["l_suppkey"], ["l_orderkey", "l_linenumber"], size, 700, block)


@query("limit_ordered", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_ordered(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("kg_orders")
    text = "SELECT o_orderkey, o_custkey FROM kg_orders WHERE o_orderpriority = :priority ORDER BY o_totalprice DESC, o_orderkey;"
    return run_query(spark, text, {"priority": "1-URGENT"}, limit=25)


@query(
    "budgeted_result",
    """WITH o AS (SELECT c_custkey, c_name, c_mktsegment, length(CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment}) AS STRING)) + 5 AS size,
       row_number() OVER (ORDER BY c_mktsegment, c_custkey DESC) AS seq FROM customer)
     SELECT c_custkey, c_name, c_mktsegment FROM (SELECT *, sum(size) OVER (ORDER BY seq) AS used FROM o) WHERE used <= 5000""",
)
def budgeted_result(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "customer").createOrReplaceTempView("kg_customer")
    text = "SELECT c_custkey, c_name, c_mktsegment FROM kg_customer ORDER BY c_mktsegment, c_custkey DESC"
    return run_query(spark, text, budget=budget.BUDGET)


@query(
    "context_pack",
    """WITH r AS (SELECT o_custkey AS question_id, 0 AS part, o_orderkey AS seq,
         concat('{"order":', CAST(o_orderkey AS STRING), ',"status":"', o_orderstatus, '"}') AS record FROM orders
       UNION ALL SELECT c_custkey, 1, c_custkey, concat('{"segment":"', c_mktsegment, '"}') FROM customer),
     s AS (SELECT *, sum(length(record)) OVER (PARTITION BY question_id ORDER BY part, seq) AS used FROM r)
     SELECT question_id, part, seq, record FROM s WHERE used <= 300""",
)
def context_pack(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("seq"),
        F.concat(F.lit('{"order":'), "o_orderkey", F.lit(',"status":"'), "o_orderstatus", F.lit('"}')).alias("record"),
    )
    descriptions = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("question_id"), F.col("c_custkey").alias("seq"),
        F.concat(F.lit('{"segment":"'), "c_mktsegment", F.lit('"}')).alias("record"),
    )
    return budget.context_pack(results, descriptions, 300).select("question_id", "part", "seq", "record")


@query(
    "union_descriptions",
    """SELECT c_custkey AS pk, c_name AS name, c_mktsegment AS segment, CAST(NULL AS STRING) AS type FROM customer
     UNION ALL SELECT p_partkey, p_name, NULL, p_type FROM part""",
)
def union_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return customers.unionByName(parts, allowMissingColumns=True)


# --- ordered scans -------------------------------------------------------------------------------------------

_SECTION_SQL = "CASE WHEN length(text) < 300 THEN 'Summary' WHEN length(text) < 700 THEN 'Query execution' ELSE 'Reasoning' END"
_CHUNKS_SQL = """SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS chunk
  FROM conversations WHERE role IN ('user', 'assistant')"""


@query("turn_chunks", f"SELECT conv_id, turn, role, CAST(chunk AS BIGINT) AS chunk FROM ({_CHUNKS_SQL})")
def turn_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return conversation.turn_chunks(table(spark, folder, "conversations")).select("conv_id", "turn", "role", "chunk")


@query(
    "turn_chunk_summary",
    f"""WITH c AS (SELECT *, {_SECTION_SQL} AS section FROM ({_CHUNKS_SQL}))
     SELECT conv_id, CAST(chunk AS BIGINT) AS chunk, coalesce(max(CASE WHEN role = 'user' THEN text END), '') AS user_text,
       count(*) FILTER (role = 'assistant' AND section <> 'Summary') AS n_items,
       coalesce(string_agg(concat('```', CASE WHEN section = 'Query execution' THEN 'cypher' ELSE 'json' END, chr(10), text, chr(10), '```'), '' ORDER BY turn)
         FILTER (role = 'assistant' AND section <> 'Summary'), '') AS code,
       coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant' AND section = 'Summary'), '') AS summary_text
     FROM c GROUP BY 1, 2""",
)
def turn_chunk_summary(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "conversations").withColumn("section", F.expr(_SECTION_SQL))
    found = conversation.chunk_summaries(conversation.turn_chunks(messages))
    code = F.array_join(F.transform("items", lambda item: item["code"]), "")
    return found.select("conv_id", "chunk", "user_text", F.size("items").cast("bigint").alias("n_items"), code.alias("code"), "summary_text")


def _minute() -> Column:
    """Blocks for scans ordered by time: even a user with most events has few in a minute.

    Counted from the fields of a time without zone, so that no clock change breaks the order.
    """
    return F.unix_date(F.to_date("ts")).cast("bigint") * 1440 + F.hour("ts") * 60 + F.minute("ts")


_RUNS_SQL = """WITH e AS (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER w = 'assistant' AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS c
       FROM ({spoken}) WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
     r AS (SELECT *, sum(c) OVER (PARTITION BY {key} ORDER BY {order}) AS run FROM e)
     SELECT {key}, CAST(run AS BIGINT) AS run, role, kind, count(*) AS n, string_agg(said, '' ORDER BY {order}) AS text
     FROM r GROUP BY {key}, run, role, kind"""


@query(
    "coalesce_sections",
    _RUNS_SQL.format(spoken=f"SELECT conv_id, turn, role, {_SECTION_SQL} AS kind, text AS said FROM conversations", key="conv_id", order="turn"),
)
def coalesce_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive answers of a kind, joined; every other message stays alone."""
    messages = table(spark, folder, "conversations").withColumn("kind", F.expr(_SECTION_SQL))
    runs = conversation.coalesce_sections(messages, ["conv_id"], ["turn"], conversation.turn_block(F.col("turn")), "kind")
    return runs.withColumn("run", F.col("run").cast("bigint"))


@query(
    "coalesce_events",
    _RUNS_SQL.format(
        spoken="""SELECT user_id, ts, event_id, event_type AS kind, concat(CAST(event_id AS STRING), ';') AS said,
          CASE WHEN event_type = 'purchase' THEN 'user' ELSE 'assistant' END AS role FROM events WHERE event_type <> 'signup'""",
        key="user_id",
        order="ts, event_id",
    ),
)
def coalesce_events(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive events of a kind, joined; signups stand for the end markers, purchases for the user's messages."""
    marked = F.when(F.col("event_type") == "signup", conversation.DONE).otherwise(F.concat("event_id", F.lit(";")))
    role = F.when(F.col("event_type") == "purchase", "user").otherwise("assistant")
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("kind"), role.alias("role"), marked.alias("text"))
    runs = conversation.coalesce_sections(events, ["user_id"], ["ts", "event_id"], _minute(), "kind")
    return runs.withColumn("run", F.col("run").cast("bigint"))


@query(
    "drop_repeats",
    """SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
     WHERE p IS NULL OR p <> event_type""",
)
def drop_repeats(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    return ordered.drop_repeats(events, ["user_id"], ["ts", "event_id"], _minute(), "event_type").select("user_id", "event_id", "event_type")


def _attempt_log(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    log = events.select(
        F.col("user_id").alias("question_id"), "ts", "event_id", "event_type",
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), "event_id")).alias("error"),
        F.when(F.col("event_type") == "view", 0).otherwise(1).alias("n_results"),
    )
    return attempts.numbered(log, ["question_id"], ["ts", "event_id"], _minute())


_LOG_SQL = """SELECT user_id AS question_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events"""


@query("last_three", f"SELECT question_id, attempt, event_id FROM ({_LOG_SQL}) WHERE back <= 3")
def last_three(spark: SparkSession, folder: str) -> DataFrame:
    return attempts.newest_attempts(_attempt_log(spark, folder)).select("question_id", "attempt", "event_id")


@query(
    "attempt_outcomes",
    f"""SELECT question_id, count(*) AS n_attempts, count(*) FILTER (event_type = 'error') AS n_errors,
       min(attempt) FILTER (event_type <> 'error') AS first_success,
       CASE max(event_type) FILTER (back = 1) WHEN 'view' THEN 'empty' WHEN 'error' THEN
         CASE WHEN count(*) FILTER (event_type = 'error') > 5 THEN 'exhausted' ELSE 'failed' END ELSE 'success' END AS status
     FROM ({_LOG_SQL}) GROUP BY question_id""",
)
def attempt_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return attempts.outcomes(_attempt_log(spark, folder))


def _until_sql(done: str, retries: int, names: tuple[str, str]) -> str:
    return f"""WITH s AS (SELECT question_id, count(*) AS n, min(attempt) FILTER ({done}) AS d FROM ({_LOG_SQL}) GROUP BY 1)
     SELECT question_id, CAST(least(coalesce(d, n) - 1, {retries}) AS BIGINT) AS retries,
       CASE WHEN d <= {retries + 1} THEN '{names[0]}' WHEN n > {retries} THEN '{names[1]}' ELSE 'open' END AS status FROM s"""


@query("empty_retry_outcomes", _until_sql("event_type = 'purchase'", 5, ("found", "none")))
def empty_retry_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases stand for results with rows."""
    log = _attempt_log(spark, folder).withColumn("n_results", F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    return attempts.empty_outcomes(log)


@query("sufficiency_outcomes", _until_sql("event_type = 'signup'", 3, ("sufficient", "insufficient")))
def sufficiency_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Signups stand for the judgement that results suffice."""
    return attempts.sufficiency_outcomes(_attempt_log(spark, folder).withColumn("should_retry", F.col("event_type") != "signup"))


# --- messages ---------------------------------------------------------------------------------------------------

_TAGGED_SQL = "CASE WHEN role = 'assistant' THEN concat('a<think>  ', substr(text, 1, 25), chr(10), '</think>b<think> </think>', substr(text, 26)) ELSE text END"


@query(
    "think_split",
    f"""WITH c AS (SELECT conv_id, turn, {_TAGGED_SQL} AS text FROM conversations WHERE role <> 'system'),
     s AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM c GROUP BY 1)
     SELECT conv_id, regexp_replace(text, '(?s)<think>.*?</think>', '', 'g') AS text,
       array_to_string(list_filter(list_transform(regexp_extract_all(text, '(?s)<think>(.*?)</think>', 1),
         lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '|') AS thinking FROM s""",
)
def think_split(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as chunks of a stream; system turns count as fences."""
    messages = table(spark, folder, "conversations")
    text = F.when(F.col("role") == "system", "```json").otherwise(F.expr(_TAGGED_SQL.replace("chr(10)", "'\\n'")))
    chunks = messages.select("conv_id", F.col("turn").alias("seq"), F.col("role").alias("section"), text.alias("text"))
    found = conversation.split_thinking(conversation.stage_texts(conversation.content_chunks(chunks), ["conv_id"]))
    return found.select("conv_id", "text", F.array_join("thinking", "|").alias("thinking"))


@query(
    "fence_filter",
    "SELECT p_partkey FROM part WHERE NOT (p_size BETWEEN 10 AND 30)",
)
def fence_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that are nothing but a fence are dropped; a fence inside a chunk stays."""
    text = (
        F.when(F.col("p_size").between(10, 20), "```cypher\n")
        .when(F.col("p_size").between(21, 30), "pher")
        .otherwise(F.concat(F.lit("```"), "p_name"))
    )
    chunks = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("section"), text.alias("text"))
    return conversation.content_chunks(chunks).select("p_partkey")


_RESPONSE_SQL = "CASE event_type WHEN 'error' THEN substr(props, 1, 5) WHEN 'view' THEN '{\"other\": 1}' ELSE props END"


@query(
    "strict_json",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'malformed' WHEN 'view' THEN 'incomplete' END AS rejected,
       CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def strict_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", F.expr(_RESPONSE_SQL).alias("response"))
    return responses.parsed(rows, "response", "k bigint").select("event_id", "rejected", F.col("parsed.k").alias("k"))


@query(
    "response_mentions",
    """SELECT p_partkey AS question_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN p_name ELSE p_brand END AS name,
       CASE pos WHEN 0 THEN 'Metabolite' ELSE p_type END AS type, CAST(0.5 AS DOUBLE) AS confidence
     FROM part, (VALUES (0), (1)) AS v(pos) WHERE p_size <= 40""",
)
def response_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of responses; those of large parts lack a confidence and are rejected whole."""
    confidence = F.when(F.col("p_size") <= 40, F.lit(0.5))
    entities = F.array(
        F.struct(F.col("p_name").alias("name"), F.lit("Metabolite").alias("type"), F.lit(0.5).alias("confidence")),
        F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("type"), confidence.alias("confidence")),
    )
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").alias("question_id"), F.to_json(F.struct(entities.alias("entities"))).alias("response")
    )
    return responses.mentions(responses.parsed_entities(rows, "response"))


@query("sse_roundtrip", "SELECT role AS section, text FROM conversations")
def sse_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "sse")
    sse.write_events(table(spark, folder, "conversations"), path, "role", "text")
    return sse.read_events(spark, path).select("section", "text")


@query(
    "sse_distinct",
    """SELECT user_id, event_id, event_type AS section FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events
     WHERE event_type <> 'view') WHERE (p IS NULL OR p <> event_type) AND event_type <> 'error'""",
)
def sse_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user as one stream: views are no events, errors are no JSON."""
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    message = sse.event_text(kind, F.lit("x"))
    piece = F.when(kind == "view", "event: view").when(kind == "error", "data:{broken").otherwise(message)
    pieces = events.select(
        "user_id", "event_id", F.col("user_id").alias("_file"), _minute().alias("_block"), F.struct("ts", "event_id").alias("_row"), piece.alias("piece")
    )
    return sse.distinct_events_of(pieces).select("user_id", "event_id", "section")
