"""Profiling of graph tables: keys, sample values, types, endpoint mappings, key checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tables = dict[str, tuple[DataFrame, str]]  # label -> (typed table, key column)


def type_name(kind: T.DataType) -> str:
    """Name of a property type as the catalog prints it."""
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, T.IntegralType):
        return "INTEGER"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "FLOAT"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "STRING"
    if isinstance(kind, T.ArrayType):
        return "LIST"
    if isinstance(kind, (T.MapType, T.StructType)):
        return "MAP"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "DATETIME"
    return kind.typeName().upper()


def variant_type_name(value: Column) -> Column:
    """The same names for a VARIANT value, decided per row."""
    found = F.schema_of_variant(value)
    return (
        F.when(found.startswith("BOOLEAN"), "BOOLEAN")
        .when(found.startswith("BIGINT"), "INTEGER")
        .when(found.startswith("DOUBLE") | found.startswith("FLOAT") | found.startswith("DECIMAL"), "FLOAT")
        .when(found.startswith("STRING"), "STRING")
        .when(found.startswith("ARRAY"), "LIST")
        .when(found.startswith("OBJECT"), "MAP")
        .otherwise(found)
    )


def sample_text(value: Column, kind: str) -> Column:
    """A sample in a fixed form: numbers with a fraction to six places, times to the second."""
    if kind == "FLOAT":
        return F.format_string("%.6f", value.cast("double"))
    if kind == "DATETIME":
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    return value.cast("string")


def node_properties(tables: Tables, shown: Callable[[Column, str], Column] = lambda value, _: value.cast("string")) -> DataFrame:
    """Keys that occur per label: (label, key, type, sample).

    The sample is the value at the smallest node key. One pass per table; every task hands
    on one row, however large the table is. Samples are text, as ``shown`` makes it of a value
    and the name of its type.
    """

    def profile(label: str, table: DataFrame, key: str) -> DataFrame:
        samples = [
            F.min_by(shown(F.col(c), type_name(table.schema[c].dataType)), F.when(F.col(c).isNotNull(), F.col(key))).alias(f"c{i}")
            for i, c in enumerate(table.columns)
        ]
        entries = [
            F.struct(
                F.lit(name).alias("key"),
                F.lit(type_name(table.schema[name].dataType)).alias("type"),
                F.col(f"c{i}").alias("sample"),
            )
            for i, name in enumerate(table.columns)
        ]
        found = table.agg(*samples).select(F.explode(F.array(*entries)).alias("p"))
        return found.select(F.lit(label).alias("label"), "p.*").filter(F.col("sample").isNotNull())

    return reduce(DataFrame.union, [profile(label, *table) for label, table in tables.items()])


def map_properties(owners: DataFrame, owner: str, order: str, props: str = "props") -> DataFrame:
    """The same for properties kept as a map: (owner, key, sample). Used for edge properties."""
    named = owners.select(owner, order, F.explode(props).alias("key", "value")).filter(F.col("value").isNotNull())
    return named.groupBy(owner, "key").agg(F.min_by("value", order).alias("sample"))


def labels(tables: Tables) -> DataFrame:
    """Labels that have nodes, ordered."""
    found = [table.limit(1).select(F.lit(label).alias("label")) for label, (table, _) in tables.items()]
    return reduce(DataFrame.union, found).orderBy("label")


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.select("rel_type").distinct().orderBy("rel_type")


def edge_mappings(edges: DataFrame) -> DataFrame:
    """Distinct (source label, type, target label), also in arrow form."""
    arrow = F.format_string("(:%s)-[:%s]->(:%s)", "src_label", "rel_type", "dst_label")
    return edges.select("src_label", "rel_type", "dst_label").distinct().withColumn("mapping", arrow)


def label_pairs(pairs: DataFrame, src: str = "src_labels", dst: str = "dst_labels") -> DataFrame:
    """For nodes with several labels: every source label with every target label."""
    return (
        pairs.withColumn("src_label", F.explode(src)).withColumn("dst_label", F.explode(dst)).drop(src, dst)
    )


def catalog_text(tables: Tables, edges: DataFrame, edge_props: DataFrame | None = None) -> DataFrame:
    """The catalog as one text: labels with their properties, edge types, endpoint mappings.

    ``edge_props`` has (rel_type, key, type). The catalog is as small as the schema, so its
    lines may meet in one task.
    """
    line = lambda section, name, text: F.struct(
        F.lit(section).alias("section"), name.alias("name"), text.alias("text")
    )

    def listed(rows: DataFrame, owner: str) -> DataFrame:
        ordered = rows.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("key", "type"))).alias("p"))
        text = F.transform("p", lambda p: F.format_string("  %s: %s", p["key"], p["type"]))
        return ordered.select(owner, F.array_join(text, ",\n").alias("block"))

    nodes = listed(node_properties(tables), "label").select(
        line(1, F.col("label"), F.format_string("(:%s) {\n%s\n}\n", "label", "block")).alias("l")
    )
    types = edge_types(edges)
    if edge_props is not None:
        types = types.join(listed(edge_props, "rel_type"), "rel_type", "left")
    else:
        types = types.withColumn("block", F.lit(None).cast("string"))
    with_props = F.format_string("[:%s] {\n%s\n}\n", "rel_type", "block")
    without = F.format_string("[:%s] { -- No properties -- }\n", "rel_type")
    rels = types.select(
        line(3, F.col("rel_type"), F.when(F.col("block").isNotNull(), with_props).otherwise(without)).alias("l")
    )
    maps = edge_mappings(edges).select(
        line(5, F.concat_ws("\x1f", "rel_type", "src_label", "dst_label"), F.col("mapping")).alias("l")
    )
    spark = edges.sparkSession
    heads = spark.range(1).select(
        F.explode(
            F.array(
                line(0, F.lit(""), F.lit("## Node Definitions")),
                line(2, F.lit(""), F.lit("## Relationship Definitions")),
                line(4, F.lit(""), F.lit("## Relationship Mappings")),
            )
        ).alias("l")
    )
    lines = reduce(DataFrame.union, [heads, nodes, rels, maps])
    ordered = F.array_sort(F.collect_list("l"))
    return lines.agg(F.array_join(F.transform(ordered, lambda l: l["text"]), "\n").alias("catalog"))


def key_violations(tables: Tables) -> DataFrame:
    """Keys that more than one node of a label has: (label, key_name, key_value, n)."""

    def check(label: str, table: DataFrame, key: str) -> DataFrame:
        counts = table.groupBy(F.col(key).cast("string").alias("key_value")).agg(F.count(F.lit(1)).alias("n"))
        return counts.filter("n > 1").select(
            F.lit(label).alias("label"), F.lit(key).alias("key_name"), "key_value", "n"
        )

    return reduce(DataFrame.union, [check(label, *table) for label, table in tables.items()])
