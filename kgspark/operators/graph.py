"""Patterns over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_ci
from ..session import shared_dir


def with_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.filter(F.col("label") == label)


def of_type(edges: DataFrame, rel_type: str, src_label: str | None = None, dst_label: str | None = None):
    """Edges of a type, optionally between given labels: types are shared by several labels."""
    found = edges.filter(F.col("rel_type") == rel_type)
    if src_label is not None:
        found = found.filter(F.col("src_label") == src_label)
    if dst_label is not None:
        found = found.filter(F.col("dst_label") == dst_label)
    return found


def one_hop(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source)-[edge]->(target): ``sources`` and ``targets`` carry src_key and dst_key.

    Filters on either side belong into those frames, where they reach the scan.
    """
    return edges.select("src_key", "dst_key").join(targets, "dst_key").join(sources, "src_key")


def described(mentions: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each mention the nodes of that name or with an alias of that name, ignoring case.

    mentions: (mention_id, name); nodes: (pk, name, description); aliases: (pk, alias).
    Each node appears once per mention; nodes without description are kept. The two ways to
    match are separate equi-joins over the distinct names, in place of a join under OR.
    """
    named = mentions.filter(F.col("name").isNotNull())
    wanted = named.select(F.lower("name").alias("name_lc")).distinct()
    by_name = nodes.select(F.lower("name").alias("name_lc"), "pk").join(wanted, "name_lc", "left_semi")
    by_alias = aliases.select(F.lower("alias").alias("name_lc"), "pk").join(wanted, "name_lc", "left_semi")
    pairs = by_name.union(by_alias).distinct()
    found = pairs.join(nodes.select("pk", "description"), "pk")
    return named.withColumn("name_lc", F.lower("name")).join(found, "name_lc").select(
        "mention_id", "name", "pk", "description"
    )


def owner_of_alias(aliases: DataFrame, owners: DataFrame) -> DataFrame:
    """Per alias, ignoring case, the owner with the smallest key: (alias_lc, owner_name)."""
    joined = aliases.join(owners.select("pk", "name"), "pk")
    return joined.groupBy(F.lower("alias").alias("alias_lc")).agg(
        F.min_by(F.struct("name"), "pk")["name"].alias("owner_name")
    )


def plan_names(plans: DataFrame, kind: str) -> DataFrame:
    """Names a plan lists under ``nodes``, ``relationships`` or ``properties``: (plan_id, name)."""
    listed = F.element_at(F.col("nodes_and_relationships"), kind)
    return plans.select("plan_id", F.explode(listed).alias("name")).distinct()


def subgraph_nodes(plans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the labels each plan names, with only the properties it names.

    Few labels hold all nodes: the plan side is either small enough for Spark to broadcast by
    size, or the skewed label partitions of the node side are split.
    """
    wanted = plans.select(
        "plan_id",
        F.explode(F.array_distinct(F.element_at("nodes_and_relationships", F.lit("nodes")))).alias("label"),
        F.coalesce(
            F.element_at("nodes_and_relationships", F.lit("properties")), F.array().cast("array<string>")
        ).alias("wanted"),
    )
    joined = nodes.join(wanted, "label")
    props = F.map_filter("props", lambda key, _: F.array_contains(F.col("wanted"), key))
    return joined.select("plan_id", "label", "pk", props.alias("props"))


def subgraph_edges(plans: DataFrame, edges: DataFrame) -> DataFrame:
    wanted = plan_names(plans, "relationships").withColumnRenamed("name", "rel_type")
    return edges.join(wanted, "rel_type")


def plan_classes(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans folded by what they want of a label: (classes, members).

    classes: (class_id, label, wanted, n_plans), one row for every label with a set of properties;
    members: (plan_id, class_id).
    """
    listed = lambda kind: F.coalesce(F.element_at("nodes_and_relationships", F.lit(kind)), F.array().cast("array<string>"))
    wanted = F.array_sort(F.array_distinct(listed("properties")))
    asked = plans.select("plan_id", F.explode(F.array_distinct(listed("nodes"))).alias("label"), wanted.alias("wanted"))
    members = asked.withColumn("class_id", F.md5(F.to_json(F.struct("label", "wanted")))).distinct()
    classes = members.groupBy("class_id").agg(F.first("label").alias("label"), F.first("wanted").alias("wanted"), F.count(F.lit(1)).alias("n_plans"))
    return classes, members.select("plan_id", "class_id")


def subgraph_classes(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every wanted node once: (label, pk, props, classes), with the properties that any class wants.

    ``classes`` names, in order, the classes that want the node; which plans these are say the members,
    and what a class sees of a node says its ``wanted``. However many plans share a class, nodes are
    neither read nor written more often.
    """
    by_label = classes.groupBy("label").agg(
        F.array_sort(F.collect_list("class_id")).alias("classes"), F.array_distinct(F.flatten(F.collect_list("wanted"))).alias("_wanted")
    )
    props = F.map_filter("props", lambda key, _: F.array_contains(F.col("_wanted"), key))
    return nodes.join(by_label, "label").select("label", "pk", props.alias("props"), "classes")


def subgraph_of(plan: DataFrame, members: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes of some plans (column ``plan_id``) out of those of all: (plan_id, label, pk, props)."""
    own = plan.select("plan_id").join(members, "plan_id").join(classes.select("class_id", "label", "wanted"), "class_id")
    props = F.map_filter("props", lambda key, _: F.array_contains(F.col("wanted"), key))
    return found.drop("classes").join(own, "label").select("plan_id", "label", "pk", props.alias("props"))


def unknown_names(plans: DataFrame, labels: DataFrame, rel_types: DataFrame, properties: DataFrame) -> DataFrame:
    """Names in plans that the catalog does not have: (plan_id, kind, name).

    Each catalog frame has one column.
    """
    catalogs = {"nodes": labels, "relationships": rel_types, "properties": properties}
    parts = []
    for kind, known in catalogs.items():
        known = known.toDF("name").distinct()
        parts.append(plan_names(plans, kind).join(known, "name", "left_anti").select("plan_id", F.lit(kind).alias("kind"), "name"))
    return parts[0].union(parts[1]).union(parts[2])


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All (ancestor, descendant, depth) over (src, dst) edges; depth is the shortest.

    Only pairs first reached in a round are carried into the next, so cycles end. Each round
    is cut from its lineage by a checkpoint in the shared folder.
    """
    shared_dir(edges.sparkSession)
    pairs = edges.select("src", "dst").distinct().checkpoint()
    newest = pairs.select(F.col("src").alias("ancestor"), F.col("dst").alias("descendant"), F.lit(1).alias("depth"))
    reached, depth = newest, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (
            newest.join(pairs, newest["descendant"] == pairs["src"])
            .select("ancestor", F.col("dst").alias("descendant"))
            .distinct()
            .join(reached, ["ancestor", "descendant"], "left_anti")
        )
        newest = step.withColumn("depth", F.lit(depth)).checkpoint()
        if newest.isEmpty():
            break
        reached = reached.union(newest)
    return reached


def matching_name(nodes: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """Nodes whose name equals one of ``names`` (column ``name``), ignoring case."""
    wanted = names.select(F.col("name").alias("_wanted")).distinct()
    return nodes.join(wanted, same_ci(nodes[column], wanted["_wanted"]), "left_semi")
