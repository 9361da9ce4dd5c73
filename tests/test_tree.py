"""Intervals of trees against walking up, and plans folded into classes."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import graph, intervals, tree


def walked(parents):
    """node: (root, depth, cycle, ancestors), by following parents."""
    up = {}
    for node, parent in parents:
        if node is not None:
            up.setdefault(node, set())
            if parent is not None:
                up[node].add(parent)
                up.setdefault(parent, set())
    one = {node: min(some) if some else None for node, some in up.items()}
    cycles = {}
    for node in one:
        seen, at = [], node
        while at is not None and at not in seen:
            seen.append(at)
            at = one[at]
        if at is not None:
            ring = seen[seen.index(at):]
            cycles |= {x: min(ring) for x in ring}
    found = {}
    for node in one:
        above, at, depth = set(), node, 0
        while at is not None and at not in cycles:
            above.add(at)
            at = one[at]
            depth += 1
        if at is None:
            root, depth = max(above, key=lambda x: (one[x] is None, x)) if above else node, depth - 1
        else:
            root = cycles[at]
            above |= {x for x, c in cycles.items() if c == root}
        found[node] = (root, depth, cycles.get(node), above - {node})
    return found


def check(spark, parents, schema="node long, parent long"):
    frame = spark.createDataFrame(parents, schema)
    rows = {r.node: r for r in tree.tree_intervals(frame).collect()}
    wanted = walked(parents)
    assert rows.keys() == wanted.keys()
    for node, (root, depth, cycle, above) in wanted.items():
        r = rows[node]
        assert (r.root, r.depth, r.cycle) == (root, depth, cycle), node
        assert {a for a, x in rows.items() if x.first <= r.first < x.last} - {node} == above
    return frame, wanted


@pytest.mark.parametrize("seed", range(4))
def test_random_forests_and_cycles(spark, seed, monkeypatch):
    monkeypatch.setattr(tree, "ROWS_PER_BLOCK", 8)
    monkeypatch.setattr(intervals, "CELL", 5)
    draw = random.Random(seed)
    n = 60
    parents = [(i, draw.choice([None, draw.randrange(max(1, i)), draw.randrange(n), 0])) for i in range(n)]
    parents += [(5, 3), (None, 4), (70, None), (80, 80)]
    frame, wanted = check(spark, parents)
    labels = tree.tree_intervals(frame)
    asked = labels.where("node % 3 = 0")
    pairs = {tuple(r) for r in tree.below(asked, labels).collect()}
    assert pairs == {(a, node) for node, (*_, above) in wanted.items() for a in above if a % 3 == 0}


def test_long_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    stored = tree.stored
    monkeypatch.setattr(tree, "stored", lambda frame, name: rounds.append(name) or stored(frame, name))
    n = 10_000
    rows = tree.tree_intervals(spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent")))
    found = rows.agg(F.count("node"), F.sum((F.col("depth") == F.col("node")).cast("int")), F.sum((F.col("first") == F.col("node")).cast("int")), F.min("last"), F.max("last")).first()
    assert tuple(found) == (n, n, n, n, n)
    assert rounds.count("tree-round") <= 30


def test_names_and_no_rows(spark):
    check(spark, [("b", "a"), ("c", "b"), ("x", None)], "node string, parent string")
    assert tree.tree_intervals(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_plans_that_share_a_class(spark):
    nodes = spark.createDataFrame([("M", "1", {"a": "x", "b": "y"}), ("M", "2", {"c": "z"}), ("S", "1", {"a": "s"}), ("T", "9", {})], "label string, pk string, props map<string,string>")
    shape = "plan_id int, nodes_and_relationships map<string,array<string>>"
    few = [(1, {"nodes": ["M", "M"], "properties": ["b", "a"]}), (2, {"nodes": ["M", "S"], "properties": ["a"]}), (3, {"relationships": ["R"]}), (4, {"nodes": ["T"]})]
    many = few + [(10 + i, {"nodes": ["M"], "properties": ["a", "b", "a"]}) for i in range(50)]
    sizes = []
    for plans in (few, many):
        frame = spark.createDataFrame(plans, shape)
        classes, members = graph.plan_classes(frame)
        found = graph.subgraph_classes(classes, nodes)
        rows = {(r.label, r.pk): (r.props, len(r.classes)) for r in found.collect()}
        assert rows == {("M", "1"): ({"a": "x", "b": "y"}, 2), ("M", "2"): ({}, 2), ("S", "1"): ({"a": "s"}, 1), ("T", "9"): ({}, 1)}
        sizes.append(found.count())
        one = graph.subgraph_of(frame.select("plan_id"), members, classes, found)
        as_rows = lambda f: sorted(((r.plan_id, r.label, r.pk, sorted(r.props.items())) for r in f.select("plan_id", "label", "pk", "props").collect()))
        assert as_rows(one) == as_rows(graph.subgraph_nodes(frame, nodes))
    assert sizes[0] == sizes[1]
