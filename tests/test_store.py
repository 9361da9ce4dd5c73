"""The graph store: what counts, what a load writes, what reads need, and its catalog."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from kgspark.operators.catalog import node_properties
from kgspark.operators.merge import not_loaded
from kgspark.schemas import EDGE_COLUMNS, LABELS
from kgspark.operators.resolve import resolved
from kgspark.sources.graph_store import GraphStore, fetch, folder_names

DISEASE = "diseaseName string, omim_id string"


def load(store, rows, schema=DISEASE, label="Disease"):
    made = store.begin()
    store.write_nodes(label, store.spark.createDataFrame(rows, schema), made)
    store.publish(made)
    return made


def listed(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def size_of(folder):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names if not name.startswith("."))


@pytest.fixture()
def store(spark, tmp_path):
    return GraphStore(spark, str(tmp_path / "g"), buckets=3)


def test_names_alone_say_what_counts(spark, store):
    """Markers are empty by design: a job that dies before, or right after, making one leaves a whole graph."""
    load(store, [("a", "1"), ("b", None)])
    half = store.begin()
    store.write_nodes("Disease", spark.createDataFrame([("zz", "9")], DISEASE), half)  # dies here
    assert listed(store.nodes("Disease")) == [("a", "1"), ("b", None)]
    assert store.files().getFileStatus(store.path(f"{store.root}/finished/{store.finished()[0]}")).getLen() == 0
    again = GraphStore(spark, store.root, buckets=99)  # the graph keeps the number it was made with
    assert again.buckets == 3 and listed(again.nodes("Disease")) == [("a", "1"), ("b", None)]


def test_last_mention_wins_over_loads(spark, store):
    load(store, [("a", "1"), ("b", "2"), ("c", "3")])
    load(store, [("a",), ("d",)], "diseaseName string")  # mentions the key alone
    load(store, [("b", None), ("c", "33")])
    assert listed(store.nodes("Disease")) == [("a", "1"), ("b", None), ("c", "33"), ("d", None)]
    store.reset()
    assert store.nodes("Disease").count() == 0 and store.node_properties().count() == 0
    load(store, [("a", None)])
    assert listed(store.nodes("Disease")) == [("a", None)] and store.snapshot() == 5


def test_loads_at_the_same_time(spark, store):
    loads = [store.begin(), store.begin()]
    frames = [spark.createDataFrame([(f"d{i}-{j}", str(i)) for j in range(50)], DISEASE) for i in range(2)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda pair: store.write_nodes("Disease", *pair), zip(frames, loads)))
    store.publish(loads[0])
    with pytest.raises(RuntimeError, match="run this one again"):
        store.publish(loads[1])
    assert store.nodes("Disease").count() == 50
    # both slip through when neither sees the other: both are whole, and both count
    store.files().create(store.path(f"{store.root}/finished/{loads[1].name}"), True).close()
    assert store.nodes("Disease").count() == 100


def test_a_small_load_writes_little(spark, store):
    load(store, [(f"disease number {i}", str(i)) for i in range(20_000)])
    before = size_of(store.root)
    load(store, [("disease number 7", "new")])
    assert size_of(store.root) - before < before / 20
    assert store.nodes("Disease").where("diseaseName = 'disease number 7'").first().omim_id == "new"
    assert store.nodes("Disease").count() == 20_000
    assert [r.n for r in store.load_report().orderBy("load").collect()] == [20_000, 1]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_stored_rows_are_not_shuffled(spark, store):
    for i in range(3):
        load(store, [(f"d{i + j}", str(i)) for j in range(10)])
    assert "Exchange" not in plan(store.nodes("Disease"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = not_loaded(spark.createDataFrame([("d1",), ("x",)], "accession string"), store.nodes("Disease"), "accession", "diseaseName")
        assert plan(fresh).count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan(fresh)
        assert listed(fresh) == [("x",)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_with_properties(spark, store):
    schema = ", ".join(f"{c} string" for c in EDGE_COLUMNS) + ", props map<string,string>"
    rows = [[("M", "m1", "R", "S", "s1", {"a": "1", "b": "2"}), ("M", "m1", "R", "S", "s2", None)], [("M", "m1", "R", "S", "s1", {"b": None, "c": "3"}), ("T", "t", "Q", "S", "s1", {})]]
    for part in rows:
        made = store.begin()
        store.write_edges(spark.createDataFrame(part, schema), made)
        store.publish(made)
    assert listed(store.edges()) == [("M", "m1", "R", "S", "s1"), ("M", "m1", "R", "S", "s2"), ("T", "t", "Q", "S", "s1")]
    found = {tuple(r[c] for c in EDGE_COLUMNS): r.props for r in store.edges_with_props().collect()}
    assert found == {("M", "m1", "R", "S", "s1"): {"a": "1", "c": "3"}, ("M", "m1", "R", "S", "s2"): {}, ("T", "t", "Q", "S", "s1"): {}}
    assert listed(store.edge_mappings()) == [("M", "R", "S"), ("T", "Q", "S")]
    assert listed(store.edge_properties()) == [("R", "a", "STRING", "1"), ("R", "b", "STRING", "2"), ("R", "c", "STRING", "3")]


def test_profiles_equal_a_scan(spark, store):
    load(store, [("b", None), ("c", "3"), ("d", "4")])
    load(store, [("c", "5"), ("e", "6")])
    load(store, [("t",)], "tissueName string", "Tissue")
    tables = {label: (store.nodes(label), LABELS[label][0]) for label in ("Disease", "Tissue")}
    assert listed(store.node_properties()) == listed(node_properties(tables))


def test_resolution_keeps_its_indexes(spark, store):
    load(store, [(f"disease {i}", None) for i in range(30)] + [("gout", None)])
    mentions = spark.createDataFrame([(1, "gouty", "Disease"), (2, "none such", "Protein"), (3, "liver", "Tissue")], "mention_id int, name string, type string")
    wanted = [(1, "gouty", "Disease", "gout"), (2, "none such", "Protein", None), (3, "liver", "Tissue", "liver")]
    assert listed(resolved(store, mentions)) == wanted
    made = folder_names(store, f"indexes/{store.snapshot():012d}")
    assert listed(resolved(store, mentions)) == wanted
    assert folder_names(store, f"indexes/{store.snapshot():012d}") == made and len(made) == 4
    load(store, [("gouty", None)])  # another snapshot, other indexes
    assert listed(resolved(store, mentions))[0][3] == "gouty"


def test_errors_while_a_query_runs(spark):
    assert fetch(spark, "SELECT id FROM range(5) ORDER BY id DESC", limit=2) == [{"id": 4}, {"id": 3}]
    with pytest.raises(RuntimeError, match="query failed"):
        fetch(spark, "SELECT raise_error('at run time') FROM range(3)")
    with pytest.raises(RuntimeError, match="query failed"):
        fetch(spark, "SELECT nothing FROM nowhere")
