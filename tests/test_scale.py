"""Tasks that hold about as much of a large input as of a small one."""

import os

import pytest
from pyspark.sql import functions as F

from kgspark.operators import tree
from kgspark.plans import ingest, record_queries, registry
from kgspark.plans.ingest import load_metabolites, load_proteins
from kgspark.session import fixed_tasks, stored
from kgspark.sources import graph_store
from kgspark.sources.graph_store import GraphStore


def parts(spark, n):
    """Parts in one file, the largest key first."""
    key = (F.lit(n - 1) - F.col("id")).alias("p_partkey")
    texts = [F.concat(F.lit(name), F.col("id")).alias(f"p_{name}") for name in ("name", "brand", "type")]
    return spark.range(n).coalesce(1).select(key, *texts, (F.col("id") % 50).cast("int").alias("p_size"))


@pytest.fixture()
def folder(spark, tmp_path):
    parts(spark, 95).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_few_parts_a_task(spark, monkeypatch):
    monkeypatch.setattr(record_queries, "PARTS_PER_TASK", 10)
    records = record_queries.xml_records(parts(spark, 95), "metabolite", {"accession": "p_name"})
    rows = records.select("_row", F.spark_partition_id().alias("task")).collect()
    assert [r._row for r in rows] == list(reversed(range(95)))  # the order of the file stays
    assert max(sum(r.task == task for r in rows) for task in range(10)) <= 20
    assert record_queries.xml_records(parts(spark, 0), "metabolite", {"accession": "p_name"}).count() == 0


@pytest.mark.parametrize("name, needed", [("shred_taxonomy", ["taxonomy"]), ("shred_cross_references", list(record_queries.CROSS_FIELDS))])
def test_records_lie_in_many_files(spark, folder, monkeypatch, name, needed):
    monkeypatch.setattr(record_queries, "PARTS_PER_TASK", 10)
    records = record_queries._parsed(spark, folder, "Metabolite", needed)
    assert len(records.inputFiles()) >= 8 and records.count() == 95
    assert registry.QUERIES[name](spark, folder).select("src_key").distinct().count() == 48


@pytest.mark.parametrize("name, rows", [("shred_cross_references", 1079), ("shred_synonyms", 190), ("shred_protein_pathways", 95), ("shred_child_terms", 190)])
def test_writes_are_merged_by_as_many_tasks_as_they_need(spark, folder, monkeypatch, name, rows):
    monkeypatch.setattr(record_queries, "WRITES_PER_TASK", 20)
    set_to = spark.conf.get("spark.sql.shuffle.partitions")
    edges = registry.QUERIES[name](spark, folder)
    assert edges.count() == rows
    files = spark.read.parquet(*edges.inputFiles())  # a file for each task that joined
    assert max(r["count"] for r in files.groupBy(F.input_file_name()).count().collect()) <= 50
    assert spark.conf.get("spark.sql.shuffle.partitions") == set_to


def test_tasks_of_a_job(spark, tmp_path):
    keys = ["spark.sql.files.minPartitionNum", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = [spark.conf.get(key, None) for key in keys]
    frame = stored(spark.range(1000).repartitionByRange(20, "id"), "numbers", str(tmp_path / "numbers"))
    with pytest.raises(ZeroDivisionError), fixed_tasks(spark, 20, 7):
        assert frame.select(F.spark_partition_id()).distinct().count() == 20
        made = stored(frame.groupBy("id").count(), "counts", str(tmp_path / "counts"))
        assert len(made.inputFiles()) == 7 and made.count() == 1000
        1 / 0
    assert [spark.conf.get(key, None) for key in keys] == before


def test_buckets_by_size(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_store, "BYTES_PER_BUCKET", 2000)
    path = str(tmp_path / "xml")
    record_queries.xml_records(parts(spark, 95), "metabolite", {"accession": "p_name", "description": "repeat(p_type, 20)"}).select("record").write.text(path)
    store = GraphStore(spark, str(tmp_path / "g"))
    load_metabolites(spark, store, path)
    wanted = store.buckets
    assert graph_store.BUCKETS < wanted < 95
    monkeypatch.setattr(graph_store, "BYTES_PER_BUCKET", 20)
    again = GraphStore(spark, store.root)
    load_metabolites(spark, again, path)  # a graph keeps the number it was made with
    assert again.buckets == wanted and again.nodes("Metabolite").count() == 95
    asked = GraphStore(spark, str(tmp_path / "asked"), buckets=3)
    load_metabolites(spark, asked, path)
    assert asked.buckets == 3 and asked.nodes("Metabolite").count() == 95
    store.files().mkdirs(store.path(f"{store.root}/buckets-1"))  # a load that died, before the graph was made
    assert GraphStore(spark, store.root).buckets == wanted


def test_loads_that_tried_other_buckets(spark, tmp_path):
    root = str(tmp_path / "g")
    one, other = GraphStore(spark, root, buckets=4), GraphStore(spark, root, buckets=5)
    made = [store.begin() for store in (one, other)]
    for store, load in zip((one, other), made):
        store.write_nodes("Tissue", spark.createDataFrame([(f"t{store.buckets}",)], "tissueName string"), load)
    with pytest.raises(RuntimeError, match="run this one again"):
        other.publish(made[1])
    one.publish(made[0])
    again = other.begin()
    other.write_nodes("Tissue", spark.createDataFrame([("t5",)], "tissueName string"), again)
    other.publish(again)
    assert sorted(r.tissueName for r in GraphStore(spark, root).nodes("Tissue").collect()) == ["t4", "t5"]


def test_rounds_do_not_pass_through_the_driver(spark, monkeypatch):
    plans = []
    stored = tree.stored
    monkeypatch.setattr(tree, "stored", lambda frame, name: plans.append((name, frame._jdf.queryExecution().executedPlan().toString())) or stored(frame, name))
    nodes = spark.range(50).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    labels = tree.tree_intervals(nodes)
    rounds = [plan for name, plan in plans if name == "tree-round"]
    assert len(rounds) > 5 and not any("BroadcastHashJoin" in plan for plan in rounds)
    assert "BroadcastHashJoin" not in tree.below(labels, labels)._jdf.queryExecution().executedPlan().toString()
    assert tree.below(labels, labels).count() == 50 * 49 // 2


def test_packed_files_go_after_their_load(spark, folder, monkeypatch):
    """Records lie on disk as short gzipped files in their order, until they are loaded; the graph is bucketed by the text's size."""
    monkeypatch.setattr(record_queries, "PER_FILE", 30)
    monkeypatch.setattr(graph_store, "BYTES_PER_BUCKET", 20_000)
    seen = {}

    def watched(name, load):
        def run(spark, store, path):
            files = sorted(x for x in os.listdir(path) if x.startswith("part-"))
            text = [r.value for x in files for r in spark.read.text(f"{path}/{x}").collect()]
            seen[name] = path, files, text, store.buckets
            return load(spark, store, path)

        monkeypatch.setattr(record_queries, name, run)

    watched("load_metabolites", load_metabolites)
    watched("load_proteins", load_proteins)
    frame = record_queries.graph_load(spark, folder)
    for path, files, text, _ in seen.values():
        assert not os.path.exists(path)
        assert len(files) == 4 and all(x.endswith(".gz") for x in files) and sum(x != "" for x in text) == 95
    size = sum(len(x.encode()) + 1 for x in seen["load_metabolites"][2])
    assert seen["load_metabolites"][3] == -(-size // 20_000) > graph_store.BUCKETS
    assert frame.count() > 95


def test_large_loads_delete_their_shuffles(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "xml")
    record_queries.xml_records(parts(spark, 95), "metabolite", {"accession": "p_name", "description": "p_type"}).select("record").write.text(path)
    done = []
    monkeypatch.setattr(ingest, "LARGE", 10)
    monkeypatch.setattr(ingest, "release_shuffles", lambda spark: done.append("release"))
    for name in ("write_edges", "write_nodes"):
        monkeypatch.setattr(GraphStore, name, lambda *a, name=name, f=getattr(GraphStore, name): done.append(name) or f(*a))
    store = GraphStore(spark, str(tmp_path / "g"))
    load_metabolites(spark, store, path)
    assert done[:2] == ["write_edges", "release"] and done[-1] == "release" and set(done[2:-1]) == {"write_nodes"}
    assert store.nodes("Metabolite").count() == 95
