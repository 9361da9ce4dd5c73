"""Graph patterns, merges, catalog, responses, SSE and XML structure."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import catalog, graph, merge, responses
from kgspark.operators.structure import structure_report, xml_structure
from kgspark.plans.ingest import malformed
from kgspark.schemas import METABOLITE
from kgspark.sources import sse
from kgspark.sources.graph_store import as_property_maps, run_query
from kgspark.sources.xml_records import count_elements, parse_records, scan_records


def brute_merge(writes):
    nodes = {}
    for _, key, props in sorted(writes, key=lambda w: w[0]):
        node = nodes.setdefault(key, {})
        for name, value in props.items():
            if value is None:
                node.pop(name, None)
            else:
                node[name] = value
    return nodes


@pytest.mark.parametrize("partitions", [1, 7])
def test_merges_replay_the_writes(spark, partitions):
    rng = random.Random(11)
    shapes = [("a", "b"), ("b", "c"), ("c",), ()]
    writes = []
    for at in range(2000):
        # one key receives a third of all writes
        key = "hub" if at % 3 == 0 else f"k{rng.randint(0, 40)}"
        writes.append((at, key, {p: rng.choice([None, str(at)]) for p in rng.choice(shapes)}))
    frame = spark.createDataFrame(writes, "_order bigint, k string, props map<string,string>").repartition(partitions)
    merged = merge.merge_property_maps(frame, ["k"])
    assert {r.k: r.props for r in merged.collect()} == brute_merge(writes)

    typed = [frame.filter(F.map_contains_key("props", "a")).select("k", "_order", "props.a", "props.b"),
             frame.filter(F.map_contains_key("props", "b") & ~F.map_contains_key("props", "a")).select("k", "_order", "props.b", "props.c")]
    kept = [w for w in writes if "b" in w[2]]
    found = {r.k: {n: r[n] for n in "abc" if r[n] is not None} for r in merge.merge_writers(typed, "k").collect()}
    assert found == brute_merge(kept)


def test_a_write_needs_its_key(spark):
    with pytest.raises(ValueError):
        merge.merge_writers([spark.createDataFrame([("x",)], "a string")], "k")


def test_document_order_over_many_splits(spark, small_splits, tmp_path):
    for part in range(3):
        records = "".join(
            f"<metabolite><accession>A{i % 50}</accession><name>f{part} r{i}</name></metabolite>\n"
            for i in range(400 * (part + 1))
        )
        (tmp_path / f"p{part}.xml").write_text(f"<records>{records}</records>")
    small_splits(7000)
    scanned = scan_records(spark, str(tmp_path), "metabolite")
    assert scanned.rdd.getNumPartitions() > 7
    writes = parse_records(scanned, {"accession": "text", "name": "text"}).select(
        "accession", "name", F.struct("_file", "_block", "_row").alias("_order")
    )
    found = {r.accession: r.name for r in merge.merge_writers([writes], "accession").collect()}
    assert found == {f"A{k}": f"f2 r{max(i for i in range(1200) if i % 50 == k)}" for k in range(50)}
    assert {r.n for r in count_elements(spark, str(tmp_path), "metabolite").collect()} == {400, 800, 1200}


def test_odd_records(spark, tmp_path):
    text = (
        '<x:records xmlns:x="u"><!-- c --><x:metabolite><x:accession>A</x:accession>'
        "<x:description>t<!-- c -->u</x:description><x:name>n &#60;b&gt; &lt;i&gt;</x:name></x:metabolite>"
        "<x:metabolite><x:accession>B</x:metabolite></x:records>"
    )
    (tmp_path / "a.xml").write_text(text)
    rows = parse_records(scan_records(spark, str(tmp_path), "metabolite", prefix="x"), METABOLITE)
    found = {r.accession: (r.description, r.name) for r in rows.collect()}
    assert found == {"A": ("t", "n <b> <i>"), None: (None, None)}
    assert malformed(rows).count() == 1


def test_closing_tags_in_any_spelling(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><m><a>1</a></m ><m><a>2</a></m><x:m><a>3</a></x:m\n><m><a>4</a></m\t></r>")
    rows = scan_records(spark, str(tmp_path), "m").orderBy("_file", "_block", "_row").collect()
    assert [r.record for r in rows] == ["<m><a>1</a></m>", "<m><a>2</a></m>", "<x:m><a>3</a></x:m>", "<m><a>4</a></m>"]


def test_xml_structure(spark, small_splits, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<?xml version="1.0"?><records><info/>' + "<m><a><b/></a></m>\n" * 40 + "<m k='<>'><c><![CDATA[</m2>]]></c></m><tail><t/></tail></records>".replace("<>", "&lt;")
    )
    (tmp_path / "b.xml").write_text("<list><m><d/></m></list>")
    (tmp_path / "c.txt").write_text("<m><no/></m>")
    small_splits(200)
    report = structure_report(xml_structure(spark, str(tmp_path), "m"))
    found = {(r.file_path.rsplit("/", 1)[1], r.parent): r.children for r in report.collect()}
    assert found == {
        ("a.xml", "records"): ["info", "m", "tail"],
        ("a.xml", "m"): ["a", "c"],
        ("a.xml", "a"): ["b"],
        ("a.xml", "tail"): ["t"],
        ("b.xml", "list"): ["m"],
        ("b.xml", "m"): ["d"],
    }


@pytest.fixture(scope="module")
def small_graph(spark):
    edges = spark.createDataFrame(
        [("M", "m1", "HAS_SYNONYM", "S", "Alpha"), ("M", "m2", "HAS_SYNONYM", "S", "alpha"),
         ("P", "p1", "HAS_SYNONYM", "S", "Alpha"), ("M", "m9", "HAS_SYNONYM", "S", "gone"),
         ("M", "m1", "IN", "T", "t")],
        "src_label string, src_key string, rel_type string, dst_label string, dst_key string",
    )
    nodes = spark.createDataFrame(
        [("M", "m1", {"name": "One", "description": "d1"}), ("M", "m2", {"name": "ALPHA"}), ("P", "p1", {}),
         ("S", "Alpha", {}), ("S", "alpha", {}), ("S", "gone", {}), ("T", "t", {"x": "1"})],
        "label string, pk string, props map<string,string>",
    )
    return nodes, edges


def test_endpoints_and_updates(spark, small_graph):
    nodes, edges = small_graph
    kept = merge.with_endpoints(merge.distinct_edges([edges, edges]), nodes)
    assert sorted(r.src_key for r in kept.collect()) == ["m1", "m1", "m2", "p1"]
    table = spark.createDataFrame([("m1", "old"), ("m2", "keep")], "k string, t string")
    updates = spark.createDataFrame([("m1", "a", 1), ("m1", None, 2), ("zz", "x", 3)], "k string, t string, _order int")
    assert {r.k: r.t for r in merge.update_matching(table, updates, "k").collect()} == {"m1": None, "m2": "keep"}
    assert [r.k for r in merge.not_loaded(updates, table, "k").collect()] == ["zz"]


def test_lookups(spark, small_graph):
    nodes, edges = small_graph
    named = graph.with_label(nodes, "M").select("pk", "props.name", "props.description")
    aliases = graph.of_type(edges, "HAS_SYNONYM", "M").select(F.col("src_key").alias("pk"), F.col("dst_key").alias("alias"))
    mentions = spark.createDataFrame([(1, "alpha"), (2, "ALPHA"), (3, "one"), (4, None)], "mention_id int, name string")
    found = graph.described(mentions, named, aliases)
    assert sorted((r.mention_id, r.pk, r.description) for r in found.collect()) == [
        (1, "m1", "d1"), (1, "m2", None), (2, "m1", "d1"), (2, "m2", None), (3, "m1", "d1")]
    owners = graph.owner_of_alias(aliases, named)
    assert {r.alias_lc: r.owner_name for r in owners.collect()} == {"alpha": "One"}
    hop = graph.one_hop(
        graph.of_type(edges, "HAS_SYNONYM", "M", "S"),
        named.select(F.col("pk").alias("src_key"), "name"),
        graph.matching_name(graph.with_label(nodes, "S").select(F.col("pk").alias("dst_key")),
                            spark.createDataFrame([("ALPHA",)], "name string"), "dst_key"),
    )
    assert sorted(r.name for r in hop.collect()) == ["ALPHA", "One"]


def test_subgraph(spark, small_graph):
    nodes, edges = small_graph
    plans = spark.createDataFrame(
        [(1, {"nodes": ["M", "Nope"], "relationships": ["IN"], "properties": ["name", "bad"]}), (2, {"nodes": ["T"]})],
        "plan_id int, nodes_and_relationships map<string,array<string>>",
    )
    found = {(r.plan_id, r.pk): r.props for r in graph.subgraph_nodes(plans, nodes).collect()}
    assert found == {(1, "m1"): {"name": "One"}, (1, "m2"): {"name": "ALPHA"}, (2, "t"): {}}
    assert [r.src_key for r in graph.subgraph_edges(plans, edges).collect()] == ["m1"]
    unknown = graph.unknown_names(plans, nodes.select("label"), edges.select("rel_type"),
                                  nodes.select(F.explode(F.map_keys("props"))))
    assert sorted(map(tuple, unknown.collect())) == [(1, "nodes", "Nope"), (1, "properties", "bad")]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")], "src string, dst string")
    found = {(r.ancestor, r.descendant): r.depth for r in graph.closure(edges).collect()}
    assert found[("a", "d")] == 3 and found[("a", "a")] == 3 and found[("x", "x")] == 1
    assert len(found) == 13
    assert graph.closure(edges, max_depth=1).count() == 5


def test_catalog(spark, small_graph):
    _, edges = small_graph
    table = spark.createDataFrame([("b", 1, None, 2.5), ("a", None, None, 1.5)], "k string, n int, never string, f double")
    tables = {"L": (table, "k"), "Empty": (table.filter("false"), "k")}
    props = catalog.node_properties(tables).collect()
    assert sorted(map(tuple, props)) == [("L", "f", "FLOAT", "1.5"), ("L", "k", "STRING", "a"), ("L", "n", "INTEGER", "1")]
    assert [r.label for r in catalog.labels(tables).collect()] == ["L"]
    assert [r.rel_type for r in catalog.edge_types(edges).collect()] == ["HAS_SYNONYM", "IN"]
    edge_props = spark.createDataFrame([("IN", "since", "STRING")], "rel_type string, key string, type string")
    text = catalog.catalog_text({"L": (table, "k")}, edges, edge_props).collect()[0].catalog
    assert text == (
        "## Node Definitions\n(:L) {\n  f: FLOAT,\n  k: STRING,\n  n: INTEGER\n}\n\n## Relationship Definitions\n"
        "[:HAS_SYNONYM] { -- No properties -- }\n\n[:IN] {\n  since: STRING\n}\n\n## Relationship Mappings\n"
        "(:M)-[:HAS_SYNONYM]->(:S)\n(:P)-[:HAS_SYNONYM]->(:S)\n(:M)-[:IN]->(:T)"
    )
    twice = {"L": (table.union(table), "k")}
    assert sorted((r.key_value, r.n) for r in catalog.key_violations(twice).collect()) == [("a", 2), ("b", 2)]
    maps = spark.createDataFrame([("IN", "e1", {"w": None, "v": "2"}), ("IN", "e0", {"v": "1"})], "rel_type string, e string, props map<string,string>")
    assert [tuple(r) for r in catalog.map_properties(maps, "rel_type", "e").collect()] == [("IN", "v", "1")]
    values = spark.createDataFrame([("true",), ("1",), ("1.5",), ('"s"',), ("[1]",), ('{"a":1}',)], "j string")
    kinds = values.select(catalog.variant_type_name(F.parse_json("j")).alias("t")).collect()
    assert [r.t for r in kinds] == ["BOOLEAN", "INTEGER", "FLOAT", "STRING", "LIST", "MAP"]
    pairs = spark.createDataFrame([(["A", "B"], ["C", "D"])], "src_labels array<string>, dst_labels array<string>")
    assert catalog.label_pairs(pairs).count() == 4
    assert as_property_maps(table, "L", "k").filter("size(props) = 2").count() == 1


def test_responses(spark):
    rows = spark.createDataFrame(
        [(1, '{"entities":[{"name":"a","type":"Metabolite","confidence":0.9,"extra":1},{"name":"b","type":"Gene","confidence":1}]}'),
         (2, "not json"), (3, '{"entities":[{"name":"a","type":"x"}]}'), (4, '{"other":1}'), (5, '{"entities":[]}'), (6, None)],
        "question_id int, response string",
    )
    parsed = responses.parsed_entities(rows, "response")
    assert {r.question_id: r.rejected for r in parsed.collect()} == {
        1: None, 2: "malformed", 3: "incomplete", 4: "incomplete", 5: None, 6: "malformed"}
    assert [(r.pos, r.name) for r in responses.of_type(responses.mentions(parsed)).collect()] == [(0, "a")]
    assert responses.quarantine(parsed).count() == 4
    plan = ('{"entities":[],"query_intent":"i","should_query":true,"reasoning":"r",'
            '"nodes_and_relationships":{"nodes":["M"],"relationships":[]}}')
    plans = responses.parsed_plans(spark.createDataFrame([(1, plan)], "question_id int, response string"), "response")
    assert plans.select("parsed.nodes_and_relationships").collect()[0][0]["nodes"] == ["M"]
    assert responses.quarantine(responses.parsed_sufficiency(spark.createDataFrame([(1, plan)], "question_id int, r string"), "r")).count() == 1


def test_sse(spark, tmp_path):
    messages = spark.createDataFrame([("A", "x\ny"), ("B", None), ("C", "é\"")], "section string, text string")
    sse.write_events(messages.coalesce(1), str(tmp_path / "out"))
    back = sse.read_events(spark, str(tmp_path / "out"))
    assert sorted((r.section, r.text or "") for r in back.collect()) == [("A", "x\ny"), ("B", ""), ("C", "é\"")]
    (tmp_path / "log.txt").write_text(
        'data: {"section":"A",\n: note\n  data:"text":"1"}\n\ndata:raw\n \n\ndata:{"section":"A","text":"2"}\n\n'
        'data: {"section":"A","text":"2"}\n\ndata:bad\n\ndata:[1]\n\n\n\ndata:{"section":"B","text":"end"}'
    )
    events = sse.read_events(spark, str(tmp_path / "log.txt")).orderBy("_row", "part")
    assert [(r.data, r.is_json, r.section, r.text) for r in events.collect()] == [
        ('{"section":"A",\n"text":"1"}', True, "A", "1"),
        ("raw", False, None, None),
        ('{"section":"A","text":"2"}', True, "A", "2"),
        ('{"section":"A","text":"2"}', True, "A", "2"),
        ("bad", False, None, None),
        ("[1]", True, None, None),
        ('{"section":"B","text":"end"}', True, "B", "end"),
    ]
    strict = sse.distinct_events_of(sse.read_pieces(spark, str(tmp_path / "log.txt"))).orderBy("_row")
    assert [r.text for r in strict.collect()] == ["2", None, "end"]


def test_run_query(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    assert run_query(spark, "SELECT id FROM numbers WHERE id > :low;", {"low": 3}, limit=2).count() == 2
    assert run_query(spark, "SELECT id FROM numbers LIMIT 5", limit=2).count() == 5
    with pytest.raises(RuntimeError):
        run_query(spark, "SELECT nothing FROM nowhere")
