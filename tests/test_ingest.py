"""Golden tests of the record loads on hand-written records."""

import pytest
from pyspark.sql import functions as F

from kgspark.operators.catalog import key_violations
from kgspark.operators.merge import with_endpoints
from kgspark.plans import run_ingest
from kgspark.plans.ingest import load_metabolites, load_proteins, malformed, parse_file, quarantined
from kgspark.schemas import LABELS, METABOLITE
from kgspark.sources.graph_store import GraphStore

METABOLITES = """<?xml version="1.0" encoding="UTF-8"?>
<records xmlns="http://www.example.org">
<metabolite>
  <version>5</version><accession>M1</accession><name>Citric acid</name>
  <description>a <i>b</i> c</description><status>  </status><state/>
  <monisotopic_molecular_weight>192.02</monisotopic_molecular_weight>
  <secondary_accessions><accession>S1</accession><accession/><accession> S2 </accession></secondary_accessions>
  <synonyms><synonym>Citrate</synonym><synonym>Citrate</synonym><synonym>x &lt; y &amp; z</synonym></synonyms>
  <taxonomy><description>An acid</description><kingdom>Organic</kingdom><class>Acids</class>
    <alternative_parents><alternative_parent>Acids</alternative_parent></alternative_parents>
    <substituents><substituent>Carbonyl</substituent></substituents></taxonomy>
  <ontology>
    <root><term>Process</term><definition>def &lt;1&gt;</definition><level>1</level><type>parent</type>
      <descendants>
        <descendant><term>Metabolism</term><level>2</level><descendants>
           <descendant><term>Process</term><level>3</level></descendant></descendants></descendant>
        <descendant><term></term><descendants><descendant><term>Lost</term></descendant></descendants></descendant>
      </descendants></root>
    <root><term>Role</term></root>
  </ontology>
  <experimental_properties><property><kind>logp</kind></property>
     <property><source>only source</source></property></experimental_properties>
  <predicted_properties><property><kind>pka</kind><value>3.1</value><source>calc</source></property></predicted_properties>
  <spectra><spectrum><type>NMR</type><spectrum_id>7</spectrum_id></spectrum><spectrum/></spectra>
  <biological_properties>
    <cellular_locations><cellular>Cytoplasm</cellular></cellular_locations>
    <biospecimen_locations><biospecimen>Blood</biospecimen></biospecimen_locations>
    <tissue_locations><tissue>Liver</tissue></tissue_locations>
    <pathways><pathway><name>TCA</name></pathway><pathway/></pathways>
  </biological_properties>
  <normal_concentrations>
    <concentration><biospecimen>Blood</biospecimen><concentration_value>10</concentration_value>
      <concentration_units>uM</concentration_units>
      <references><reference><reference_text>first</reference_text><pubmed_id>11</pubmed_id></reference>
        <reference><reference_text>later</reference_text><pubmed_id>11</pubmed_id></reference></references></concentration>
    <concentration/>
  </normal_concentrations>
  <abnormal_concentrations>
    <concentration><biospecimen>Urine</biospecimen><patient_age>Adult</patient_age>
      <references><reference/></references></concentration>
  </abnormal_concentrations>
  <diseases><disease><name>Gout</name><omim_id>123</omim_id>
     <references><reference><pubmed_id>9</pubmed_id></reference></references></disease>
     <disease><omim_id>no name</omim_id></disease></diseases>
  <protein_associations><protein><protein_accession>P1</protein_accession><name>Synthase</name>
     <gene_name>CS</gene_name></protein></protein_associations>
  <general_references><reference><reference_text>text</reference_text></reference></general_references>
  <kegg_id>C00158</kegg_id><pdb_id/>
  <synthesis_reference>Somebody</synthesis_reference>
</metabolite>
<metabolite><name>no accession</name></metabolite>
<metabolite>
  <accession>M2</accession><name/>
  <diseases><disease><name>Gout</name></disease></diseases>
</metabolite>
<metabolite>
  <accession>M1</accession><name>Citric acid 2</name><status>ok</status>
</metabolite>
</records>
"""

PROTEINS = """<?xml version="1.0"?>
<records>
<protein><accession>P1</accession><name>skipped</name>
  <pdb_ids><pdb_id>9XYZ</pdb_id></pdb_ids></protein>
<protein><accession>P2</accession><name>Kinase</name><gene_name>CK</gene_name>
  <secondary_accessions><accession>S1</accession></secondary_accessions>
  <metabolite_associations><metabolite><accession>M1</accession><name>one</name></metabolite>
     <metabolite><accession>M1</accession><name>two</name></metabolite></metabolite_associations>
  <gene_properties/>
  <general_references><reference><reference_text>\U0001F600a</reference_text></reference></general_references>
  <synonyms><synonym>CPK</synonym></synonyms>
  <pathways><pathway><smpdb_id>SMP1</smpdb_id><name>P</name></pathway></pathways>
  <protein_properties><residue_number>10</residue_number>
    <pfams><pfam><name>fam</name><pfam_id>PF1</pfam_id></pfam><pfam><name>no id</name></pfam></pfams>
    <transmembrane_regions><region>1-5</region><region/><region>9-12</region></transmembrane_regions>
    <signal_regions><region>3-4</region></signal_regions>
  </protein_properties>
  <metabolite_references>
    <metabolite_reference><metabolite><name>x</name></metabolite><reference><pubmed_id>5</pubmed_id></reference></metabolite_reference>
    <metabolite_reference><metabolite><accession>M9</accession></metabolite></metabolite_reference>
  </metabolite_references>
  <go_classifications><go_class><category>C</category><go_id>GO:1</go_id></go_class></go_classifications>
  <subcellular_locations><subcellular_location>Nucleus</subcellular_location></subcellular_locations>
  <pdb_ids><pdb_id>1ABC</pdb_id></pdb_ids>
</protein>
</records>
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("xml")
    (folder / "metabolites.xml").write_text(METABOLITES, encoding="utf8")
    (folder / "proteins.xml").write_text(PROTEINS, encoding="utf8")
    return folder


@pytest.fixture(scope="module")
def graph(spark, files, tmp_path_factory):
    store = GraphStore(spark, str(tmp_path_factory.mktemp("graph")))
    load_metabolites(spark, store, str(files / "metabolites.xml"))
    load_proteins(spark, store, str(files / "proteins.xml"))
    return store


def nodes(graph, label):
    key, _ = LABELS[label]
    return {row[key]: {k: v for k, v in row.asDict().items() if v is not None and k != key}
            for row in graph.nodes(label).collect()}


def edges(graph, rel):
    rows = graph.edges().filter(F.col("rel_type") == rel).collect()
    return sorted((r.src_label, r.src_key, r.dst_label, r.dst_key) for r in rows)


def test_record_nodes_merge_per_property(graph):
    found = nodes(graph, "Metabolite")
    # the second M1 record mentions every scalar, so what it lacks is gone; the taxonomy
    # description has a writer of its own and survives
    assert found == {
        "M1": {"name": "Citric acid 2", "status": "ok", "taxonomy_description": "An acid"},
        "M2": {},
    }


def test_text_rules(spark, files, tmp_path):
    records = parse_file(spark, GraphStore(spark, str(tmp_path)), str(files / "metabolites.xml"), "metabolite", METABOLITE)
    row = records.filter("version = '5'").collect()[0]
    assert (row["status"], row["state"], row["smiles"], row["description"]) == ("", None, None, "a")
    assert row["synonyms"]["synonym"][2] == "x < y & z"
    assert records.count() == 4
    assert malformed(records).count() == 0


def test_lists(graph):
    assert set(nodes(graph, "SecondaryAccession")) == {"S1", "S2"}
    assert edges(graph, "HAS_SECONDARY_ACCESSION") == [
        ("Metabolite", "M1", "SecondaryAccession", "S1"),
        ("Metabolite", "M1", "SecondaryAccession", "S2"),
        ("Protein", "P2", "SecondaryAccession", "S1"),
    ]
    assert set(nodes(graph, "Synonym")) == {"Citrate", "x < y & z", "CPK"}
    assert len(edges(graph, "HAS_SYNONYM")) == 3
    assert set(nodes(graph, "CellularLocation")) == {"Cytoplasm"}
    assert set(nodes(graph, "Biofluid")) == {"Blood"}
    assert set(nodes(graph, "Tissue")) == {"Liver"}
    assert len(edges(graph, "DETECTED_IN_CELLULAR_LOCATION")) == 1
    assert len(edges(graph, "DETECTED_IN_BIOFLUID")) == 1
    assert len(edges(graph, "DETECTED_IN_TISSUE")) == 1


def test_taxonomy_takes_the_last_level(graph):
    assert nodes(graph, "Taxonomy") == {
        "Organic": {"level": "kingdom"},
        "Acids": {"level": "alternative_parent"},
        "Carbonyl": {"level": "substituent"},
    }
    assert len(edges(graph, "HAS_TAXONOMY")) == 3


def test_ontology(graph):
    assert nodes(graph, "OntologyTerm") == {
        "Process": {"level": "3"},
        "Metabolism": {"level": "2"},
        "Role": {},
    }
    assert edges(graph, "HAS_CHILD_TERM") == [
        ("OntologyTerm", "Metabolism", "OntologyTerm", "Process"),
        ("OntologyTerm", "Process", "OntologyTerm", "Metabolism"),
    ]
    assert [e[3] for e in edges(graph, "HAS_ONTOLOGY_TERM")] == ["Metabolism", "Process", "Role"]


def test_keys_print_missing_parts(graph):
    assert nodes(graph, "ExperimentalProperty") == {"M1_logp_None": {"kind": "logp"}}
    assert set(nodes(graph, "PredictedProperty")) == {"M1_pka_3.1"}
    assert nodes(graph, "Spectrum") == {"M1_NMR_7": {"spectrum_type": "NMR", "spectrum_id": "7"}}
    assert nodes(graph, "Pathway") == {
        "__TCA": {"pathway_name": "TCA"},
        "SMP1__P": {"smpdb_id": "SMP1", "pathway_name": "P"},
    }
    assert len(edges(graph, "INVOLVED_IN_PATHWAY")) == 2


def test_concentrations_and_their_references(graph):
    assert set(nodes(graph, "NormalConcentration")) == {
        "M1_normal_Blood_10_None_None_None",
        "M1_normal_None_None_None_None_None",
    }
    assert set(nodes(graph, "AbnormalConcentration")) == {"M1_abnormal_Urine_None_Adult_None"}
    assert nodes(graph, "ConcentrationReference") == {
        "normalRef_M1_11_5": {"reference_text": "later", "pubmed_id": "11"},
        "abRef_M1__0": {},
    }
    assert edges(graph, "HAS_CONCENTRATION_REF") == [
        ("AbnormalConcentration", "M1_abnormal_Urine_None_Adult_None", "ConcentrationReference", "abRef_M1__0"),
        ("NormalConcentration", "M1_normal_Blood_10_None_None_None", "ConcentrationReference", "normalRef_M1_11_5"),
    ]
    assert len(edges(graph, "HAS_NORMAL_CONCENTRATION")) == 2
    assert len(edges(graph, "HAS_ABNORMAL_CONCENTRATION")) == 1


def test_diseases_lose_what_a_later_record_lacks(graph):
    assert nodes(graph, "Disease") == {"Gout": {}}
    assert [e[1] for e in edges(graph, "ASSOCIATED_WITH_DISEASE")] == ["M1", "M2"]
    assert edges(graph, "HAS_DISEASE_REFERENCE") == [("Disease", "Gout", "DiseaseReference", "diseaseRef_Gout_9_0")]


def test_other_metabolite_statements(graph):
    assert nodes(graph, "CrossReference") == {"M1_KEGG_C00158": {"source": "KEGG", "identifier": "C00158"}}
    assert nodes(graph, "SynthesisReference") == {"M1_synthesis": {"reference_text": "Somebody"}}
    assert edges(graph, "HAS_PROTEIN_ASSOCIATION") == [("Metabolite", "M1", "Protein", "P1")]
    assert set(nodes(graph, "GeneralReference")) == {"genRef_M1__4", "genProtRef_P2__2"}
    assert len(edges(graph, "HAS_CROSS_REFERENCE")) == 1
    assert len(edges(graph, "HAS_SYNTHESIS_REFERENCE")) == 1
    assert len(edges(graph, "HAS_GENERAL_REFERENCE")) == 2
    assert len(edges(graph, "HAS_SPECTRUM")) == 1
    assert len(edges(graph, "HAS_EXPERIMENTAL_PROPERTY")) == 1
    assert len(edges(graph, "HAS_PREDICTED_PROPERTY")) == 1


def test_known_proteins_are_skipped(graph):
    assert nodes(graph, "Protein") == {
        "P1": {"protein_name": "Synthase", "gene_name": "CS"},
        "P2": {"name": "Kinase", "gene_name": "CK"},
    }
    assert set(nodes(graph, "PdbID")) == {"1ABC"}


def test_protein_statements(graph):
    assert nodes(graph, "MetaboliteAssociation") == {"M1": {"name": "two"}}
    assert nodes(graph, "GeneProperty") == {"P2_geneProp": {}}
    assert nodes(graph, "ProteinProperty") == {"P2_prop": {"residue_number": "10"}}
    assert nodes(graph, "Pfam") == {"PF1": {"name": "fam"}}
    assert nodes(graph, "TransmembraneRegion") == {
        "P2_tm_1": {"description": "1-5"},
        "P2_tm_2": {},
        "P2_tm_3": {"description": "9-12"},
    }
    assert nodes(graph, "SignalRegion") == {"P2_sig_1": {"description": "3-4"}}
    assert nodes(graph, "MetaboliteReference") == {"P2_None_5": {"metabolite_name": "x", "pubmed_id": "5"}}
    assert nodes(graph, "GOClass") == {"GO:1": {"category": "C"}}
    assert set(nodes(graph, "SubcellularLocation")) == {"Nucleus"}
    for rel in ("ASSOCIATED_WITH_METABOLITE", "HAS_GENE_PROPERTY", "HAS_PROTEIN_PROPERTY", "HAS_PFAM",
                "HAS_SIGNAL_REGION", "HAS_METABOLITE_REFERENCE", "HAS_GO_CLASSIFICATION",
                "LOCATED_IN_SUBCELLULAR_LOCATION", "HAS_PDB_ID"):
        assert len(edges(graph, rel)) == 1, rel
    assert len(edges(graph, "HAS_TRANSMEMBRANE_REGION")) == 3


def test_every_edge_has_its_end_points_and_keys_are_unique(graph):
    all_edges = graph.edges()
    assert with_endpoints(all_edges, graph.all_nodes()).count() == all_edges.count()
    assert key_violations({label: (graph.nodes(label), LABELS[label][0]) for label in LABELS}).count() == 0


def test_job_prints_its_steps(spark, files, tmp_path, capsys):
    run_ingest.main(["--graph", str(tmp_path), "--proteins", str(files / "proteins.xml"), "--reset"])
    printed = capsys.readouterr().out
    assert "reset:" in printed and "proteins:" in printed and "total:" in printed and "warning" not in printed
    store = GraphStore(spark, str(tmp_path))
    assert store.snapshot() == 2 and store.nodes("Protein").count() == 2
    store.register_views()
    assert spark.sql("SELECT * FROM Pfam").count() == 1


def test_loading_again_changes_nothing(spark, files, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    load_metabolites(spark, store, str(files / "metabolites.xml"))
    before = sorted(map(str, store.all_nodes().collect())), sorted(store.edges().collect())
    load_metabolites(spark, store, str(files / "metabolites.xml"))
    assert store.snapshot() == 2
    assert (sorted(map(str, store.all_nodes().collect())), sorted(store.edges().collect())) == before
    load_proteins(spark, store, str(files / "proteins.xml"), skip_existing=False)
    found = nodes(store, "Protein")["P1"]
    # merged: the protein record mentions gene_name without a value, and not protein_name
    assert found == {"protein_name": "Synthase", "name": "skipped"}
    store.reset()
    assert store.edges().count() == 0 and store.all_nodes().count() == 0


def test_dead_load_leaves_the_graph_alone(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    first = store.begin()
    store.write_nodes("Disease", spark.createDataFrame([("d",)], "diseaseName string"), first)
    store.publish(first)
    dead = store.begin()  # writes a table and never publishes
    store.write_nodes("Disease", spark.createDataFrame([], "diseaseName string"), dead)
    later = store.begin()
    store.write_nodes("Tissue", spark.createDataFrame([("t",)], "tissueName string"), later)
    store.publish(later)
    assert store.nodes("Disease").count() == 1 and store.nodes("Tissue").count() == 1
    with pytest.raises(RuntimeError, match="run this one again"):
        store.publish(dead)
    assert store.nodes("Disease").count() == 1


def test_records_that_do_not_parse_are_kept_apart(spark, tmp_path, capsys):
    path = tmp_path / "m.xml"
    path.write_text("<r><metabolite><accession>M1</accession></metabolite><metabolite><accession>M2<oops></accession></metabolite></r>")
    store = GraphStore(spark, str(tmp_path / "g"))
    load_metabolites(spark, store, str(path))
    assert [r.accession for r in store.nodes("Metabolite").collect()] == ["M1"]
    assert "1 metabolite records do not parse" in capsys.readouterr().out
    bad = quarantined(store, "metabolite").collect()
    assert len(bad) == 1 and "M2" in bad[0]["_malformed"]
    assert quarantined(store, "protein").count() == 0
