"""Every record statement run on XML records made from the part table.

Two parts share an accession, so records repeat and the order of writes shows. A query
returns one row per edge with the merged properties of the node the edge points at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import shred
from ..operators.merge import distinct_edges, merge_writers, not_loaded
from ..schemas import CROSS_REFERENCES, LABELS, METABOLITE, PROTEIN, TEXT
from ..session import discard, fixed_tasks, staging_path, stored
from ..sources.graph_store import GraphStore, buckets_for
from ..sources.xml_records import parse_records
from .ingest import load_metabolites, load_proteins
from .registry import query, table

# parts that one task turns into records: a table of all parts may be a single file
PARTS_PER_TASK = 10_000
# records of a packed file, which one task reads
PER_FILE = 2_000
# node writes, or edges, that one task merges and joins
WRITES_PER_TASK = 200_000

# Expressions both Spark and DuckDB read.
ACC = "concat('A', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING))"
SIZE = "CAST(p_size AS STRING)"
BIG = f"CASE WHEN p_size > 25 THEN {SIZE} END"
BIG_NAME = "CASE WHEN p_size > 25 THEN p_name END"
TYPE = "nullif(p_type, 'PROMO')"
LEVEL = "CASE WHEN p_size < 10 THEN p_type ELSE p_brand END"


def _struct(**fields: str) -> str:
    """A structure; fields left out of a record are absent from its XML."""
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _list(*items: str) -> str:
    return "array(" + ", ".join(items) + ")"


_NONE = "CAST(NULL AS STRING)"


def _refs(*items: tuple[str, str]) -> str:
    return _struct(reference=_list(*[_struct(reference_text=text, pubmed_id=pubmed) for text, pubmed in items]))


_CONCENTRATION_REFS = _refs(("p_name", SIZE), ("p_brand", SIZE))

# what a property holds once it is read: values without space at their ends
METABOLITE_PROPS = {
    "version": SIZE,
    "creation_date": f"concat('2020-', {SIZE})",
    "update_date": BIG,
    "status": TYPE,
    "name": "p_name",
    "description": "concat('about ', p_brand)",
    "chemical_formula": "p_brand",
    "average_molecular_weight": f"concat({SIZE}, '.5')",
    "monoisotopic_molecular_weight": SIZE,
    "iupac_name": BIG_NAME,
    "traditional_iupac": TYPE,
    "cas_registry_number": BIG,
    "smiles": "concat(p_brand, '=O<')",
    "inchi": "concat(p_type, '&', p_brand)",
    "inchikey": "substr(p_name, 1, 3)",
    "state": BIG,
}
CROSS_FIELDS = {
    "foodb_id": "p_name",
    "kegg_id": "p_brand",
    "chemspider_id": SIZE,
    "chebi_id": "''",
    "pubchem_compound_id": BIG,
    "pdb_id": TYPE,
    "biocyc_id": f"concat('B', {SIZE})",
    "drugbank_id": TYPE,
    "phenol_explorer_compound_id": "p_brand",
    "wikipedia_id": BIG_NAME,
    "knapsack_id": BIG,
    "bigg_id": SIZE,
    "metlin_id": "p_type",
    "vmh_id": f"concat(p_brand, {SIZE})",
}

METABOLITE_FIELDS = {
    "accession": ACC,
    **{"monisotopic_molecular_weight" if name == "monoisotopic_molecular_weight" else name: value for name, value in METABOLITE_PROPS.items()},
    "description": "concat(' about ', p_brand, ' ')",
    "synthesis_reference": BIG_NAME,
    **CROSS_FIELDS,
    "secondary_accessions": _struct(accession=_list("p_brand", "''")),
    "synonyms": _struct(synonym=_list("p_name", "concat('  ', p_type, ' ')", "'  '")),
    "taxonomy": _struct(
        description=BIG_NAME,
        direct_parent="p_brand",
        kingdom="'Parts'",
        super_class="concat(p_type, 's')",
        **{"class": "p_type"},
        sub_class=BIG,
        molecular_framework="substr(p_type, 1, 4)",
        alternative_parents=_struct(alternative_parent=_list(LEVEL)),
        substituents=_struct(substituent=_list("substr(p_name, 1, 3)", "''")),
        external_descriptors=_struct(external_descriptor=_list(TYPE.replace("PROMO", "none"))),
    ),
    "experimental_properties": _struct(
        property=_list(
            _struct(kind="p_type", value=SIZE, source="p_brand"),
            _struct(kind=_NONE, value=_NONE, source="'only source'"),
            _struct(kind="p_name", value=_NONE, source=_NONE),
        )
    ),
    "predicted_properties": _struct(property=_list(_struct(kind="p_brand", value=TYPE, source="p_name"))),
    "spectra": _struct(
        spectrum=_list(_struct(type="p_type", spectrum_id=SIZE), _struct(type=_NONE, spectrum_id=_NONE))
    ),
    "biological_properties": _struct(
        cellular_locations=_struct(cellular=_list("p_type")),
        biospecimen_locations=_struct(biospecimen=_list("p_brand", "''")),
        tissue_locations=_struct(tissue=_list("p_name")),
        pathways=_struct(
            pathway=_list(
                _struct(name="p_name", smpdb_id=TYPE, kegg_map_id=_NONE),
                _struct(name=_NONE, smpdb_id=_NONE, kegg_map_id=_NONE),
            )
        ),
    ),
    "normal_concentrations": _struct(
        concentration=_list(
            _struct(biospecimen="p_type", concentration_value=BIG, concentration_units="p_brand",
                    subject_age="'Adult'", comment="p_name", references=_CONCENTRATION_REFS)
        )
    ),
    "abnormal_concentrations": _struct(
        concentration=_list(
            _struct(biospecimen="p_type", concentration_value=BIG, concentration_units="p_brand",
                    patient_sex="'Both'", patient_information="p_name", references=_CONCENTRATION_REFS)
        )
    ),
    "diseases": _struct(
        disease=_list(
            _struct(name="p_type", omim_id=BIG, references=_refs(("p_name", SIZE))),
            _struct(name=_NONE, omim_id="'no name'", references=_refs(("p_name", SIZE))),
        )
    ),
    "protein_associations": _struct(
        protein=_list(
            _struct(protein_accession="p_brand", name="p_name", gene_name=TYPE),
            _struct(protein_accession=_NONE, name="'no accession'", gene_name=_NONE),
        )
    ),
    "general_references": _refs(("p_name", _NONE), (_NONE, SIZE), (_NONE, _NONE)),
}

PROTEIN_PROPS = {
    "uniprot_id": "p_brand",
    "gene_name": TYPE,
    "protein_type": "p_type",
    "specific_function": BIG_NAME,
    "uniprot_name": "concat(p_brand, '_X')",
    "creation_date": f"concat('2020-', {SIZE})",
    "update_date": BIG,
    "genbank_protein_id": SIZE,
    "general_function": BIG,
    "geneatlas_id": TYPE,
    "name": "p_name",
    "version": SIZE,
    "genecard_id": BIG,
    "hgnc_id": "concat('HGNC:', p_brand)",
    "genbank_gene_id": "substr(p_name, 1, 3)",
}

PROTEIN_FIELDS = {
    "accession": ACC,
    **PROTEIN_PROPS,
    "secondary_accessions": _struct(accession=_list("p_name", "''")),
    "metabolite_associations": _struct(
        metabolite=_list(_struct(accession="p_brand", name="p_name"), _struct(accession=_NONE, name="'x'"))
    ),
    "gene_properties": f"CASE WHEN p_size > 10 THEN {_struct(locus=TYPE, gene_sequence=BIG)} END",
    "general_references": _refs(("p_brand", SIZE)),
    "synonyms": _struct(synonym=_list("p_brand", "''")),
    "pathways": _struct(pathway=_list(_struct(name=TYPE, smpdb_id="p_brand"))),
    "protein_properties": _struct(
        molecular_weight=SIZE,
        residue_number=BIG,
        pfams=_struct(pfam=_list(_struct(name="p_name", pfam_id="p_brand"), _struct(name="'x'", pfam_id=_NONE))),
        transmembrane_regions=_struct(region=_list("p_type", "''", "p_brand")),
        signal_regions=_struct(region=_list("p_name")),
    ),
    "metabolite_references": _struct(
        metabolite_reference=_list(
            _struct(metabolite=_struct(accession=TYPE, name="p_name"), reference=_struct(pubmed_id=SIZE, reference_text="p_brand")),
            _struct(metabolite=_struct(accession="'lonely'", name=_NONE), reference="NULL"),
        )
    ),
    "go_classifications": _struct(
        go_class=_list(
            _struct(category="p_type", go_id="p_brand", description=BIG_NAME),
            _struct(category="'x'", go_id=_NONE, description=_NONE),
        )
    ),
    "subcellular_locations": _struct(subcellular_location=_list("p_type")),
    "pdb_ids": _struct(pdb_id=_list("p_name", "''")),
}

_ONTOLOGY = """concat(
  '<ontology><root><term>', p_type, '</term><level>1</level><descendants><descendant><term> ', p_brand,
  '</term><level>', CAST(p_size AS STRING), '</level><type>t</type><descendants><descendant><term>', p_name,
  '</term></descendant></descendants></descendant><descendant><term/><descendants><descendant><term>lost',
  '</term></descendant></descendants></descendant></descendants></root></ontology></metabolite>')"""


def dealt(parts: DataFrame) -> DataFrame:
    """Parts in the order in which they are read, in ranges of so few that their records fit a task."""
    n = max(1, math.ceil(parts.count() / PARTS_PER_TASK))
    placed = parts.withColumn("_at", F.monotonically_increasing_id())
    return placed.repartitionByRange(n, "_at").sortWithinPartitions("_at").drop("_at")


def xml_records(parts: DataFrame, tag: str, fields: dict[str, str], ontology: bool = False) -> DataFrame:
    """One XML record per part, placed by its key: (_file, _block, _row, record)."""
    columns = [F.expr(value).alias(name) for name, value in fields.items()]
    record = F.to_xml(F.struct(*columns), {"rowTag": tag, "indent": ""})
    if ontology:
        record = F.replace(record, F.lit(f"</{tag}>"), F.expr(_ONTOLOGY))
    return dealt(parts).select(
        F.lit("").alias("_file"), F.lit(0).cast("bigint").alias("_block"), F.col("p_partkey").alias("_row"),
        record.alias("record"),
    )


def write_packed(records: DataFrame, path: str) -> int:
    """Records as gzipped text, which takes a small part of the disk; returns the bytes of the text.

    A packed file is read by one task, so files are short.
    """
    seen = Observation()
    counted = records.observe(seen, F.sum(F.octet_length("record") + 1).alias("size"))
    counted.write.option("maxRecordsPerFile", PER_FILE).text(path, compression="gzip")
    return seen.get["size"] or 0


def _parsed(spark: SparkSession, folder: str, kind: str, needed: list[str], path: str | None = None) -> DataFrame:
    """Records holding only what a query needs, through XML and back; stored at the path, if one is named."""
    shape, fields, tag = (
        (METABOLITE, METABOLITE_FIELDS, "metabolite") if kind == "Metabolite" else (PROTEIN, PROTEIN_FIELDS, "protein")
    )
    ontology = "ontology" in needed
    names = ["accession", *[name for name in needed if name != "ontology"]]
    parts = table(spark, folder, "part")
    records = xml_records(parts, tag, {name: fields[name] for name in names}, ontology)
    # stored, as the load job does: filters and generators above would repeat the parse
    return stored(parse_records(records, {name: shape[name] for name in names}, ontology), f"{tag}-records", path)


def _edges_with_nodes(records: DataFrame, kind: str, writers: list[shred.Writer]) -> DataFrame:
    """One row per edge: its ends, and the properties of the node it points at."""
    label = writers[0].label
    key, props = LABELS[label]
    nodes = merge_writers([shred.node_writes(records, writer, 0) for writer in writers], key)
    edges = distinct_edges([shred.edge_writes(records, writer, kind) for writer in writers])
    known = [name for name in props if name in nodes.columns]
    named = nodes.select(F.col(key).alias("dst_key"), *[F.col(name).alias(f"p_{name}") for name in known])
    joined = edges.join(named, "dst_key", "left").select(
        "src_label", "src_key", "rel_type", "dst_label", "dst_key", *[f"p_{name}" for name in known]
    )
    return _stored_edges(joined, records, kind, writers)


def _stored_edges(edges: DataFrame, records: DataFrame, kind: str, writers: list[shred.Writer]) -> DataFrame:
    """Edges made from records, stored: by as many tasks as there are writes for, whatever the session is set to.

    A record has many writes and each is sorted to be merged, so what a task holds is told by them and not by bytes.
    """
    spark = records.sparkSession
    writes = sum(shred.edge_writes(records, writer, kind).count() for writer in writers)
    slots = spark.sparkContext.defaultParallelism
    readers, mergers = math.ceil(records.count() / PARTS_PER_TASK), math.ceil(writes / WRITES_PER_TASK)
    with fixed_tasks(spark, max(slots, readers), max(slots, mergers)):
        return stored(edges, "edges")


def merged_sql(writes: str, rel: str, src_label: str, label: str, props: list[str]) -> str:
    """SQL for the same: ``writes`` selects (r, i, j, src, k, properties)."""
    columns = "".join(f", n.{name} AS p_{name}" for name in props)
    return f"""
WITH w AS ({writes}),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r DESC, i DESC, j DESC) AS rn FROM w) WHERE rn = 1)
SELECT DISTINCT '{src_label}' AS src_label, w.src AS src_key, '{rel}' AS rel_type, '{label}' AS dst_label,
  w.k AS dst_key{columns}
FROM w JOIN n ON n.k = w.k"""


def _writes(*selects: tuple, guard: str = "k IS NOT NULL AND k <> ''") -> str:
    """Union of (i, j, source key, key, {property: value}) over all parts."""
    parts = []
    for i, j, src, key, props in selects:
        columns = "".join(f", CAST({value} AS STRING) AS {name}" for name, value in props.items())
        parts.append(f"SELECT p_partkey AS r, {i} AS i, {j} AS j, {src} AS src, {key} AS k{columns} FROM part")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {guard}"


def _none(value: str) -> str:
    return f"coalesce({value}, 'None')"


def _empty(value: str) -> str:
    return f"coalesce({value}, '')"


def _joined(*parts: str) -> str:
    return "concat(" + ", '_', ".join(parts) + ")"


def _ref_key(prefix: str, owner: str, text: str, pubmed: str) -> str:
    return _joined(f"'{prefix}'", owner, _empty(pubmed), f"CAST(length({_empty(text)}) AS STRING)")


def _ref(i, j, src, prefix, owner, text, pubmed) -> tuple:
    return i, j, src, _ref_key(prefix, owner, text, pubmed), {"reference_text": text, "pubmed_id": pubmed}


_NORMAL_KEY = _joined(ACC, "'normal'", "p_type", _none(BIG), "'Adult'", "'None'", "'None'")
_ABNORMAL_KEY = _joined(ACC, "'abnormal'", "p_type", _none(BIG), "'None'", "'Both'")

# query name -> record kind, statement, columns it needs, SQL of its writes
_STATEMENTS = {
    "shred_secondary_accessions": ("Metabolite", "E02", ["secondary_accessions"], _writes((0, 0, ACC, "p_brand", {}))),
    "shred_synonyms": ("Metabolite", "E03", ["synonyms"], _writes((0, 0, ACC, "p_name", {}), (1, 0, ACC, "p_type", {}))),
    "shred_taxonomy": (
        "Metabolite", "E04", ["taxonomy"],
        _writes(
            (0, 0, ACC, "p_brand", {"level": "'direct_parent'"}),
            (1, 0, ACC, "'Parts'", {"level": "'kingdom'"}),
            (2, 0, ACC, "concat(p_type, 's')", {"level": "'super_class'"}),
            (3, 0, ACC, "p_type", {"level": "'class'"}),
            (4, 0, ACC, BIG, {"level": "'sub_class'"}),
            (5, 0, ACC, "substr(p_type, 1, 4)", {"level": "'molecular_framework'"}),
            (6, 0, ACC, LEVEL, {"level": "'alternative_parent'"}),
            (7, 0, ACC, "substr(p_name, 1, 3)", {"level": "'substituent'"}),
            (9, 0, ACC, "p_type", {"level": "'external_descriptor'"}),
        ),
    ),
    "shred_ontology_terms": (
        "Metabolite", "E05", ["ontology"],
        _writes(
            (0, 0, ACC, "p_type", {"definition": "NULL", "level": "'1'", "term_type": "NULL"}),
            (1, 0, ACC, "p_brand", {"definition": "NULL", "level": SIZE, "term_type": "'t'"}),
            (2, 0, ACC, "p_name", {"definition": "NULL", "level": "NULL", "term_type": "NULL"}),
        ),
    ),
    "shred_experimental_properties": (
        "Metabolite", "E06", ["experimental_properties"],
        _writes(
            (0, 0, ACC, _joined(ACC, "p_type", SIZE), {"kind": "p_type", "value": SIZE, "source": "p_brand"}),
            (2, 0, ACC, _joined(ACC, "p_name", "'None'"), {"kind": "p_name", "value": "NULL", "source": "NULL"}),
        ),
    ),
    "shred_predicted_properties": (
        "Metabolite", "E07", ["predicted_properties"],
        _writes((0, 0, ACC, _joined(ACC, "p_brand", _none(TYPE)), {"kind": "p_brand", "value": TYPE, "source": "p_name"})),
    ),
    "shred_spectra": (
        "Metabolite", "E08", ["spectra"],
        _writes((0, 0, ACC, _joined(ACC, "p_type", SIZE), {"spectrum_type": "p_type", "spectrum_id": SIZE})),
    ),
    "shred_cellular_locations": ("Metabolite", "E09", ["biological_properties"], _writes((0, 0, ACC, "p_type", {}))),
    "shred_biofluids": ("Metabolite", "E10", ["biological_properties"], _writes((0, 0, ACC, "p_brand", {}))),
    "shred_tissues": ("Metabolite", "E11", ["biological_properties"], _writes((0, 0, ACC, "p_name", {}))),
    "shred_pathways": (
        "Metabolite", "E12", ["biological_properties"],
        _writes((0, 0, ACC, _joined(_empty(TYPE), "''", "p_name"), {"pathway_name": "p_name", "smpdb_id": TYPE, "kegg_map_id": "NULL"})),
    ),
    "shred_normal_concentrations": (
        "Metabolite", "E13", ["normal_concentrations"],
        _writes((0, 0, ACC, _NORMAL_KEY, {
            "biospecimen": "p_type", "concentration_value": BIG, "concentration_units": "p_brand",
            "subject_age": "'Adult'", "subject_sex": "NULL", "subject_condition": "NULL", "comment": "p_name"})),
    ),
    "shred_normal_references": (
        "Metabolite", "E14", ["normal_concentrations"],
        _writes(_ref(0, 0, _NORMAL_KEY, "normalRef", ACC, "p_name", SIZE), _ref(0, 1, _NORMAL_KEY, "normalRef", ACC, "p_brand", SIZE)),
    ),
    "shred_abnormal_concentrations": (
        "Metabolite", "E15", ["abnormal_concentrations"],
        _writes((0, 0, ACC, _ABNORMAL_KEY, {
            "biospecimen": "p_type", "concentration_value": BIG, "concentration_units": "p_brand",
            "patient_age": "NULL", "patient_sex": "'Both'", "patient_information": "p_name", "comment": "NULL"})),
    ),
    "shred_abnormal_references": (
        "Metabolite", "E16", ["abnormal_concentrations"],
        _writes(_ref(0, 0, _ABNORMAL_KEY, "abRef", ACC, "p_name", SIZE), _ref(0, 1, _ABNORMAL_KEY, "abRef", ACC, "p_brand", SIZE)),
    ),
    "shred_diseases": ("Metabolite", "E17", ["diseases"], _writes((0, 0, ACC, "p_type", {"omim_id": BIG}))),
    "shred_disease_references": (
        "Metabolite", "E18", ["diseases"], _writes(_ref(0, 0, "p_type", "diseaseRef", "p_type", "p_name", SIZE)),
    ),
    "shred_protein_associations": (
        "Metabolite", "E19", ["protein_associations"],
        _writes((0, 0, ACC, "p_brand", {"protein_name": "p_name", "uniprot_id": "NULL", "gene_name": TYPE, "protein_type": "NULL"})),
    ),
    "shred_general_references": (
        "Metabolite", "E20", ["general_references"],
        _writes(
            _ref(0, 0, ACC, "genRef", ACC, "p_name", "NULL"),
            _ref(1, 0, ACC, "genRef", ACC, "NULL", SIZE),
            _ref(2, 0, ACC, "genRef", ACC, "NULL", "NULL"),
        ),
    ),
    "shred_cross_references": (
        "Metabolite", "E21", list(CROSS_FIELDS),
        _writes(*[
            (i, 0, ACC, f"CASE WHEN {CROSS_FIELDS[field]} <> '' THEN {_joined(ACC, repr(source), CROSS_FIELDS[field])} END",
             {"source": repr(source), "identifier": CROSS_FIELDS[field]})
            for i, (field, source) in enumerate(CROSS_REFERENCES.items())
        ]),
    ),
    "shred_synthesis_reference": (
        "Metabolite", "E22", ["synthesis_reference"],
        _writes((0, 0, ACC, f"CASE WHEN p_size > 25 THEN {_joined(ACC, chr(39) + 'synthesis' + chr(39))} END", {"reference_text": "p_name"})),
    ),
    "shred_protein_secondary_accessions": ("Protein", "E24", ["secondary_accessions"], _writes((0, 0, ACC, "p_name", {}))),
    "shred_metabolite_associations": (
        "Protein", "E25", ["metabolite_associations"], _writes((0, 0, ACC, "p_brand", {"name": "p_name"})),
    ),
    "shred_gene_properties": (
        "Protein", "E26", ["gene_properties"],
        _writes((0, 0, ACC, f"CASE WHEN p_size > 10 THEN {_joined(ACC, chr(39) + 'geneProp' + chr(39))} END",
                 {"locus": TYPE, "chromosome_location": "NULL", "gene_sequence": BIG})),
    ),
    "shred_protein_general_references": (
        "Protein", "E27", ["general_references"], _writes(_ref(0, 0, ACC, "genProtRef", ACC, "p_brand", SIZE)),
    ),
    "shred_protein_synonyms": ("Protein", "E28", ["synonyms"], _writes((0, 0, ACC, "p_brand", {}))),
    "shred_protein_pathways": (
        "Protein", "E29", ["pathways"],
        _writes((0, 0, ACC, _joined("p_brand", "''", _empty(TYPE)), {"pathway_name": TYPE, "smpdb_id": "p_brand", "kegg_map_id": "NULL"})),
    ),
    "shred_protein_properties": (
        "Protein", "E30", ["protein_properties"],
        _writes((0, 0, ACC, _joined(ACC, "'prop'"), {
            "molecular_weight": SIZE, "polypeptide_sequence": "NULL", "theoretical_pi": "NULL", "residue_number": BIG})),
    ),
    "shred_pfams": ("Protein", "E31", ["protein_properties"], _writes((0, 0, ACC, "p_brand", {"name": "p_name"}))),
    "shred_transmembrane_regions": (
        "Protein", "E32", ["protein_properties"],
        _writes(
            (0, 0, ACC, _joined(ACC, "'tm'", "'1'"), {"description": "p_type"}),
            (1, 0, ACC, _joined(ACC, "'tm'", "'2'"), {"description": "NULL"}),
            (2, 0, ACC, _joined(ACC, "'tm'", "'3'"), {"description": "p_brand"}),
        ),
    ),
    "shred_signal_regions": (
        "Protein", "E33", ["protein_properties"], _writes((0, 0, ACC, _joined(ACC, "'sig'", "'1'"), {"description": "p_name"})),
    ),
    "shred_metabolite_references": (
        "Protein", "E34", ["metabolite_references"],
        _writes((0, 0, ACC, _joined(ACC, _none(TYPE), SIZE), {
            "metabolite_accession": TYPE, "metabolite_name": "p_name", "pubmed_id": SIZE, "reference_text": "p_brand"})),
    ),
    "shred_go_classes": (
        "Protein", "E35", ["go_classifications"],
        _writes((0, 0, ACC, "p_brand", {"category": "p_type", "description": BIG_NAME})),
    ),
    "shred_subcellular_locations": ("Protein", "E36", ["subcellular_locations"], _writes((0, 0, ACC, "p_type", {}))),
    "shred_pdb_ids": ("Protein", "E37", ["pdb_ids"], _writes((0, 0, ACC, "p_name", {}))),
}

def _statement_query(name: str, kind: str, statement: str, needed: list[str], writes: str) -> None:
    # label, type and properties are needed for the SQL before any session exists
    label, rel = _TARGETS[statement]
    props = LABELS[label][1] if statement != "E19" else ["protein_name", "uniprot_id", "gene_name", "protein_type"]
    source = _SOURCES.get(statement, kind)

    @query(name, merged_sql(writes, rel, source, label, props))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = staging_path(spark, f"{kind.lower()}-records")
        records = _parsed(spark, folder, kind, needed, path)
        writers = shred.metabolite_writers() if kind == "Metabolite" else shred.protein_writers()
        edges = _edges_with_nodes(records, kind, [w for w in writers if w.name == statement])
        discard(spark, path)
        return edges


_TARGETS = {
    "E02": ("SecondaryAccession", "HAS_SECONDARY_ACCESSION"),
    "E03": ("Synonym", "HAS_SYNONYM"),
    "E04": ("Taxonomy", "HAS_TAXONOMY"),
    "E05": ("OntologyTerm", "HAS_ONTOLOGY_TERM"),
    "E06": ("ExperimentalProperty", "HAS_EXPERIMENTAL_PROPERTY"),
    "E07": ("PredictedProperty", "HAS_PREDICTED_PROPERTY"),
    "E08": ("Spectrum", "HAS_SPECTRUM"),
    "E09": ("CellularLocation", "DETECTED_IN_CELLULAR_LOCATION"),
    "E10": ("Biofluid", "DETECTED_IN_BIOFLUID"),
    "E11": ("Tissue", "DETECTED_IN_TISSUE"),
    "E12": ("Pathway", "INVOLVED_IN_PATHWAY"),
    "E13": ("NormalConcentration", "HAS_NORMAL_CONCENTRATION"),
    "E14": ("ConcentrationReference", "HAS_CONCENTRATION_REF"),
    "E15": ("AbnormalConcentration", "HAS_ABNORMAL_CONCENTRATION"),
    "E16": ("ConcentrationReference", "HAS_CONCENTRATION_REF"),
    "E17": ("Disease", "ASSOCIATED_WITH_DISEASE"),
    "E18": ("DiseaseReference", "HAS_DISEASE_REFERENCE"),
    "E19": ("Protein", "HAS_PROTEIN_ASSOCIATION"),
    "E20": ("GeneralReference", "HAS_GENERAL_REFERENCE"),
    "E21": ("CrossReference", "HAS_CROSS_REFERENCE"),
    "E22": ("SynthesisReference", "HAS_SYNTHESIS_REFERENCE"),
    "E24": ("SecondaryAccession", "HAS_SECONDARY_ACCESSION"),
    "E25": ("MetaboliteAssociation", "ASSOCIATED_WITH_METABOLITE"),
    "E26": ("GeneProperty", "HAS_GENE_PROPERTY"),
    "E27": ("GeneralReference", "HAS_GENERAL_REFERENCE"),
    "E28": ("Synonym", "HAS_SYNONYM"),
    "E29": ("Pathway", "INVOLVED_IN_PATHWAY"),
    "E30": ("ProteinProperty", "HAS_PROTEIN_PROPERTY"),
    "E31": ("Pfam", "HAS_PFAM"),
    "E32": ("TransmembraneRegion", "HAS_TRANSMEMBRANE_REGION"),
    "E33": ("SignalRegion", "HAS_SIGNAL_REGION"),
    "E34": ("MetaboliteReference", "HAS_METABOLITE_REFERENCE"),
    "E35": ("GOClass", "HAS_GO_CLASSIFICATION"),
    "E36": ("SubcellularLocation", "LOCATED_IN_SUBCELLULAR_LOCATION"),
    "E37": ("PdbID", "HAS_PDB_ID"),
}

# statements whose edges start at a node other than the record
_SOURCES = {"E14": "NormalConcentration", "E16": "AbnormalConcentration", "E18": "Disease"}

for _name, _spec in _STATEMENTS.items():
    _statement_query(_name, *_spec)


@query(
    "shred_child_terms",
    """SELECT DISTINCT * FROM (SELECT p_type AS src_key, p_brand AS dst_key FROM part
       UNION ALL SELECT p_brand, p_name FROM part)""",
)
def child_terms(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "metabolite-records")
    records = _parsed(spark, folder, "Metabolite", ["ontology"], path)
    writer = shred.child_terms()
    edges = _stored_edges(distinct_edges([shred.edge_writes(records, writer, "Metabolite")]), records, "Metabolite", [writer])
    discard(spark, path)
    return edges.select("src_key", "dst_key")


def _last_sql(key: str, columns: dict[str, str], where: str = "true") -> str:
    listed = ", ".join(f"{value} AS {name}" for name, value in columns.items())
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT {key} AS accession, {listed},
      row_number() OVER (PARTITION BY {key} ORDER BY p_partkey DESC) AS rn FROM part WHERE {where}) WHERE rn = 1"""


@query(
    "metabolite_nodes",
    f"""SELECT a.*, b.taxonomy_description FROM ({_last_sql(ACC, METABOLITE_PROPS)}) a
    LEFT JOIN ({_last_sql(ACC, {"taxonomy_description": "p_name"}, "p_size > 25")}) b ON a.accession = b.accession""",
)
def metabolite_nodes(spark: SparkSession, folder: str) -> DataFrame:
    needed = [name for name in METABOLITE_FIELDS if METABOLITE[name] == TEXT and name not in CROSS_FIELDS]
    records = _parsed(spark, folder, "Metabolite", [name for name in needed if name not in ("accession", "synthesis_reference")] + ["taxonomy"])
    writers = [shred.record_writes(records, "Metabolite", 0), shred.taxonomy_description_writes(records, 0)]
    return merge_writers(writers, "accession")


@query(
    "protein_nodes",
    f"""SELECT * FROM ({_last_sql(ACC, PROTEIN_PROPS)})
    WHERE accession NOT IN (SELECT concat('A', CAST(l_suppkey AS STRING)) FROM lineitem)""",
)
def protein_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Proteins the graph does not have yet; here those named like a supplier with lines are known."""
    records = _parsed(spark, folder, "Protein", list(PROTEIN_PROPS))
    existing = table(spark, folder, "lineitem").select(F.concat(F.lit("A"), F.col("l_suppkey")).alias("proteinAcc"))
    fresh = not_loaded(records, existing.distinct(), "accession", "proteinAcc")
    merged = merge_writers([shred.record_writes(fresh, "Protein", 1)], "proteinAcc")
    return merged.withColumnRenamed("proteinAcc", "accession").select("accession", *PROTEIN_PROPS)


@query(
    "protein_two_writers",
    f"""WITH a AS (SELECT p_brand AS k, p_partkey AS r, p_name, {TYPE} AS gene FROM part),
    la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r DESC) AS rn FROM a) WHERE rn = 1),
    b AS ({_last_sql("p_brand", {"gene_b": "p_type", "name_b": "p_name"}, "p_size > 48")})
    SELECT la.k AS "proteinAcc", la.p_name AS protein_name, CASE WHEN b.accession IS NULL THEN la.gene ELSE b.gene_b END AS gene_name,
      b.name_b AS name FROM la LEFT JOIN b ON b.accession = la.k""",
)
def protein_two_writers(spark: SparkSession, folder: str) -> DataFrame:
    """A protein written by a metabolite pass and then by a protein pass keeps what only the first mentions."""
    metabolites = _parsed(spark, folder, "Metabolite", ["protein_associations"])
    writer = next(w for w in shred.metabolite_writers() if w.name == "E19")
    first = shred.node_writes(metabolites, writer, 0).select("proteinAcc", "protein_name", "gene_name", "_order")
    second = (
        table(spark, folder, "part").filter("p_size > 48")
        .select(
            F.col("p_brand").alias("proteinAcc"), F.col("p_type").alias("gene_name"), F.col("p_name").alias("name"),
            F.lit("").alias("_file"), F.lit(0).cast("bigint").alias("_block"), F.col("p_partkey").alias("_row"),
        )
        .withColumn("_order", shred.order_of(1, 0))
        .drop("_file", "_block", "_row")
    )
    return merge_writers([first, second], "proteinAcc").select("proteinAcc", "protein_name", "gene_name", "name")


def _graph_sql() -> str:
    """Every edge and node of the loaded graph, from the writes of all statements."""
    selects = []
    for kind, statement, _, writes in _STATEMENTS.values():
        label, rel = _TARGETS[statement]
        source = _SOURCES.get(statement, kind)
        selects.append(f"SELECT '{source}' AS src_label, src AS src_key, '{rel}' AS rel_type, '{label}' AS dst_label, k AS dst_key FROM ({writes})")
        selects.append(f"SELECT '{label}', k, 'NODE', NULL, NULL FROM ({writes})")
    for parent, child in (("p_type", "p_brand"), ("p_brand", "p_name")):
        selects.append(f"SELECT 'OntologyTerm', {parent}, 'HAS_CHILD_TERM', 'OntologyTerm', {child} FROM part")
    for kind in ("Metabolite", "Protein"):
        selects.append(f"SELECT '{kind}', {ACC}, 'NODE', NULL, NULL FROM part")
    return " UNION ".join(selects)


@query("graph_load", _graph_sql())
def graph_load(spark: SparkSession, folder: str) -> DataFrame:
    """Both load jobs on XML files, then all edges and the keys of all nodes."""
    parts = table(spark, folder, "part")
    store = None
    for tag, fields, load in (
        ("metabolite", METABOLITE_FIELDS, load_metabolites),
        ("protein", PROTEIN_FIELDS, load_proteins),
    ):
        path = staging_path(spark, f"{tag}-xml")
        size = write_packed(xml_records(parts, tag, fields, tag == "metabolite").select("record"), path)
        store = store or GraphStore(spark, staging_path(spark, "graph"), buckets_for(size))
        load(spark, store, path)
        discard(spark, path)
    none = F.lit(None).cast("string")
    nodes = store.all_nodes().select("label", "pk", F.lit("NODE"), none, none)
    return store.edges().union(nodes)
