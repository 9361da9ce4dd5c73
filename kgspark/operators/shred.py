"""Records to node writes and edges.

Each *writer* states where the items of a record are, which of them count, how the key is
formed and which properties are set. A writer turns a table of parsed records into one frame of node
writes and one of edges; both read only the columns of that writer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_nonempty, joined, nonempty, or_empty, or_none, text_length
from ..schemas import CROSS_REFERENCES, LABELS, TAXONOMY_LISTS, TAXONOMY_SINGLE
from ..sources.xml_records import POSITION
from .merge import ORDER


def _record_key() -> Column:
    return F.col("accession")


def _item() -> Column:
    """An item of the list a writer reads: a text or a structure."""
    return F.col("item")


def _sub() -> Column:
    """An item of the list inside an item."""
    return F.col("sub")


@dataclass(frozen=True)
class Writer:
    """One statement of the ETL. ``step`` is its place among the statements of a record."""

    name: str
    step: int
    label: str
    rel: str | None
    items: Column
    key: Column
    props: dict[str, Column] = field(default_factory=dict)
    keep: Column | None = None
    inner: Column | None = None  # list inside each item
    source: tuple[str, Column] | None = None  # (label, key) the edge starts at, if not the record


def _rows(records: DataFrame, writer: Writer, order: bool) -> DataFrame:
    positions = POSITION if order else []
    rows = records.select(*positions, "accession", F.posexplode(writer.items).alias("i", "item"))
    if writer.inner is not None:
        rows = rows.select("*", F.posexplode(writer.inner).alias("j", "sub"))
    else:
        rows = rows.withColumn("j", F.lit(0))
    return rows.filter(writer.keep) if writer.keep is not None else rows


def order_of(passno: int, step: int, i: Column | None = None, j: Column | None = None) -> Column:
    """Order of writes: pass, then document order, then statement, then place in the list."""
    zero = F.lit(0)
    return F.struct(
        F.lit(passno).alias("pass"),
        *POSITION,
        F.lit(step).alias("step"),
        (zero if i is None else i).alias("i"),
        (zero if j is None else j).alias("j"),
    )


def node_writes(records: DataFrame, writer: Writer, passno: int) -> DataFrame:
    key, _ = LABELS[writer.label]
    if not writer.props:
        return _rows(records, writer, order=False).select(writer.key.alias(key))
    rows = _rows(records, writer, order=True)
    props = [value.alias(name) for name, value in writer.props.items()]
    return rows.select(
        writer.key.alias(key), *props, order_of(passno, writer.step, F.col("i"), F.col("j")).alias(ORDER)
    )


def edge_writes(records: DataFrame, writer: Writer, record_label: str) -> DataFrame:
    label, key = writer.source or (record_label, _record_key())
    return _rows(records, writer, order=False).select(
        F.lit(label).alias("src_label"),
        key.alias("src_key"),
        F.lit(writer.rel).alias("rel_type"),
        F.lit(writer.label).alias("dst_label"),
        writer.key.alias("dst_key"),
    )


# --- building blocks -------------------------------------------------------------------------


def _fields(base: Column, names: str, **renamed: str) -> dict[str, Column]:
    """Properties read from a structure; ``new=old`` renames."""
    pairs = {name: name for name in names.split()} | renamed
    return {new: base[old] for new, old in pairs.items()}


def text_list(name: str, step: int, label: str, rel: str, path: str) -> Writer:
    """Every non-empty text of a list is a node of its own."""
    return Writer(name, step, label, rel, F.col(path), _item(), keep=nonempty(_item()))


def _reference_key(prefix: str, owner: Column, item: Column) -> Column:
    return joined(F.lit(prefix), owner, or_empty(item["pubmed_id"]), text_length(item["reference_text"]))


_REFERENCE_PROPS = "reference_text pubmed_id"


def references(name: str, step: int, prefix: str) -> Writer:
    return Writer(
        name,
        step,
        "GeneralReference",
        "HAS_GENERAL_REFERENCE",
        F.col("general_references.reference"),
        _reference_key(prefix, _record_key(), _item()),
        _fields(_item(), _REFERENCE_PROPS),
    )


def inner_references(name, step, label, rel, path, prefix, owner, source, keep=None) -> Writer:
    """References listed inside each item of a list."""
    return Writer(
        name,
        step,
        label,
        rel,
        F.col(path),
        _reference_key(prefix, owner, _sub()),
        _fields(_sub(), _REFERENCE_PROPS),
        keep=keep,
        inner=_item()["references"]["reference"],
        source=source,
    )


def properties(name: str, step: int, label: str, rel: str, path: str) -> Writer:
    return Writer(
        name,
        step,
        label,
        rel,
        F.col(path),
        joined(_record_key(), or_none(_item()["kind"]), or_none(_item()["value"])),
        _fields(_item(), "kind value source"),
        keep=any_nonempty(_item()["kind"], _item()["value"]),
    )


def pathways(name: str, step: int, path: str) -> Writer:
    parts = ("smpdb_id", "kegg_map_id", "name")
    return Writer(
        name,
        step,
        "Pathway",
        "INVOLVED_IN_PATHWAY",
        F.col(path),
        joined(*[or_empty(_item()[part]) for part in parts]),
        _fields(_item(), "smpdb_id kegg_map_id", pathway_name="name"),
        keep=any_nonempty(*[_item()[part] for part in parts]),
    )


def concentrations(name: str, step: int, label: str, rel: str, path: str, kind: str, key_parts: str) -> Writer:
    _, props = LABELS[label]
    return Writer(
        name,
        step,
        label,
        rel,
        F.col(path),
        joined(_record_key(), F.lit(kind), *[or_none(_item()[part]) for part in key_parts.split()]),
        _fields(_item(), " ".join(props)),
    )


def regions(name: str, step: int, label: str, rel: str, path: str, kind: str) -> Writer:
    """Texts keyed by their 1-based place; empty ones count too."""
    return Writer(
        name,
        step,
        label,
        rel,
        F.col(path),
        joined(_record_key(), F.lit(kind), (F.col("i") + 1).cast("string")),
        {"description": _item()},
    )


def single(name: str, step: int, label: str, rel: str, column: str, suffix: str, props: dict) -> Writer:
    """One node for a container that is present, keyed by the record."""
    present = F.when(F.col(column).isNotNull(), F.array(F.col(column)))
    return Writer(name, step, label, rel, present, joined(_record_key(), F.lit(suffix)), props)


def taxonomy_items() -> Column:
    """(value, level) of every taxonomy field in writing order."""

    def pair(value: Column, level: str) -> Column:
        return F.struct(value.alias("value"), F.lit(level).alias("level"))

    def pairs(path: str, level: str) -> Column:
        none = F.array().cast("array<struct<value:string,level:string>>")
        return F.coalesce(F.transform(F.col(path), lambda value: pair(value, level)), none)

    singles = F.array(*[pair(F.col(f"taxonomy.{level}"), level) for level in TAXONOMY_SINGLE])
    lists = [pairs(f"taxonomy.{outer}.{inner}", inner) for inner, outer in TAXONOMY_LISTS.items()]
    return F.concat(singles, *lists)


def cross_reference_items() -> Column:
    """(source, value) of every cross-reference field."""
    return F.array(
        *[
            F.struct(F.lit(source).alias("source"), F.col(name).alias("value"))
            for name, source in CROSS_REFERENCES.items()
        ]
    )


# --- the statements of a metabolite record, in order -------------------------------------------

_NORMAL = "biospecimen concentration_value subject_age subject_sex subject_condition"
_ABNORMAL = "biospecimen concentration_value patient_age patient_sex"


def metabolite_writers() -> list[Writer]:
    acc, item = _record_key(), _item()
    normal = concentrations(
        "E13", 9, "NormalConcentration", "HAS_NORMAL_CONCENTRATION",
        "normal_concentrations.concentration", "normal", _NORMAL,
    )
    abnormal = concentrations(
        "E15", 10, "AbnormalConcentration", "HAS_ABNORMAL_CONCENTRATION",
        "abnormal_concentrations.concentration", "abnormal", _ABNORMAL,
    )
    return [
        text_list("E02", 1, "SecondaryAccession", "HAS_SECONDARY_ACCESSION", "secondary_accessions.accession"),
        text_list("E03", 2, "Synonym", "HAS_SYNONYM", "synonyms.synonym"),
        Writer(
            "E04", 3, "Taxonomy", "HAS_TAXONOMY", taxonomy_items(), item["value"],
            _fields(item, "level"), keep=nonempty(item["value"]),
        ),
        Writer(
            "E05", 4, "OntologyTerm", "HAS_ONTOLOGY_TERM", F.col("ontology_terms"), item["term"],
            _fields(item, "definition level", term_type="type"),
        ),
        properties("E06", 5, "ExperimentalProperty", "HAS_EXPERIMENTAL_PROPERTY", "experimental_properties.property"),
        properties("E07", 6, "PredictedProperty", "HAS_PREDICTED_PROPERTY", "predicted_properties.property"),
        Writer(
            "E08", 7, "Spectrum", "HAS_SPECTRUM", F.col("spectra.spectrum"),
            joined(acc, or_none(item["type"]), or_none(item["spectrum_id"])),
            _fields(item, "spectrum_id", spectrum_type="type"),
            keep=any_nonempty(item["type"], item["spectrum_id"]),
        ),
        text_list(
            "E09", 8, "CellularLocation", "DETECTED_IN_CELLULAR_LOCATION",
            "biological_properties.cellular_locations.cellular",
        ),
        text_list("E10", 8, "Biofluid", "DETECTED_IN_BIOFLUID", "biological_properties.biospecimen_locations.biospecimen"),
        text_list("E11", 8, "Tissue", "DETECTED_IN_TISSUE", "biological_properties.tissue_locations.tissue"),
        pathways("E12", 8, "biological_properties.pathways.pathway"),
        normal,
        inner_references(
            "E14", 9, "ConcentrationReference", "HAS_CONCENTRATION_REF", "normal_concentrations.concentration",
            "normalRef", acc, ("NormalConcentration", normal.key),
        ),
        abnormal,
        inner_references(
            "E16", 10, "ConcentrationReference", "HAS_CONCENTRATION_REF", "abnormal_concentrations.concentration",
            "abRef", acc, ("AbnormalConcentration", abnormal.key),
        ),
        Writer(
            "E17", 11, "Disease", "ASSOCIATED_WITH_DISEASE", F.col("diseases.disease"), item["name"],
            _fields(item, "omim_id"), keep=nonempty(item["name"]),
        ),
        inner_references(
            "E18", 11, "DiseaseReference", "HAS_DISEASE_REFERENCE", "diseases.disease",
            "diseaseRef", item["name"], ("Disease", item["name"]),
            keep=nonempty(item["name"]),
        ),
        Writer(
            "E19", 12, "Protein", "HAS_PROTEIN_ASSOCIATION", F.col("protein_associations.protein"),
            item["protein_accession"],
            _fields(item, "uniprot_id gene_name protein_type", protein_name="name"),
            keep=nonempty(item["protein_accession"]),
        ),
        references("E20", 13, "genRef"),
        Writer(
            "E21", 14, "CrossReference", "HAS_CROSS_REFERENCE", cross_reference_items(),
            joined(acc, item["source"], item["value"]),
            _fields(item, "source", identifier="value"), keep=nonempty(item["value"]),
        ),
        Writer(
            "E22", 15, "SynthesisReference", "HAS_SYNTHESIS_REFERENCE",
            F.when(nonempty(F.col("synthesis_reference")), F.array("synthesis_reference")),
            joined(acc, F.lit("synthesis")), {"reference_text": item},
        ),
    ]


def child_terms() -> Writer:
    """Term to term edges of the ontology: the same items, other end points."""
    item = _item()
    return Writer(
        "E05c", 4, "OntologyTerm", "HAS_CHILD_TERM", F.col("ontology_terms"), item["term"],
        keep=item["parent"].isNotNull(), source=("OntologyTerm", item["parent"]),
    )


# --- the statements of a protein record, in order ------------------------------------------------


def protein_writers() -> list[Writer]:
    acc, item = _record_key(), _item()
    return [
        text_list("E24", 1, "SecondaryAccession", "HAS_SECONDARY_ACCESSION", "secondary_accessions.accession"),
        Writer(
            "E25", 2, "MetaboliteAssociation", "ASSOCIATED_WITH_METABOLITE",
            F.col("metabolite_associations.metabolite"), item["accession"],
            _fields(item, "name"), keep=nonempty(item["accession"]),
        ),
        single(
            "E26", 3, "GeneProperty", "HAS_GENE_PROPERTY", "gene_properties", "geneProp",
            _fields(item, "locus chromosome_location gene_sequence"),
        ),
        references("E27", 4, "genProtRef"),
        text_list("E28", 5, "Synonym", "HAS_SYNONYM", "synonyms.synonym"),
        pathways("E29", 6, "pathways.pathway"),
        single(
            "E30", 7, "ProteinProperty", "HAS_PROTEIN_PROPERTY", "protein_properties", "prop",
            _fields(item, "molecular_weight polypeptide_sequence theoretical_pi residue_number"),
        ),
        Writer(
            "E31", 7, "Pfam", "HAS_PFAM", F.col("protein_properties.pfams.pfam"), item["pfam_id"],
            _fields(item, "name"), keep=nonempty(item["pfam_id"]),
        ),
        regions(
            "E32", 7, "TransmembraneRegion", "HAS_TRANSMEMBRANE_REGION",
            "protein_properties.transmembrane_regions.region", "tm",
        ),
        regions("E33", 7, "SignalRegion", "HAS_SIGNAL_REGION", "protein_properties.signal_regions.region", "sig"),
        Writer(
            "E34", 8, "MetaboliteReference", "HAS_METABOLITE_REFERENCE",
            F.col("metabolite_references.metabolite_reference"),
            joined(acc, or_none(item["metabolite"]["accession"]), or_empty(item["reference"]["pubmed_id"])),
            {
                "metabolite_accession": item["metabolite"]["accession"],
                "metabolite_name": item["metabolite"]["name"],
                "pubmed_id": item["reference"]["pubmed_id"],
                "reference_text": item["reference"]["reference_text"],
            },
            keep=item["metabolite"].isNotNull() & item["reference"].isNotNull(),
        ),
        Writer(
            "E35", 9, "GOClass", "HAS_GO_CLASSIFICATION", F.col("go_classifications.go_class"),
            item["go_id"], _fields(item, "category description"), keep=nonempty(item["go_id"]),
        ),
        text_list(
            "E36", 10, "SubcellularLocation", "LOCATED_IN_SUBCELLULAR_LOCATION",
            "subcellular_locations.subcellular_location",
        ),
        text_list("E37", 11, "PdbID", "HAS_PDB_ID", "pdb_ids.pdb_id"),
    ]


# --- the record nodes themselves -----------------------------------------------------------------

_RENAMED = {"monoisotopic_molecular_weight": "monisotopic_molecular_weight"}


def record_writes(records: DataFrame, label: str, passno: int) -> DataFrame:
    """The node of the record: its scalar children under their property names."""
    key, props = LABELS[label]
    own = [name for name in props if _RENAMED.get(name, name) in records.columns]
    return records.select(
        _record_key().alias(key),
        *[F.col(_RENAMED.get(name, name)).alias(name) for name in own],
        order_of(passno, 0).alias(ORDER),
    )


def taxonomy_description_writes(records: DataFrame, passno: int) -> DataFrame:
    """A second writer of the metabolite node, mentioning one property.

    The record's own node is always written before, so updating matches and merging agree.
    """
    rows = records.filter(nonempty(F.col("taxonomy.description")))
    return rows.select(
        "accession",
        F.col("taxonomy.description").alias("taxonomy_description"),
        order_of(passno, 3).alias(ORDER),
    )


def writes_by_label(records: DataFrame, label: str, writers: list[Writer], passno: int) -> dict[str, list[DataFrame]]:
    """All node writes of a table of records, grouped by the label they go to."""
    found: dict[str, list[DataFrame]] = {label: [record_writes(records, label, passno)]}
    if label == "Metabolite":
        found[label].append(taxonomy_description_writes(records, passno))
    for writer in writers:
        found.setdefault(writer.label, []).append(node_writes(records, writer, passno))
    return found


def all_edges(records: DataFrame, label: str, writers: list[Writer]) -> list[DataFrame]:
    edges = [edge_writes(records, writer, label) for writer in writers]
    if label == "Metabolite":
        edges.append(edge_writes(records, child_terms(), label))
    return edges
