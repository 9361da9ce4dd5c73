"""Record shapes, graph labels and other fixed values of the data model.

A *shape* describes the children of an XML element:

* ``TEXT``      one text child (the first one counts),
* ``[TEXT]``    every child of that name, as text,
* ``{...}``     one container child (the first one counts),
* ``[{...}]``   every child of that name, as a structure.
"""

from __future__ import annotations

from pyspark.sql import types as T

TEXT = "text"


def texts(names: str) -> dict:
    return {name: TEXT for name in names.split()}


# --- fixed values: the two record types ------------------------------------------------

_REFERENCE = texts("reference_text pubmed_id")
_REFERENCES = {"reference": [_REFERENCE]}
_PATHWAYS = {"pathway": [texts("name smpdb_id kegg_map_id")]}
_PROPERTIES = {"property": [texts("kind value source")]}

# field of a metabolite record -> name of the database it refers to
CROSS_REFERENCES = {
    "foodb_id": "FoodB",
    "kegg_id": "KEGG",
    "chemspider_id": "ChemSpider",
    "chebi_id": "ChEBI",
    "pubchem_compound_id": "PubChem",
    "pdb_id": "PDB",
    "biocyc_id": "BioCyc",
    "drugbank_id": "DrugBank",
    "phenol_explorer_compound_id": "PhenolExplorer",
    "wikipedia_id": "Wikipedia",
    "knapsack_id": "Knapsack",
    "bigg_id": "BiGG",
    "metlin_id": "Metlin",
    "vmh_id": "VMH",
}

# taxonomy fields in the order they are written: single values, then lists
TAXONOMY_SINGLE = ["direct_parent", "kingdom", "super_class", "class", "sub_class", "molecular_framework"]
TAXONOMY_LISTS = {
    "alternative_parent": "alternative_parents",
    "substituent": "substituents",
    "external_descriptor": "external_descriptors",
}

METABOLITE = {
    **texts(
        "accession version creation_date update_date status name description chemical_formula"
        " average_molecular_weight monisotopic_molecular_weight iupac_name traditional_iupac"
        " cas_registry_number smiles inchi inchikey state synthesis_reference"
    ),
    **texts(" ".join(CROSS_REFERENCES)),
    "secondary_accessions": {"accession": [TEXT]},
    "synonyms": {"synonym": [TEXT]},
    "taxonomy": {
        "description": TEXT,
        **texts(" ".join(TAXONOMY_SINGLE)),
        **{outer: {inner: [TEXT]} for inner, outer in TAXONOMY_LISTS.items()},
    },
    "experimental_properties": _PROPERTIES,
    "predicted_properties": _PROPERTIES,
    "spectra": {"spectrum": [texts("type spectrum_id")]},
    "biological_properties": {
        "cellular_locations": {"cellular": [TEXT]},
        "biospecimen_locations": {"biospecimen": [TEXT]},
        "tissue_locations": {"tissue": [TEXT]},
        "pathways": _PATHWAYS,
    },
    "normal_concentrations": {
        "concentration": [
            {
                **texts(
                    "biospecimen concentration_value concentration_units"
                    " subject_age subject_sex subject_condition comment"
                ),
                "references": _REFERENCES,
            }
        ]
    },
    "abnormal_concentrations": {
        "concentration": [
            {
                **texts(
                    "biospecimen concentration_value concentration_units"
                    " patient_age patient_sex patient_information comment"
                ),
                "references": _REFERENCES,
            }
        ]
    },
    "diseases": {"disease": [{**texts("name omim_id"), "references": _REFERENCES}]},
    "protein_associations": {
        "protein": [texts("protein_accession name uniprot_id gene_name protein_type")]
    },
    "general_references": _REFERENCES,
}

PROTEIN = {
    **texts(
        "accession specific_function uniprot_name creation_date update_date uniprot_id protein_type"
        " genbank_protein_id general_function geneatlas_id name version genecard_id hgnc_id"
        " genbank_gene_id gene_name"
    ),
    "secondary_accessions": {"accession": [TEXT]},
    "metabolite_associations": {"metabolite": [texts("accession name")]},
    "gene_properties": texts("locus chromosome_location gene_sequence"),
    "general_references": _REFERENCES,
    "synonyms": {"synonym": [TEXT]},
    "pathways": _PATHWAYS,
    "protein_properties": {
        **texts("molecular_weight polypeptide_sequence theoretical_pi residue_number"),
        "pfams": {"pfam": [texts("name pfam_id")]},
        "transmembrane_regions": {"region": [TEXT]},
        "signal_regions": {"region": [TEXT]},
    },
    "metabolite_references": {
        "metabolite_reference": [{"metabolite": texts("accession name"), "reference": _REFERENCE}]
    },
    "go_classifications": {"go_class": [texts("category go_id description")]},
    "subcellular_locations": {"subcellular_location": [TEXT]},
    "pdb_ids": {"pdb_id": [TEXT]},
}

# --- fixed values: node labels, their key and their other properties --------------------

LABELS: dict[str, tuple[str, list[str]]] = {
    label: (fields.split()[0], fields.split()[1:])
    for label, fields in {
        "Metabolite": "accession version creation_date update_date status name description"
        " chemical_formula average_molecular_weight monoisotopic_molecular_weight iupac_name"
        " traditional_iupac cas_registry_number smiles inchi inchikey state taxonomy_description",
        "SecondaryAccession": "secAccValue",
        "Synonym": "synonymText",
        "Taxonomy": "taxonomyName level",
        "OntologyTerm": "termName definition level term_type",
        "ExperimentalProperty": "expPropId kind value source",
        "PredictedProperty": "predPropId kind value source",
        "Spectrum": "spectrumNodeId spectrum_type spectrum_id",
        "CellularLocation": "cellName",
        "Biofluid": "biofluidName",
        "Tissue": "tissueName",
        "Pathway": "pathwayNodeId pathway_name smpdb_id kegg_map_id",
        "NormalConcentration": "concId biospecimen concentration_value concentration_units"
        " subject_age subject_sex subject_condition comment",
        "AbnormalConcentration": "abConcId biospecimen concentration_value concentration_units"
        " patient_age patient_sex patient_information comment",
        "ConcentrationReference": "refId reference_text pubmed_id",
        "Disease": "diseaseName omim_id",
        "DiseaseReference": "diseaseRefId reference_text pubmed_id",
        "Protein": "proteinAcc protein_name uniprot_id gene_name protein_type specific_function"
        " uniprot_name creation_date update_date genbank_protein_id general_function geneatlas_id"
        " name version genecard_id hgnc_id genbank_gene_id",
        "GeneralReference": "generalRefId reference_text pubmed_id",
        "CrossReference": "crossRefId source identifier",
        "SynthesisReference": "synthesisRefId reference_text",
        "MetaboliteAssociation": "accession name",
        "GeneProperty": "genePropertyId locus chromosome_location gene_sequence",
        "ProteinProperty": "propertyId molecular_weight polypeptide_sequence theoretical_pi residue_number",
        "Pfam": "pfamId name",
        "TransmembraneRegion": "regionId description",
        "SignalRegion": "regionId description",
        "MetaboliteReference": "metaboliteRefId metabolite_accession metabolite_name pubmed_id reference_text",
        "GOClass": "goId category description",
        "SubcellularLocation": "locationName",
        "PdbID": "pdbId",
    }.items()
}

# --- derived types -------------------------------------------------------------------------

EDGE_COLUMNS = ["src_label", "src_key", "rel_type", "dst_label", "dst_key"]
EDGE_SCHEMA = ", ".join(f"{name} string" for name in EDGE_COLUMNS)

ONTOLOGY_TERMS = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in "parent term definition level type".split()])
)


def raw_type(shape) -> T.DataType:
    """The from_xml type of a shape: every child repeats, so that the first one can be chosen."""
    if shape == TEXT:
        return T.ArrayType(T.StringType())
    if isinstance(shape, list):
        return raw_type(shape[0])
    return T.ArrayType(raw_struct(shape))


def raw_struct(shape: dict) -> T.StructType:
    return T.StructType([T.StructField(name, raw_type(child)) for name, child in shape.items()])


def label_schema(label: str) -> str:
    key, props = LABELS[label]
    return ", ".join(f"{name} string" for name in [key, *props])
