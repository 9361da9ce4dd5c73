"""The two load jobs: record files to graph tables.

Records are parsed once into a nested table; every statement then reads only its own columns
of it. Per label one aggregation merges the writes of the load.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nonempty
from ..operators.merge import distinct_edges, merge_writers, not_loaded
from ..operators.shred import (
    Writer,
    all_edges,
    metabolite_writers,
    protein_writers,
    writes_by_label,
)
from ..schemas import LABELS, METABOLITE, PROTEIN
from ..session import release_shuffles, stored
from ..sources.graph_store import MENTIONED, GraphStore, folder_names
from ..sources.xml_records import POSITION, parse_records, scan_records

# passes in the order they are written
METABOLITES, PROTEINS = 0, 1
LARGE = 10_000  # records of a load whose shuffles are deleted as it goes


def parse_file(
    spark: SparkSession,
    store: GraphStore,
    path,
    tag: str,
    shape: dict,
    ontology: bool = False,
    prefix: str | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Records of a file as a nested table, written next to the graph and read back."""
    return parsed_and_counted(spark, store, path, tag, shape, ontology, prefix, known)[0]


def counting_rejects(parsed: DataFrame) -> tuple[DataFrame, Observation]:
    """Parsed records that count, as they are written, those that did not parse."""
    seen = Observation()
    return parsed.observe(seen, F.count("_malformed").alias("rejects")), seen


def parsed_and_counted(
    spark: SparkSession,
    store: GraphStore,
    path,
    tag: str,
    shape: dict,
    ontology: bool = False,
    prefix: str | None = None,
    known: DataFrame | None = None,
) -> tuple[DataFrame, int]:
    """The table of ``parse_file``, and how many of its records did not parse.

    Records whose accession is among ``known`` (one column, of that name) are left out before
    the table is written, so that this join runs once and not in every statement. Text that is
    no XML is kept in ``_malformed``.
    """
    parsed = parse_records(scan_records(spark, path, tag, prefix), shape, ontology)
    if known is not None:
        parsed = not_loaded(parsed, known, "accession")
    counted, seen = counting_rejects(parsed)
    return stored(counted, tag, f"{store.root}/records/{tag}-{uuid.uuid4().hex[:12]}"), seen.get["rejects"]


def with_key(records: DataFrame) -> DataFrame:
    return records.filter(nonempty(F.col("accession")))


def malformed(records: DataFrame) -> DataFrame:
    return records.filter(F.col("_malformed").isNotNull()).select(*POSITION, "_malformed")


def quarantine(store: GraphStore, records: DataFrame, tag: str, n: int, name: str | None = None) -> int:
    """Keep the ``n`` records that did not parse as a table below ``<root>/malformed`` and say so.

    The graph is loaded from the others. Without any nothing is read. A batch that may run twice gives
    the table a ``name`` and replaces it.
    """
    if n:
        folder = f"{store.root}/malformed/{tag}-{name or uuid.uuid4().hex[:12]}"
        malformed(records).write.mode("overwrite").parquet(folder)
        print(f"{n} {tag} records do not parse; they are kept in {folder}")
    return n


def quarantined(store: GraphStore, tag: str) -> DataFrame:
    """All records of a tag that did not parse: position and text."""
    folders = [f"{store.root}/malformed/{name}" for name in folder_names(store, "malformed") if name.startswith(f"{tag}-")]
    schema = "_file string, _block bigint, _row bigint, _malformed string"
    return store.spark.read.schema(schema).parquet(*folders) if folders else store.spark.createDataFrame([], schema)


def load_records(store: GraphStore, records: DataFrame, label: str, writers: list[Writer], passno: int) -> int:
    """Add the writes of a table of records to the graph; returns the number of the load.

    Nothing that is stored is read or written again: reads merge the loads.
    Edges need no endpoint check here: every statement writes both ends before the edge.
    """
    load = store.begin()
    writes = writes_by_label(records, label, writers, passno)

    def write(name: str | None) -> None:
        if name is None:
            store.write_edges(distinct_edges(all_edges(records, label, writers)), load)
            return
        key, props = LABELS[name]
        store.write_nodes(name, merge_writers(writes[name], key, mentioned=MENTIONED, all_names=props), load)

    large = records.count() >= LARGE
    spark = records.sparkSession
    # the tables do not depend on each other: small ones fill the cores large ones leave free. Of a large load the
    # edges, whose shuffles are as large as those of all nodes, are written before them
    for names in ([None], [*writes]) if large else ([None, *writes],):
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(inheritable_thread_target(spark)(write), names))
        if large:
            release_shuffles(spark)
    store.publish(load)
    return load.number


def load_metabolites(spark: SparkSession, store: GraphStore, path, prefix: str | None = None) -> int:
    store.expect(path)
    records, rejects = parsed_and_counted(spark, store, path, "metabolite", METABOLITE, ontology=True, prefix=prefix)
    quarantine(store, records, "metabolite", rejects)
    return load_records(store, with_key(records), "Metabolite", metabolite_writers(), METABOLITES)


def load_proteins(
    spark: SparkSession, store: GraphStore, path, skip_existing: bool = True, prefix: str | None = None
) -> int:
    """Load protein records; by default those whose node exists before the load are skipped."""
    store.expect(path)
    known = store.nodes("Protein").select(F.col("proteinAcc").alias("accession")) if skip_existing else None
    records, rejects = parsed_and_counted(spark, store, path, "protein", PROTEIN, prefix=prefix, known=known)
    quarantine(store, records, "protein", rejects)
    return load_records(store, with_key(records), "Protein", protein_writers(), PROTEINS)
