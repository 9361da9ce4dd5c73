"""Records merged into the graph as their files arrive.

Each micro-batch parses its records and writes them to a folder of its own, those that do not
parse to another; every so many batches the records gathered since are merged into the graph. A batch that runs twice writes
the same folder and merges the same writes, which changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import not_loaded
from ..operators.shred import metabolite_writers, protein_writers
from ..plans.ingest import METABOLITES, PROTEINS, counting_rejects, load_records, quarantine, with_key
from ..schemas import METABOLITE, PROTEIN
from ..session import stored
from ..sources.graph_store import GraphStore, folder_names
from ..sources.xml_records import parse_records, stream_records


def _folder(store: GraphStore, tag: str, batch: int) -> str:
    return f"{store.root}/arrived/{tag}/{batch:010d}"


def merge_arrived(store: GraphStore, tag: str, first: int, last: int, skip_existing: bool = True) -> None:
    """Merge the records of batches ``first`` to ``last`` into the graph."""
    folders = [_folder(store, tag, batch) for batch in range(first, last + 1)]
    records = with_key(store.spark.read.parquet(*folders))
    if tag == "metabolite":
        load_records(store, records, "Metabolite", metabolite_writers(), METABOLITES)
        return
    if skip_existing:
        fresh = not_loaded(records, store.nodes("Protein"), "accession", "proteinAcc")
        records = stored(fresh, "fresh-proteins")
    load_records(store, records, "Protein", protein_writers(), PROTEINS)


def ingest_stream(
    spark: SparkSession,
    store: GraphStore,
    folder: str,
    checkpoint: str,
    tag: str = "metabolite",
    merge_every: int = 1,
    files_per_batch: int = 64,
    available_now: bool = True,
) -> StreamingQuery:
    """Follow a folder of record files; every ``merge_every`` batches the graph takes them in.

    With ``available_now`` the call returns when all files are read and merged, the batches after
    the last full group included. A query that goes on keeps those for the next group; after
    it is stopped, ``merge_rest`` takes them in.
    """
    shape = METABOLITE if tag == "metabolite" else PROTEIN

    def on_batch(batch: DataFrame, number: int) -> None:
        # records of later batches come later in the order of writes
        arrival = F.concat(F.lit(f"{number:010d}/"), F.col("_file"))
        placed = batch.select(arrival.alias("_file"), "_block", F.monotonically_increasing_id().alias("_row"), "record")
        parsed, seen = counting_rejects(parse_records(placed, shape, ontology=tag == "metabolite"))
        parsed.write.mode("overwrite").parquet(_folder(store, tag, number))
        written = spark.read.schema(parsed.schema).parquet(_folder(store, tag, number))
        quarantine(store, written, tag, seen.get["rejects"], f"batch-{number:010d}")
        if (number + 1) % merge_every == 0:
            merge_arrived(store, tag, number + 1 - merge_every, number)

    writer = stream_records(spark, folder, tag, files_per_batch=files_per_batch).writeStream.foreachBatch(on_batch)
    writer = writer.option("checkpointLocation", checkpoint)
    if not available_now:
        return writer.start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    merge_rest(store, tag, merge_every)
    return query


def merge_rest(store: GraphStore, tag: str = "metabolite", merge_every: int = 1) -> None:
    """Merge the batches after the last full group. Merging them again with the next group changes nothing."""
    arrived = [int(name) for name in folder_names(store, f"arrived/{tag}")]
    first = (max(arrived, default=-1) + 1) // merge_every * merge_every
    if arrived and first <= max(arrived):
        merge_arrived(store, tag, first, max(arrived))
