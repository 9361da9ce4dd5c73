"""Load job for spark-submit: reset, load, check keys, print the seconds each step took.

    spark-submit run_ingest.py --graph <folder> --metabolites <files> [--proteins <files>] [--reset]
"""

from __future__ import annotations

import argparse
import time
from contextlib import contextmanager

from kgspark.operators.catalog import key_violations
from kgspark.plans.ingest import load_metabolites, load_proteins
from kgspark.schemas import LABELS
from kgspark.session import build_session
from kgspark.sources.graph_store import GraphStore


@contextmanager
def timed(step: str):
    start = time.perf_counter()
    yield
    print(f"{step}: {time.perf_counter() - start:.2f} seconds", flush=True)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--graph", required=True)
    parser.add_argument("--metabolites")
    parser.add_argument("--proteins")
    parser.add_argument("--reset", action="store_true")
    parser.add_argument("--merge-known-proteins", action="store_true")
    chosen = parser.parse_args(arguments)
    spark = build_session("kgspark-ingest")
    store = GraphStore(spark, chosen.graph)
    with timed("total"):
        if chosen.reset:
            with timed("reset"):
                store.reset()
        if chosen.metabolites:
            with timed("metabolites"):
                load_metabolites(spark, store, chosen.metabolites)
        if chosen.proteins:
            with timed("proteins"):
                load_proteins(spark, store, chosen.proteins, skip_existing=not chosen.merge_known_proteins)
        with timed("key check"):
            broken = key_violations({label: (store.nodes(label), LABELS[label][0]) for label in LABELS})
            for row in broken.groupBy("label", "key_name").count().collect():
                print(f"warning: {row['count']} repeated keys {row.key_name} of {row.label}")


if __name__ == "__main__":
    main()
