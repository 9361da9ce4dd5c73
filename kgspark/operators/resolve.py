"""Entity mentions to the names of graph nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.graph_store import GraphStore, folder_names
from .graph import of_type, owner_of_alias
from .text_index import (
    NAME_SCORE,
    NAME_SIMILARITY,
    SYNONYM_SCORE,
    SYNONYM_SIMILARITY,
    TOP,
    TextIndex,
    best,
    build_index,
    first_above,
    load_index,
)


def match_names(mentions: DataFrame, index: TextIndex, k: int = TOP, threshold: float = NAME_SCORE) -> DataFrame:
    """(mention_id, matched) for mentions (mention_id, name) with a hit above the threshold."""
    queries = mentions.select(F.col("mention_id").alias("query_id"), F.col("name").alias("text"))
    hits = first_above(index.search(queries, "fuzzy", NAME_SIMILARITY, k), threshold)
    return hits.select(F.col("query_id").alias("mention_id"), F.col("shown").alias("matched"))


def best_fuzzy(mentions: DataFrame, index: TextIndex, k: int = TOP) -> DataFrame:
    """The best hit with the last word fuzzy by two edits, whatever its score."""
    return best(index.search(mentions, "fuzzy", None, k))


def best_exact(mentions: DataFrame, index: TextIndex, k: int = TOP) -> DataFrame:
    """The best hit on exact words, whatever its score."""
    return best(index.search(mentions, "exact", None, k))


def synonym_hits(queries: DataFrame, index: TextIndex, k: int = TOP) -> DataFrame:
    """Fuzzy hits; for queries without any, prefix hits."""
    fuzzy = stored(index.search(queries, "fuzzy", SYNONYM_SIMILARITY, k), "synonym-hits")
    rest = queries.join(fuzzy.select("query_id").distinct(), "query_id", "left_anti")
    return fuzzy.union(index.search(rest, "prefix", None, k))


def match_metabolites(
    mentions: DataFrame,
    names: TextIndex,
    synonyms: TextIndex,
    aliases: DataFrame,
    owners: DataFrame,
    k: int = TOP,
    name_threshold: float = NAME_SCORE,
    synonym_threshold: float = SYNONYM_SCORE,
) -> DataFrame:
    """By name; else by the best synonym above its threshold that some node has.

    mentions: (mention_id, name); aliases: (pk, alias); owners: (pk, name).
    Returns (mention_id, matched) for resolved mentions.
    """
    by_name = stored(match_names(mentions, names, k, name_threshold), "name-hits")
    rest = mentions.join(by_name, "mention_id", "left_anti")
    queries = rest.select(F.col("mention_id").alias("query_id"), F.col("name").alias("text"))
    hits = synonym_hits(queries, synonyms, k).filter(F.col("score") > synonym_threshold)
    hits = stored(hits.withColumn("alias_lc", F.lower("shown")), "alias-hits")
    # owners of the aliases that were hit, and of no others
    wanted = hits.select("alias_lc").distinct()
    few = aliases.join(wanted, F.lower("alias") == F.col("alias_lc"), "left_semi")
    owned = hits.join(owner_of_alias(few, owners), "alias_lc")
    by_synonym = owned.groupBy(F.col("query_id").alias("mention_id")).agg(
        F.min_by(F.struct("owner_name"), "rank")["owner_name"].alias("matched")
    )
    return by_name.union(by_synonym)


def dispatched(mentions: DataFrame, matchers: dict) -> DataFrame:
    """Send each mention to the matcher of its type: (mention_id, name, type, matched).

    A type without a matcher keeps its name; a mention its matcher cannot place gets null.
    mentions: (mention_id, name, type); a matcher takes (mention_id, name) and returns
    (mention_id, matched).
    """
    plain = mentions.select("mention_id", "name", "type")
    others = ~F.coalesce(F.col("type").isin(*matchers), F.lit(False))
    result = plain.filter(others).withColumn("matched", F.col("name"))
    for kind, matcher in matchers.items():
        own = plain.filter(F.col("type") == kind)
        result = result.union(own.join(matcher(own.select("mention_id", "name")), "mention_id", "left"))
    return result


def stored_index(store: GraphStore, name: str, entries: DataFrame) -> TextIndex:
    """The text index of a graph as it stands, built once for each of its snapshots and kept beside it."""
    part = f"indexes/{store.snapshot():012d}"
    for folder in folder_names(store, part):
        if folder.startswith(f"{name}-") and "_SUCCESS" in folder_names(store, f"{part}/{folder}/made"):
            return load_index(store.spark, f"{store.root}/{part}/{folder}")
    return build_index(entries, f"{store.root}/{part}/{name}-{uuid.uuid4().hex[:12]}")


def graph_matchers(store: GraphStore) -> dict:
    """Matchers over a loaded graph, for ``dispatched``."""
    metabolites = store.nodes("Metabolite").select(F.col("accession").alias("pk"), "name")
    aliases = of_type(store.edges(), "HAS_SYNONYM", "Metabolite").select(
        F.col("src_key").alias("pk"), F.col("dst_key").alias("alias")
    )
    fields = ("proteinAcc", "protein_name", "uniprot_id", "uniprot_name", "gene_name", "name")

    def own_text(label: str, name: str) -> DataFrame:
        column = F.col(name)
        return store.nodes(label).select(column.alias("pk"), column.alias("text"), column.alias("shown"))

    names = stored_index(store, "metabolites", metabolites.select("pk", F.col("name").alias("text"), F.col("name").alias("shown")))
    synonyms = stored_index(store, "synonyms", own_text("Synonym", "synonymText"))
    proteins = stored_index(
        store,
        "proteins",
        store.nodes("Protein").select(
            F.col("proteinAcc").alias("pk"), F.concat_ws(" ", *fields).alias("text"), F.col("protein_name").alias("shown")
        ),
    )
    diseases = stored_index(store, "diseases", own_text("Disease", "diseaseName"))
    return {
        "Metabolite": lambda m: match_metabolites(m, names, synonyms, aliases, metabolites),
        "Protein": lambda m: match_names(m, proteins),
        "Disease": lambda m: match_names(m, diseases),
    }


def resolved(store: GraphStore, mentions: DataFrame) -> DataFrame:
    """Mentions (mention_id, name, type) with the name that the graph has for each: one call over a loaded graph."""
    return dispatched(mentions, graph_matchers(store))
