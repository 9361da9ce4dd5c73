"""From raw documents to packed sequences, in stages that each read what the one before has written.

1. language ID: documents whose language the model rejects go;
2. n-gram Jaccard join: of every group of linked documents the one with the smallest id stays;
3. secret scans: findings are replaced by a mark, the documents stay;
4. mixing: each source's words are taken as its target says, a document up to three times and also in parts;
5. packing: every document that is left becomes pieces of binary length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import language_id, mixing, packing, queries, secret_scan, set_join
from kgspark.llm.common import table
from kgspark.session import Staging, release_shuffles


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the model, trained on the documents' own language names, recognizes."""
    return language_id.recognized(docs, language_id.fit(docs))


#: sets of five-word shingles with a Jaccard of 0.8 or more are near duplicates
NEAR = set_join.Rule(80, 100, 5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every component of near duplicates."""
    return set_join.one_of_each(docs, NEAR)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", queries.n_chars()).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, once for every pass over its source."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces, with their token ids."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("language ID", identify_languages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: A trained model, a random mix and a tokenizer are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = Staging(spark)
    for name, stage in STAGES[:-1]:
        after = Staging(spark)
        docs = after.stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        before.clear()  # a stage reads what the last one has written, and nothing older
        release_shuffles(spark)
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
