"""The queries that apply the operators to whole tables, and SQL where SQL can state their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, language_id, language_model, mixing, neighbours, packing, quality, quality_rules, resampling, resharding, secret_scan, set_join, suffix_dedup
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORD_VOCABULARY = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def vocabulary(name: str = WORD_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def n_chars():
    """The length of the text in characters; none for a null text, as for an empty one."""
    return F.coalesce(F.length("text"), F.lit(0)).cast("long")


@query("op1_min_cost_flow_reshard")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """From the files in which documents lie to 24 shards of near-equal bytes."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.col("_metadata.file_name").alias("file"))
    plan = resharding.reshard(resharding.shard_rows(docs, "file"), shards=24)
    return plan.rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op3_power_of_two_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def _secrets_sql() -> str:
    def spans(i: int, rule: secret_scan.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        lengths = lambda x: f"[length(x) for x in {x}]"
        return f"""
        SELECT doc_id, row_no, {i} AS no, '{rule.kind}' AS kind,
               list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS from_at, from_at + sizes[i] AS till
        FROM (SELECT doc_id, row_no, {lengths(f"regexp_extract_all(body, '{pattern}', 0)")} AS sizes,
                     {lengths(f"regexp_extract_all(body, '{pattern}', {rule.group})")} AS held,
                     {lengths(f"string_split_regex(body, '{pattern}')")} AS gaps,
                     unnest(range(1, len(sizes) + 1)) AS i FROM texts)
        WHERE held[i] >= {rule.least}"""

    return f"""
    WITH texts AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS body FROM documents),
    spans AS ({" UNION ALL ".join(spans(i, r) for i, r in enumerate(secret_scan.RULES))}),
    listed AS (SELECT row_no, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
                      string_agg(kind || ':' || from_at || ':' || till, ',' ORDER BY from_at, no) AS spans FROM spans GROUP BY row_no)
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts t LEFT JOIN listed USING (row_no)"""


@query("op2_blob_ledger_secret_scan", _secrets_sql())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rows = secret_scan.scan_paths(table(spark, folder, "documents").select("doc_id", "text")).withColumn("spans", secret_scan.digest())
    counts = [secret_scan.count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return rows.select("doc_id", *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")


@query("op4_suffix_array_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    n_removed = F.octet_length("body") - F.octet_length("kept")
    return rows.select(
        "doc_id",
        F.octet_length("body").cast("long").alias("n_bytes"),
        n_removed.cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def remainder(n: int):
    """crc32 of the id as text, modulo n; that of the empty text (0) for a null id."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(n))


@query("op5_subword_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(remainder(3) != 1))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_set_relation_jaccard_join")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return set_join.document_links(table(spark, folder, "documents"))


@query("op7_quadratic_discriminant_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    scores = quality.judge(docs, labels.where(remainder(5) != 0))
    return scores.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


@query("op8_block_mixing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    made = mixing.mix(table(spark, folder, "documents"))
    return made.taken.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op9_cross_polytope_neighbours")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return neighbours.nearest(vectors, F.col("vec_id") % 100 == 0)


@query("op10_divergence_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return quality_rules.judged(docs, quality_rules.references(docs))


@query("op11_checkpointed_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(spark, folder, "conversations")))


@query("op12_backoff_automaton_scores")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = language_model.scores(docs, remainder(7) != 2)
    return found.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op13_prefix_crc_resampling")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
