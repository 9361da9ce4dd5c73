"""Chat logs and token chunks: turn chunks, section runs, think blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import think_blocks, without_think
from .ordered import islands, running_sum

# Chunks that carry no content, and the end marker.
FENCES = ["```", "json", "```json", "```cypher", "```cypher\n", "cy", "pher", "``"]
DONE = "DONE"
THINKING = "Thinking"
SUMMARY = "Summary"
QUERY_SECTION = "Query execution"


def turn_block(order: Column, width: int = 1_000_000) -> Column:
    """Blocks of an integer order that is unique in its group: at most ``width`` rows each."""
    return F.floor(order / F.lit(width))


def turn_chunks(messages: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Number the chunks of each conversation: every user message opens one.

    Assistant messages before any user message are chunk 0; other roles are left out.
    messages: (conv_id, turn, role, ...), turn being unique in a conversation.
    """
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    opens = F.when(F.col("role") == "user", 1).otherwise(0)
    return running_sum(spoken, ["conv_id"], ["turn"], turn_block(F.col("turn"), width), opens, "chunk")


def code_block(section: Column, text: Column) -> Column:
    language = F.when(section == QUERY_SECTION, "cypher").otherwise("json")
    return F.concat(F.lit("```"), language, F.lit("\n"), text, F.lit("\n```"))


def chunk_summaries(chunks: DataFrame) -> DataFrame:
    """Per chunk: the user text, the other sections as code blocks in order, the summary text."""
    said = F.col("role") == "assistant"
    is_summary = said & F.col("section").eqNullSafe(SUMMARY)
    text = F.coalesce("text", F.lit(""))
    item = F.struct("turn", "section", code_block(F.coalesce("section", F.lit("")), text).alias("code"))
    parts = F.struct("turn", text.alias("text"))
    grouped = chunks.groupBy("conv_id", "chunk").agg(
        F.coalesce(F.max(F.when(F.col("role") == "user", F.col("text"))), F.lit("")).alias("user_text"),
        F.array_sort(F.collect_list(F.when(said & ~is_summary, item))).alias("items"),
        F.array_sort(F.collect_list(F.when(is_summary, parts))).alias("_summary"),
    )
    summary = F.array_join(F.transform("_summary", lambda p: p["text"]), "")
    return grouped.withColumn("summary_text", summary).drop("_summary")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """The pieces of ``chunk_summaries`` as rows that are never gathered: (conv_id, chunk, kind, turn, section, text).

    ``kind`` is user, code or summary; code is shown as its block. In order of turn, the rows of a kind
    are what its list or text is made of.
    """
    is_summary = F.col("section").eqNullSafe(SUMMARY)
    kind = F.when(F.col("role") == "user", "user").when(is_summary, "summary").otherwise("code")
    text = F.coalesce("text", F.lit(""))
    shown = F.when(F.col("kind") == "code", code_block(F.coalesce("section", F.lit("")), text)).otherwise(text)
    rows = chunks.withColumn("kind", kind)
    return rows.select("conv_id", "chunk", "kind", "turn", "section", shown.alias("text"))


def section_rows(
    messages: DataFrame, keys: list[str], order: list[str], block: Column, section: str = "section", text: str = "text", role: str = "role"
) -> DataFrame:
    """The messages but end markers, numbered by ``run`` (from 1), as rows that are never gathered.

    Only messages of the assistant continue a run, and only after one of the assistant with the
    same section; every other message is a run of its own.
    """
    spoken = messages.filter(~F.col(text).eqNullSafe(DONE))
    alone = F.when(~F.col(role).eqNullSafe("assistant"), F.struct(*order))
    same = spoken.withColumn("_same", F.struct(F.col(section).alias("section"), alone.alias("alone")))
    return islands(same, keys, order, block, "_same", "run").drop("_same")


def coalesce_sections(
    messages: DataFrame, keys: list[str], order: list[str], block: Column, section: str = "section", text: str = "text", role: str = "role"
) -> DataFrame:
    """Join the texts of each run of ``section_rows``.

    One row per run: keys, ``run``, role, section, the number of messages and the text. The text of
    a run is one value of the result, so its messages do meet in one task; where runs may be
    larger than that, take the rows.
    """
    runs = section_rows(messages, keys, order, block, section, text, role)
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_text"))))
    return runs.groupBy(*keys, "run", role, section).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(parts, lambda p: p["_text"]), "").alias(text),
    )


def content_chunks(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Chunks that add to the result of a stage: no fence tokens, end marker or thinking."""
    kept = chunks.filter(~F.col(text).isin(*FENCES, DONE) & (F.col(text) != ""))
    return kept.filter(~F.col("section").eqNullSafe(THINKING))


def stage_texts(chunks: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """All chunks of a stream in order as one text.

    The text of a stream is one value of the result, so its chunks do meet in one task.
    """
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def split_thinking(texts: DataFrame, text: str = "text") -> DataFrame:
    """Text without its closed think blocks, and the blocks as a list."""
    whole = F.col(text)
    return texts.select("*", think_blocks(whole).alias("thinking")).withColumn(text, without_think(whole))
