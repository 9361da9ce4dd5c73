"""Server-sent events as text files: ``data:{json}`` followed by a blank line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.ordered import drop_repeats

_GAP = r"\n[^\S\n]*(?=\n)"  # an empty line inside a piece of text


def event_text(section: Column, text: Column) -> Column:
    """One event without its closing blank line."""
    message = F.struct(section.alias("section"), text.alias("text"))
    return F.concat(F.lit("data:"), F.to_json(message, {"ignoreNullFields": "false"}))


def write_events(messages: DataFrame, path: str, section: str = "section", text: str = "text") -> None:
    events = messages.select(event_text(F.col(section), F.col(text)).alias("value"))
    events.write.option("lineSep", "\n\n").text(path)


def read_pieces(spark: SparkSession, path, newline: str = "\n") -> DataFrame:
    """Text between blank lines, with its position: (_file, _block, _row, piece)."""
    raw = spark.read.option("lineSep", newline * 2).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("piece"),
    )


def _parsed(events: DataFrame) -> DataFrame:
    value = F.try_parse_json("data")
    held = events.withColumn("_value", value)
    is_object = F.schema_of_variant("_value").startswith("OBJECT")
    field = lambda name: F.when(is_object, F.try_variant_get("_value", f"$.{name}", "string"))
    return held.select(
        *events.columns,
        F.col("_value").isNotNull().alias("is_json"),
        field("section").alias("section"),
        field("text").alias("text"),
    )


def events_of(pieces: DataFrame) -> DataFrame:
    """Events in pieces of text: (position, part, data, is_json, section, text).

    Lines are trimmed, those that start with ``data:`` count, and several of them are joined
    by a line feed. Data that is no JSON is kept as it is, with is_json false.
    """
    position = [name for name in pieces.columns if name != "piece"]
    parts = pieces.select(*position, F.posexplode(F.split("piece", _GAP)).alias("part", "event"))
    lines = F.filter(F.transform(F.split("event", r"\n"), strip), lambda line: line != "")
    found = parts.withColumn("_lines", lines).filter(F.size("_lines") > 0)
    data_lines = F.filter("_lines", lambda line: line.startswith("data:"))
    data = F.array_join(F.transform(data_lines, lambda line: strip(F.substring(line, 6, 2147483647))), "\n")
    return _parsed(found.select(*position, "part", data.alias("data")))


def read_events(spark: SparkSession, path, newline: str = "\n") -> DataFrame:
    return events_of(read_pieces(spark, path, newline))


def distinct_events_of(pieces: DataFrame) -> DataFrame:
    """The stricter reading: a piece is an event only if it starts with ``data:``.

    An event equal to the one before in its file is left out, and so is one that is no JSON.
    """
    starts = pieces.filter(F.col("piece").startswith("data:"))
    data = strip(F.substring("piece", 6, 2147483647))
    events = starts.withColumn("data", data).drop("piece")
    kept = drop_repeats(events, ["_file"], ["_row"], F.col("_block"), "data")
    return _parsed(kept).filter("is_json")
