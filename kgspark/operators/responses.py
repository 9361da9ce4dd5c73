"""Structured responses: strict parsing with a quarantine, and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = "entities array<struct<name string, type string, confidence double>>"
PLAN = (
    f"{ENTITIES}, query_intent string, should_query boolean, reasoning string,"
    " nodes_and_relationships map<string, array<string>>"
)
SUFFICIENCY = (
    f"{ENTITIES}, query_intent string, should_retry_query boolean, reasoning string,"
    " nodes_and_relationships map<string, array<string>>"
)


def parsed(rows: DataFrame, text: str, fields: str, complete=None) -> DataFrame:
    """Rows with ``parsed`` (null where the text is rejected) and ``rejected`` (why).

    Text that is no JSON of these fields is malformed; a missing field is incomplete; extra
    fields are ignored. ``complete`` may state further conditions on the parsed value.
    """
    schema = f"{fields}, _bad string"
    value = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    held = rows.withColumn("_value", value)
    names = [field.name for field in held.schema["_value"].dataType.fields if field.name != "_bad"]
    missing = [F.col("_value")[name].isNull() for name in names]
    incomplete = missing[0]
    for condition in missing[1:]:
        incomplete = incomplete | condition
    if complete is not None:
        incomplete = incomplete | ~complete(F.col("_value"))
    malformed = F.col("_value").isNull() | F.col("_value._bad").isNotNull()
    why = F.when(malformed, "malformed").when(incomplete, "incomplete")
    good = F.struct(*[F.col("_value")[name].alias(name) for name in names])
    return (
        held.withColumn("rejected", why)
        .withColumn("parsed", F.when(F.col("rejected").isNull(), good))
        .drop("_value")
    )


def complete_entities(value: Column) -> Column:
    """Every entity has a name, a type and a confidence."""
    return F.forall(
        value["entities"],
        lambda e: e["name"].isNotNull() & e["type"].isNotNull() & e["confidence"].isNotNull(),
    )


def parsed_entities(rows: DataFrame, text: str) -> DataFrame:
    return parsed(rows, text, ENTITIES, complete_entities)


def parsed_plans(rows: DataFrame, text: str) -> DataFrame:
    return parsed(rows, text, PLAN, complete_entities)


def parsed_sufficiency(rows: DataFrame, text: str) -> DataFrame:
    return parsed(rows, text, SUFFICIENCY, complete_entities)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("rejected").isNull())


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("rejected").isNotNull()).drop("parsed")


def mentions(rows: DataFrame, question_id: str = "question_id") -> DataFrame:
    """Entities of accepted responses: (question_id, pos, name, type, confidence).

    A rejected response has no entities.
    """
    listed = accepted(rows).select(question_id, F.posexplode("parsed.entities").alias("pos", "entity"))
    return listed.select(question_id, "pos", "entity.*")


def of_type(entities: DataFrame, kind: str = "Metabolite") -> DataFrame:
    return entities.filter(F.col("type") == kind)
