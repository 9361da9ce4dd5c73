"""Results cut to a size budget, and result limits."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import running_sum

# Fixed value: characters of JSON a result may have.
BUDGET = 5000


def json_length(record: Column) -> Column:
    """Length of the record as compact JSON with nulls written."""
    return F.length(F.to_json(record, {"ignoreNullFields": "false"}))


def spaced_json_length(record: Column, n_fields: int) -> Column:
    """Length of flat JSON with a space after ``:`` and ``,`` and non-ASCII characters as \\uXXXX.

    For records of strings, integers and booleans; others need ``dumped_length``.
    """
    text = F.to_json(record, {"ignoreNullFields": "false"})
    beyond_ascii = F.regexp_count(text, F.lit(r"[^\x00-\x7e]"))
    beyond_bmp = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.length(text) + F.lit(2 * n_fields - 1) + 5 * beyond_ascii + 6 * beyond_bmp


@F.pandas_udf(T.LongType())
def dumped_length(text: pd.Series) -> pd.Series:
    """Length of JSON text once parsed and dumped again with Python's defaults."""
    return text.map(lambda value: len(json.dumps(json.loads(value))))


def within_budget(
    rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int = BUDGET, block: Column | None = None
) -> DataFrame:
    """The first rows of each group while their sizes add up to at most ``budget``.

    Sizes are not negative, so the running sum never falls and the first overflow ends the group.
    ``block`` cuts the order as in ``ordered.running_sum``: one small row per block tells which
    blocks begin within the budget, and only the rows of those are put in order.
    """
    sized = rows.withColumn("_size", size)
    block = F.lit(0) if block is None else block
    return running_sum(sized, keys, order, block, F.col("_size"), "_used", most=budget).filter(F.col("_used") <= budget).drop("_size", "_used")


def result_within_budget(result: DataFrame, budget: int = BUDGET) -> DataFrame:
    """A whole result, in its own order, cut to the budget as one group.

    The rows are numbered as they stand, task after task, and each task's run of numbers is cut
    into blocks.
    """
    columns = result.columns
    placed = result.withColumn("_seq", F.monotonically_increasing_id()).withColumn("_all", F.lit(1))
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    block = F.floor(F.col("_seq") / F.lit(1024))
    return within_budget(placed, ["_all"], ["_seq"], dumped_length(record), budget, block).select(*columns)


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """A limit where it is a positive int, else all rows."""
    valid = isinstance(limit, int) and not isinstance(limit, bool) and limit > 0
    return rows.limit(limit) if valid else rows


def context_pack(results: DataFrame, descriptions: DataFrame, budget: int = BUDGET, width: int = 100_000) -> DataFrame:
    """Per question its results followed by descriptions, cut to the budget.

    Both frames have (question_id, seq, record), record being JSON text and seq an integer; a
    block of the order holds ``width`` numbers.
    """
    both = results.withColumn("part", F.lit(0)).unionByName(descriptions.withColumn("part", F.lit(1)))
    block = F.struct("part", F.floor(F.col("seq") / F.lit(width)))
    return within_budget(both, ["question_id"], ["part", "seq"], F.length("record"), budget, block)
