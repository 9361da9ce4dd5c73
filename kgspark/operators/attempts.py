"""Analysis of query attempt logs: (question_id, attempt, error, n_results, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import last_rows, running_sum

# Retries after the first try, and attempts shown to the next one.
MAX_RETRIES = 5
SUFFICIENCY_RETRIES = 3
SHOWN = 3


def numbered(log: DataFrame, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """Number the attempts of each question from 1."""
    return running_sum(log, keys, order, block, F.lit(1), "attempt")


def newest_attempts(log: DataFrame, n: int = SHOWN) -> DataFrame:
    return last_rows(log, ["question_id"], ["attempt"], n)


def outcomes(log: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """One row per question: attempts, errors, first success and how it ended.

    success: the last attempt gave rows; empty: it gave none; exhausted: it failed and no
    retry was left; failed: it failed earlier than that.
    """
    ok = F.col("error").isNull()
    ended = F.max_by(F.struct("error", "n_results"), "attempt")
    summary = log.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if(~ok).alias("n_errors"),
        F.min(F.when(ok, F.col("attempt"))).alias("first_success"),
        ended.alias("_end"),
    )
    status = (
        F.when(F.col("_end.error").isNull() & (F.coalesce("_end.n_results", F.lit(0)) > 0), "success")
        .when(F.col("_end.error").isNull(), "empty")
        .when(F.col("n_errors") > max_retries, "exhausted")
        .otherwise("failed")
    )
    return summary.withColumn("status", status).drop("_end")


def _until(log: DataFrame, done: Column, retries: int, names: tuple[str, str]) -> DataFrame:
    """Per question the retries a loop took that ends with the first attempt where ``done`` holds.

    A loop gives up after ``retries`` of them; what a log holds beyond its end is not counted.
    """
    summary = log.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(F.coalesce(done, F.lit(False)), F.col("attempt"))).alias("_done")
    )
    ended = F.when(F.col("_done") <= retries + 1, names[0]).when(F.col("_n") > retries, names[1]).otherwise("open")
    taken = F.least(F.coalesce(F.col("_done"), F.col("_n")) - 1, F.lit(retries))
    return summary.select("question_id", taken.cast("bigint").alias("retries"), ended.alias("status"))


def empty_outcomes(log: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Queries run again because they gave no rows: found, none (no retry left) or open."""
    return _until(log, F.col("n_results") > 0, max_retries, ("found", "none"))


def sufficiency_outcomes(log: DataFrame, max_retries: int = SUFFICIENCY_RETRIES) -> DataFrame:
    """Results judged until they suffice (``should_retry`` is false): sufficient, insufficient or open."""
    return _until(log, ~F.col("should_retry"), max_retries, ("sufficient", "insufficient"))
