"""Streams over a driver table, run until all of it is read; their output as a table has SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ROCKSDB, staging_path
from ..streaming.chunks import fold_stream
from ..streaming.sections import section_pieces, section_texts
from .registry import query, table
from .table_queries import _RUNS_SQL, _SECTION_SQL, _TAGGED_SQL

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _replayed(spark: SparkSession, folder: str, name: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming job writes once it has read the whole table."""
    schema, target = table(spark, folder, name).schema, staging_path(spark, f"replay-{name}")
    # as a pattern, the name may be that of a file or of a folder
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/{name}.par*")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        writer = job(source).writeStream.format("parquet").option("checkpointLocation", f"{target}/checkpoint")
        writer.trigger(availableNow=True).start(f"{target}/out").awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.parquet(f"{target}/out")


@query(
    "section_stream_replay",
    _RUNS_SQL.format(spoken=f"SELECT conv_id, turn, role, {_SECTION_SQL} AS kind, text AS said FROM conversations", key="conv_id", order="turn").replace(
        "role, kind, count", "role, kind AS section, count"
    ),
)
def section_stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    def job(messages: DataFrame) -> DataFrame:
        placed = messages.select("conv_id", F.col("turn").cast("bigint").alias("seq"), "role", F.expr(_SECTION_SQL).alias("section"), "text")
        return section_pieces(placed)

    return section_texts(_replayed(spark, folder, "conversations", job))


@query(
    "chunk_stream_replay",
    f"""WITH e AS (
       SELECT conv_id, turn, 0 AS k, 'Thinking' AS section, regexp_replace(substr(text, 1, 25), '^\\s+|\\s+$', '', 'g') AS said, false AS kept
         FROM conversations WHERE role = 'assistant'
       UNION ALL SELECT conv_id, turn, 1, role, CASE WHEN role = 'assistant' THEN concat('ab', substr(text, 26)) ELSE text END, true FROM conversations)
     SELECT CAST(conv_id AS STRING) AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS n, section, said AS text, kept
     FROM e WHERE said <> ''""",
)
def chunk_stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as chunks; every answer has a think block of its first characters and a blank one."""

    def job(messages: DataFrame) -> DataFrame:
        text = F.expr(_TAGGED_SQL.replace("chr(10)", "'\\n'"))
        return fold_stream(
            messages.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").cast("bigint").alias("seq"), F.col("role").alias("section"), text.alias("text"))
        )

    return _replayed(spark, folder, "conversations", job)
