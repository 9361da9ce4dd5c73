"""Which tags occur inside which, per XML file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.xml_python import tag_pairs
from ..sources.xml_records import read_pieces


def xml_structure(spark: SparkSession, path, tag: str, glob: str | None = "*.xml") -> DataFrame:
    """Distinct (file_path, parent, child) tags of files made of ``<tag>`` records.

    Files are cut at the end of records, so what stands between records hangs under the
    element the first piece of the file leaves open.
    """
    pieces = read_pieces(spark, path, tag, glob=glob)
    whole = F.when(F.contains("piece", F.lit("<")), F.concat("piece", F.lit(f"</{tag}>")))
    # the last piece of a file has no record; its extra end tag closes nothing
    has_record = F.regexp_count("piece", F.lit(rf"<(?:[\w.-]+:)?{tag}(?=[\s>])")) > 0
    text = F.when(has_record, whole).otherwise(F.col("piece"))
    found = pieces.select(F.col("_file").alias("file_path"), tag_pairs(text).alias("t"))
    rows = found.select("file_path", F.col("t.container").alias("container"), F.explode_outer("t.pairs").alias("pair"))
    # a file has few distinct pairs, and every task hands on no more than those
    files = rows.groupBy("file_path").agg(F.collect_set("pair").alias("pairs"), F.max("container").alias("container"))
    pairs = files.select("file_path", "container", F.explode("pairs").alias("p"))
    parent = F.coalesce("p.parent", "container")
    return pairs.select("file_path", parent.alias("parent"), "p.child").filter("parent IS NOT NULL").distinct()


def structure_report(pairs: DataFrame) -> DataFrame:
    """One row per file and parent with its sorted children."""
    return pairs.groupBy("file_path", "parent").agg(F.array_sort(F.collect_set("child")).alias("children"))
