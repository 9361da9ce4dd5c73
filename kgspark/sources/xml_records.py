"""Splittable source of XML records.

A file of ``<tag>...</tag>`` records is read as text with the closing tag as line separator,
so one large file becomes many tasks. Closing tags in other spellings (``</tag >``, or with a
prefix that was not named) cut the pieces again; a file that has no others is one task. Each
record then goes through ``from_xml`` once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ESCAPED_LT, element_text
from ..functions.xml_python import ontology_terms
from ..operators.ordered import running_sum
from ..schemas import ONTOLOGY_TERMS, TEXT, raw_struct
from ..session import stored

# Position of a record: file, then split of the file, then place inside the split.
# The id alone is not document order, as Spark packs splits into tasks by size.
POSITION = ["_file", "_block", "_row"]


def _pieces(reader, path, tag: str, prefix: str | None, glob: str | None):
    close = f"</{prefix}:{tag}>" if prefix else f"</{tag}>"
    reader = reader.option("lineSep", close)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path)


def _opening(tag: str) -> str:
    return rf"<(?:[\w.-]+:)?{tag}(?:\s[^>]*)?(?<!/)>"


def _closing(tag: str) -> str:
    return rf"</(?:[\w.-]+:)?{tag}\s*>"


def _cut_again(value: Column, tag: str) -> Column:
    """A piece, cut at closing tags that are not spelled like the separator."""
    return F.when(value.rlike(_closing(tag)), F.split(value, _closing(tag))).otherwise(F.array(value))


def read_pieces(spark: SparkSession, path, tag: str, prefix: str | None = None, glob: str | None = None):
    """Text between closing tags, with its position: (_file, _block, _row, piece)."""
    raw = _pieces(spark.read, path, tag, prefix, glob)
    cut = raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.explode(_cut_again(F.col("value"), tag)).alias("piece"),
    )
    return cut.select("_file", "_block", F.monotonically_increasing_id().alias("_row"), "piece")


def has_record(piece: Column, tag: str) -> Column:
    """Whether a piece ends a record. The opening tag comes early, so the search is short."""
    return piece.rlike(_opening(tag))


def record_text(piece: Column, tag: str, prefix: str | None = None) -> Column:
    """The record that ends with a piece; the empty string where there is none.

    The last opening tag counts, so the innermost of nested records of the same name is taken.
    A plain opening tag, the usual case, is found by a byte search and not by the pattern.
    """
    name = f"{prefix}:{tag}" if prefix else tag
    plain, close = F.lit(f"<{name}>"), F.lit(f"</{name}>")
    after = F.substring_index(piece, f"<{name}>", -1)
    other = [F.contains(after, F.lit(f"<{name}{space}")) for space in " \n\t\r"]
    usual = F.contains(piece, plain) & ~(other[0] | other[1] | other[2] | other[3])
    found = F.regexp_extract(piece, rf"(?s)^.*({_opening(tag)}.*)$", 1)
    spelled = F.regexp_extract(found, r"^<([\w.:-]+)", 1)
    rest = F.when(found != "", F.concat(found, F.lit("</"), spelled, F.lit(">"))).otherwise(F.lit(""))
    return F.when(usual, F.concat(plain, after, close)).otherwise(rest)


def scan_records(
    spark: SparkSession, path, tag: str, prefix: str | None = None, glob: str | None = None
) -> DataFrame:
    """One row per record: (_file, _block, _row, record)."""
    pieces = read_pieces(spark, path, tag, prefix, glob)
    piece = F.col("piece")
    return pieces.filter(has_record(piece, tag)).select(*POSITION, record_text(piece, tag, prefix).alias("record"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _closed_records(texts: pd.Series, tags: pd.Series) -> pd.Series:
    """For each closing tag of a text the record that it closes, null where nothing is open."""

    def run(text: str, tag: str) -> list[str | None]:
        found, opened = [], []
        for met in re.finditer(rf"{_opening(tag)}|{_closing(tag)}", text):
            if not met[0].startswith("</"):
                opened.append(met.start())
            else:
                found.append(text[opened.pop() : met.end()] if opened else None)
        return found

    return pd.Series([run(text, tag) for text, tag in zip(texts, tags)])


def scan_nested_records(spark: SparkSession, path, tag: str, prefix: str | None = None, glob: str | None = None) -> DataFrame:
    """``scan_records`` for records of one name inside each other: inner and outer ones, each where it ends.

    A piece opens some records and closes one, so a running count over the file says where no
    record is open. Pieces between two such places are one outermost record; only those of
    more than one piece are gathered, and a record is one value anyway.
    """
    pieces = read_pieces(spark, path, tag, prefix, glob)
    balance = F.regexp_count("piece", F.lit(_opening(tag))) - 1
    counted = stored(pieces.select(*POSITION, balance.alias("_balance")), "xml-balance")
    deep = running_sum(counted, ["_file"], ["_block", "_row"], F.col("_block"), F.col("_balance"), "_depth")
    done = F.when(F.col("_depth") <= 0, 1).otherwise(0)
    deep = stored(deep.withColumn("_done", done), "xml-depth")
    placed = running_sum(deep, ["_file"], ["_block", "_row"], F.col("_block"), F.col("_done"), "_no").withColumn("_no", F.col("_no") - F.col("_done"))
    several = placed.groupBy("_file", "_no").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_file", "_no")
    inside = stored(placed.join(several, ["_file", "_no"]).select(*POSITION, "_no"), "xml-several")
    close = F.lit(f"</{prefix}:{tag}>" if prefix else f"</{tag}>")
    gathered = pieces.join(inside, POSITION).groupBy("_file", "_no").agg(F.array_sort(F.collect_list(F.struct("_block", "_row", "piece"))).alias("_p"))
    whole = F.concat(F.array_join(F.transform("_p", lambda p: p["piece"]), f"</{prefix}:{tag}>" if prefix else f"</{tag}>"), close)
    closed = gathered.select("_file", "_p", _closed_records(whole, F.lit(tag)).alias("_r"))
    pairs = closed.select("_file", F.explode(F.arrays_zip(F.transform("_p", lambda p: F.struct(p["_block"], p["_row"])).alias("at"), F.col("_r").alias("record"))).alias("x"))
    nested = pairs.select("_file", F.col("x.at._block").alias("_block"), F.col("x.at._row").alias("_row"), "x.record").where("record IS NOT NULL")
    piece = F.col("piece")
    single = pieces.filter(has_record(piece, tag)).join(inside.select(*POSITION), POSITION, "left_anti")
    return single.select(*POSITION, record_text(piece, tag, prefix).alias("record")).unionByName(nested)


def stream_records(spark: SparkSession, path, tag: str, prefix: str | None = None, files_per_batch: int = 64):
    """The same scan over files as they arrive; positions are added per micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    cut = _pieces(reader, path, tag, prefix, None).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.explode(_cut_again(F.col("value"), tag)).alias("piece"),
    )
    piece = F.col("piece")
    return cut.filter(has_record(piece, tag)).select("_file", "_block", record_text(piece, tag, prefix).alias("record"))


def count_elements(spark: SparkSession, path, tag: str, glob: str | None = None) -> DataFrame:
    """Elements of a name at any depth, per file: (file_path, n).

    Every element has one opening tag, and no opening tag is cut by the separator.
    """
    opening = rf"<(?:[\w.-]+:)?{tag}(?=[\s/>])"
    pieces = read_pieces(spark, path, tag, glob=glob)
    found = F.regexp_count("piece", F.lit(opening))
    return pieces.groupBy(F.col("_file").alias("file_path")).agg(F.sum(found).alias("n"))


def _without_cdata(record: Column) -> Column:
    """CDATA sections as ordinary escaped text."""
    parts = F.split(record, r"<!\[CDATA\[")

    def escape(part: Column) -> Column:
        inner = F.substring_index(part, "]]>", 1)
        rest = F.substr(part, F.length(inner) + F.lit(4))
        amp = F.replace(inner, F.lit("&"), F.lit("&amp;"))
        return F.concat(F.replace(amp, F.lit("<"), F.lit("&lt;")), rest)

    tail = F.transform(F.slice(parts, F.lit(2), F.size(parts)), escape)
    plain = F.concat(F.element_at(parts, 1), F.array_join(tail, ""))
    return F.when(F.contains(record, F.lit("<![CDATA[")), plain).otherwise(record)


def _parsable(record: Column) -> Column:
    """Record text in which escaped "<" is told apart from markup and comments end text.

    Byte searches decide whether a pattern has to run at all.
    """
    plain = F.replace(_without_cdata(record), F.lit("&lt;"), F.lit(ESCAPED_LT))
    numeric = F.regexp_replace(plain, r"&(?:#0*60|#[xX]0*3[cC]);", ESCAPED_LT)
    marked = F.when(F.contains(record, F.lit("&#")), numeric).otherwise(plain)
    uncommented = F.regexp_replace(marked, r"(?s)<!--.*?-->", "<comment/>")
    return F.when(F.contains(record, F.lit("<!--")), uncommented).otherwise(marked)


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _normal(values: Column, shape) -> Column:
    """Values of one child name as parsed, brought to the form its shape describes."""
    if shape == TEXT:
        return element_text(_first(values))
    if shape == [TEXT]:
        return F.transform(values, element_text)
    if isinstance(shape, list):
        return F.transform(values, lambda value: _fields(value, shape[0]))
    # an empty container is present, with every child missing
    return F.when(F.size(values) > 0, _fields(_first(values), shape))


def _fields(parent: Column, shape: dict) -> Column:
    return F.struct(*[_normal(parent[name], child).alias(name) for name, child in shape.items()])


def parse_records(records: DataFrame, shape: dict, ontology: bool = False) -> DataFrame:
    """Records as typed columns, one per child, plus ``_malformed`` (the text that did not parse).

    With ``ontology`` the recursive <ontology> child becomes the column ``ontology_terms``.
    Store the result before it is used: filters and generators on top of it would be pushed
    below the parse and repeat it.
    """
    raw = raw_struct(shape).add("_malformed", "string")
    options = {
        "ignoreSurroundingSpaces": "false",
        "ignoreNamespace": "true",
        "excludeAttribute": "true",
        "columnNameOfCorruptRecord": "_malformed",
    }
    kept = [name for name in records.columns if name != "record"]
    parsed = records.select(
        *kept, "record", F.from_xml(_parsable(F.col("record")), raw, options).alias("x")
    )
    if ontology:
        tag = r"(?:[\w.-]+:)?ontology"
        fragment = F.regexp_extract("record", rf"(?s)<({tag})[\s>].*</\1\s*>", 0)
        terms = ontology_terms(F.nullif(fragment, F.lit("")))
    columns = [_normal(F.col("x")[name], child).alias(name) for name, child in shape.items()]
    columns.append(F.col("x._malformed").alias("_malformed"))
    if ontology:
        columns.append(terms.cast(ONTOLOGY_TERMS).alias("ontology_terms"))
    return parsed.select(*kept, *columns)
