"""Column helpers for element text, keys and markup. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip() removes.
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Stands for an escaped "<" while a record is parsed, so that markup and text stay apart.
# A noncharacter: legal in XML, never assigned, not meant for interchange.
ESCAPED_LT = chr(0x10FFFE)


def strip(value: Column) -> Column:
    """Remove surrounding Unicode whitespace; null stays null."""
    return F.trim(value, F.lit(SPACE))


def nonempty(value: Column) -> Column:
    """True where the value is neither null nor the empty string."""
    return F.coalesce(value, F.lit("")) != ""


def any_nonempty(*values: Column) -> Column:
    """True where at least one value is neither null nor empty."""
    found = nonempty(values[0])
    for value in values[1:]:
        found = found | nonempty(value)
    return found


def element_text(raw: Column) -> Column:
    """Text of an element up to its first child, stripped.

    An element without text is null; one that holds only whitespace is the empty string.
    """
    head = F.nullif(F.substring_index(raw, "<", 1), F.lit(""))
    return F.replace(strip(head), F.lit(ESCAPED_LT), F.lit("<"))


def or_none(value: Column) -> Column:
    """Null becomes the text ``None`` (key formulas print missing parts that way)."""
    return F.coalesce(value, F.lit("None"))


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def text_length(value: Column) -> Column:
    """Length in code points, 0 for null, as text for use in a key."""
    return F.length(or_empty(value)).cast("string")


def joined(*parts: Column) -> Column:
    """Key parts joined by ``_``. Parts must not be null: wrap them in or_none or or_empty."""
    return F.concat_ws("_", *parts)


def same_ci(left: Column, right: Column) -> Column:
    """Case-insensitive equality; an equi-join condition when used in a join."""
    return F.lower(left) == F.lower(right)


# --- think blocks ----------------------------------------------------------------------

_THINK = r"(?s)<think>(.*?)</think>"


def think_blocks(text: Column) -> Column:
    """Non-blank contents of closed <think> blocks, in order, stripped."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_THINK), F.lit(1)), strip)
    return F.filter(found, lambda block: block != "")


def without_think(text: Column) -> Column:
    """Text with closed <think> blocks cut out; an unclosed tag stays as it is."""
    return F.regexp_replace(text, _THINK, "")
