"""The two XML jobs that need a parser in Python: recursive terms and tag pairs.

Both read plain expat events, so unbound prefixes in a fragment do no harm.
"""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ONTOLOGY_TERMS
from .text import SPACE


def _local(tag: str) -> str:
    return tag.rsplit(":", 1)[-1]


class _Element:
    __slots__ = ("tag", "text", "open", "children")

    def __init__(self, tag: str):
        self.tag, self.text, self.open, self.children = tag, "", True, []

    def first(self, tag: str) -> "_Element | None":
        return next((child for child in self.children if child.tag == tag), None)

    def all(self, tag: str) -> list["_Element"]:
        return [child for child in self.children if child.tag == tag]

    def text_of(self, tag: str) -> str | None:
        child = self.first(tag)
        return child.text.strip(SPACE) if child is not None and child.text else None


def _tree(fragment: str) -> _Element:
    top = _Element("")
    stack = [top]

    def start(tag, _attributes):
        stack[-1].open = False
        element = _Element(_local(tag))
        stack[-1].children.append(element)
        stack.append(element)

    def characters(data):
        if stack[-1].open:
            stack[-1].text += data

    def close_text(*_):
        stack[-1].open = False

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _tag: stack.pop()
    parser.CharacterDataHandler = characters
    parser.CommentHandler = close_text
    parser.ProcessingInstructionHandler = close_text
    parser.Parse(fragment, True)
    return top.children[0]


def term_rows(fragment: str) -> list[dict]:
    """Terms of an <ontology> element in pre-order, each with the term it hangs under.

    A term without a name is left out together with everything below it.
    """
    rows = []
    todo = [(root, None) for root in reversed(_tree(fragment).all("root"))]
    while todo:
        element, parent = todo.pop()
        term = element.text_of("term")
        if not term:
            continue
        rows.append(
            {
                "parent": parent,
                "term": term,
                "definition": element.text_of("definition"),
                "level": element.text_of("level"),
                "type": element.text_of("type"),
            }
        )
        below = element.first("descendants")
        if below is not None:
            todo.extend((child, term) for child in reversed(below.all("descendant")))
    return rows


@F.pandas_udf(ONTOLOGY_TERMS)
def ontology_terms(fragments: pd.Series) -> pd.Series:
    return fragments.map(lambda text: term_rows(text) if text else None)


def tag_rows(piece: str) -> dict:
    """Distinct (parent, child) tags of a piece of a document.

    ``root`` and ``container`` are the outermost and innermost elements the piece leaves open.
    A parent of None stands for the element that an earlier piece left open. End tags of such
    elements at the start of the piece are passed over.
    """
    piece = re.sub(r"^(\s*</[^>]*>)+", "", piece).lstrip()
    pairs: set = set()
    stack: list = [None]

    def start(tag, _attributes):
        tag = _local(tag)
        pairs.add((stack[-1], tag))
        stack.append(tag)

    parser = expat.ParserCreate()
    declared = piece.startswith(("<?xml", "<!DOCTYPE"))
    if not declared:
        parser.Parse("<piece>", False)
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _tag: stack.pop()
    try:
        parser.Parse(piece, False)
    except expat.ExpatError:
        if stack != [None]:
            raise
        # otherwise the end tag of an element opened earlier: nothing can follow it
    still_open = stack[1:]
    if declared or still_open:
        pairs = {pair for pair in pairs if pair[0] is not None}
    return {
        "pairs": [{"parent": parent, "child": child} for parent, child in pairs],
        "root": still_open[0] if still_open else None,
        "container": still_open[-1] if still_open else None,
    }


_PAIR = T.StructType([T.StructField("parent", T.StringType()), T.StructField("child", T.StringType())])
TAG_ROWS = T.StructType(
    [
        T.StructField("pairs", T.ArrayType(_PAIR)),
        T.StructField("root", T.StringType()),
        T.StructField("container", T.StringType()),
    ]
)


@F.pandas_udf(TAG_ROWS)
def tag_pairs(pieces: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tag_rows(text) for text in pieces], columns=["pairs", "root", "container"])
