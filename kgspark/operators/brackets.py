"""Structure of any XML file, however it is cut: parallel matching of brackets.

A file is read as pieces that end with ``>``, in as many byte ranges as Spark likes. What a range means depends
on what lies before it in two ways, and both combine associatively:

* whether it begins in text or inside a comment, a quoted value and so on: each range says, for every state
  that it may begin in, how it ends;
* which elements are open: a stretch of a range is summarised by how many elements it closes that it has not
  opened, and which it opens and leaves open. Children of elements that were opened earlier are counted by how
  far down the stack their parent is.

States that meet at a piece go on together from there, so a range is read once. One small row for each range is
folded over the file, which gives every range its state and its stack; pairs inside ranges are then only added up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

# What a range may begin in; a document begins in text.
TEXT, DOUBLE, SINGLE, COMMENT, CDATA, INSTRUCTION, SUBSET, SUBSET_COMMENT = range(8)
QUOTES = {DOUBLE: '"', SINGLE: "'"}
ENDS = {COMMENT: "--", CDATA: "]]", INSTRUCTION: "?"}
_BLANK = " \t\r\n"


class Stretch:
    """Elements of a stretch of pieces, relative to the stack that it begins with."""

    __slots__ = ("closed", "opened", "pairs", "below")

    def __init__(self):
        self.closed, self.opened = 0, []
        self.pairs: Counter = Counter()  # (parent, child)
        self.below: Counter = Counter()  # (elements between the parent and the top, child)

    def open(self, tag: str) -> None:
        if self.opened:
            self.pairs[self.opened[-1], tag] += 1
        else:
            self.below[self.closed, tag] += 1
        self.opened.append(tag)

    def close(self) -> None:
        if self.opened:
            self.opened.pop()
        else:
            self.closed += 1


def _in_tag(piece: str, at: int, stretch: Stretch) -> int:
    """The rest of a tag from a place outside quotes; the element is open already."""
    while True:
        places = [p for p in (piece.find('"', at), piece.find("'", at)) if p >= 0]
        if not places:
            break
        first = min(places)
        until = piece.find(piece[first], first + 1)
        if until < 0:
            return DOUBLE if piece[first] == '"' else SINGLE
        at = until + 1
    if piece.endswith("/") and len(piece) > at:
        stretch.close()
    return TEXT


def _in_text(piece: str, stretch: Stretch) -> int:
    at = piece.find("<")
    if at < 0:
        return TEXT
    begin = piece[at + 1 : at + 2]
    if begin == "/":
        stretch.close()
        return TEXT
    if begin == "?":
        return TEXT if piece.endswith("?") and len(piece) > at + 2 else INSTRUCTION
    if begin == "!":
        if piece.startswith("<!--", at):
            return TEXT if piece.endswith("--") and len(piece) >= at + 6 else COMMENT
        if piece.startswith("<![CDATA[", at):
            return TEXT if piece.endswith("]]") and len(piece) >= at + 11 else CDATA
        return _in_subset(piece, piece.find("[", at) + 1) if piece.find("[", at) >= 0 else TEXT
    end = at + 1
    while end < len(piece) and piece[end] not in " \t\r\n/":
        end += 1
    stretch.open(piece[at + 1 : end].rsplit(":", 1)[-1])
    if end == len(piece):
        return TEXT
    return _in_tag(piece, end, stretch)


def _in_subset(piece: str, at: int = 0) -> int:
    begin = piece.rfind("<!--", at)
    if begin >= 0 and not (piece.endswith("--") and len(piece) >= begin + 6):
        return SUBSET_COMMENT
    return TEXT if begin < 0 and piece.rstrip(_BLANK).endswith("]") else SUBSET


def step(state: int, piece: str, stretch: Stretch) -> int:
    """The state after a piece (without its ``>``) and what the piece opens and closes."""
    if state == TEXT:
        return _in_text(piece, stretch)
    if state in ENDS:
        return TEXT if piece.endswith(ENDS[state]) else state
    if state in QUOTES:
        at = piece.find(QUOTES[state])
        return state if at < 0 else _in_tag(piece, at + 1, stretch)
    if state == SUBSET_COMMENT:
        return SUBSET if piece.endswith("--") else SUBSET_COMMENT
    return _in_subset(piece)


class Range:
    """Pieces of one byte range, read from all states that it may begin in."""

    def __init__(self, file: int, block: int):
        self.file, self.block, self.path = file, block, None
        self.stretches: list[Stretch] = []
        self.chains: list[list[int]] = [[] for _ in range(8)]
        # state: (first states that have come to it, its stretch); a document's first range begins in text
        first = [TEXT] if block == 0 else range(8)
        self.now = {state: ([state], self._stretch([state])) for state in first}

    def _stretch(self, begun: list[int]) -> Stretch:
        made = Stretch()
        for state in begun:
            self.chains[state].append(len(self.stretches))
        self.stretches.append(made)
        return made

    def read(self, piece: str) -> None:
        waiting = len(self.now) > 1
        if not waiting:
            ((state, (begun, stretch)),) = self.now.items()
            after = step(state, piece, stretch)
            if after != state:
                self.now = {after: (begun, stretch)}
            return
        moved: dict[int, list] = {}
        for state, (begun, stretch) in self.now.items():
            moved.setdefault(step(state, piece, stretch), []).append((begun, stretch))
        self.now = {}
        for state, met in moved.items():
            if len(met) == 1:
                self.now[state] = met[0]
            else:
                begun = [s for some, _ in met for s in some]
                self.now[state] = begun, self._stretch(begun)

    def row(self) -> dict:
        ends = [TEXT] * 8
        for state, (begun, _) in self.now.items():
            for first in begun:
                ends[first] = state
        return {
            "file": self.file,
            "block": self.block,
            "path": self.path,
            "ends": ends,
            "chains": self.chains,
            "moves": [{"closed": s.closed, "opened": s.opened, "below": _listed(s.below, "depth", "child")} for s in self.stretches],
            "pairs": [_listed(s.pairs, "parent", "child") for s in self.stretches],
        }


def _listed(counted: Counter, first: str, second: str) -> list[dict]:
    return [{first: a, second: b, "n": n} for (a, b), n in counted.items()]


_BELOW = pa.list_(pa.struct([("depth", pa.int64()), ("child", pa.string()), ("n", pa.int64())]))
_PAIRS = pa.list_(pa.struct([("parent", pa.string()), ("child", pa.string()), ("n", pa.int64())]))
_RANGE = pa.schema(
    [
        ("file", pa.int64()),
        ("block", pa.int64()),
        ("path", pa.string()),
        ("ends", pa.list_(pa.int32())),
        ("chains", pa.list_(pa.list_(pa.int32()))),
        ("moves", pa.list_(pa.struct([("closed", pa.int64()), ("opened", pa.list_(pa.string())), ("below", _BELOW)]))),
        ("pairs", pa.list_(_PAIRS)),
    ]
)
_PAIR_LIST = "array<struct<parent: string, child: string, n: bigint>>"
_RANGE_TYPES = (
    "file long, block long, path string, ends array<int>, chains array<array<int>>, "
    "moves array<struct<closed: bigint, opened: array<string>, below: array<struct<depth: bigint, child: string, n: bigint>>>>, "
    f"pairs array<{_PAIR_LIST}>"
)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current = None
    for batch in batches:
        for file, block, path, piece in zip(*(column.to_pylist() for column in batch.columns)):
            if current is None or (current.file, current.block) != (file, block):
                if current:
                    yield pa.RecordBatch.from_pylist([current.row()], schema=_RANGE)
                current = Range(file, block)
            current.path = path
            current.read(piece)
    if current:
        yield pa.RecordBatch.from_pylist([current.row()], schema=_RANGE)


def _fold(ranges: pa.Table) -> pa.Table:
    """For each range of a file: the stretches that count, and the pairs whose parent an earlier range opened."""
    state, stack, rows = TEXT, [], []
    for row in sorted(ranges.to_pylist(), key=lambda r: r["block"]):
        found: Counter = Counter()
        used = row["chains"][state]
        for number in used:
            move = row["moves"][number]
            for below in move["below"]:
                place = len(stack) - 1 - below["depth"]
                found[stack[place] if place >= 0 else None, below["child"]] += below["n"]
            if move["closed"]:
                del stack[max(0, len(stack) - move["closed"]) :]
            stack += move["opened"]
        state = row["ends"][state]
        rows.append({"file": row["file"], "block": row["block"], "used": used, "found": _listed(found, "parent", "child")})
    shape = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("used", pa.list_(pa.int32())), ("found", _PAIRS)])
    return pa.Table.from_pylist(rows, schema=shape)


def element_pairs(spark: SparkSession, path, glob: str | None = "*.xml") -> DataFrame:
    """(file_path, parent, child, n): how often each element stands in which; the parent of a root is null.

    Names are without prefix. Comments, CDATA sections, instructions and the document type count for nothing.
    """
    reader = spark.read.option("lineSep", ">")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    block, name = F.col("_metadata.file_block_start"), F.col("_metadata.file_path")
    pieces = reader.text(path).select(
        F.xxhash64(name).alias("file"), block.alias("block"), F.when(block == 0, name).alias("path"), F.col("value").alias("piece")
    )
    ranges = stored(pieces.mapInArrow(_ranges, _RANGE_TYPES), "xml-ranges")
    # one row for each range, without the pairs that it has found inside itself
    folded = ranges.select("file", "block", "ends", "chains", "moves").groupBy("file").applyInArrow(
        _fold, f"file long, block long, used array<int>, found {_PAIR_LIST}"
    )
    paths = ranges.where("path is not null").select("file", F.col("path").alias("file_path"))
    inside = ranges.select("file", "block", "pairs").join(folded, ["file", "block"])
    counted = F.transform("used", lambda number: F.get("pairs", number))
    lists = F.concat("found", F.flatten(counted))
    each = inside.select("file", F.explode(lists).alias("p")).groupBy("file", "p.parent", "p.child").agg(F.sum("p.n").alias("n"))
    return each.join(paths, "file").select("file_path", "parent", "child", "n")


def structure_of_any(spark: SparkSession, path, glob: str | None = "*.xml") -> DataFrame:
    """Distinct (file_path, parent, child) of XML files of any form; no record tag has to be known."""
    return element_pairs(spark, path, glob).where("parent IS NOT NULL").select("file_path", "parent", "child")
