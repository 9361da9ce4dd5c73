"""Think blocks of token streams as pieces: no stream is ever put together.

Chunks may cut a tag at any place. What a chunk means depends on what came before it only through a state: outside
or inside a block, and how much of the next tag the text so far ends with. A chunk maps states to states, such
maps compose, and a block of the stream's order is one map: one small row. Folded over the blocks of a stream these
rows give every block the state that it begins in, and its pieces follow from its own chunks.

A piece is text outside blocks, or inside block number ``block``. A block that is never closed is no block: its
tag and its text are outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_batches, stored

TAGS = ("<think>", "</think>")  # what the text outside, and the text inside a block waits for
STATES = [(mode, k) for mode in (0, 1) for k in range(len(TAGS[mode]))]
NUMBER = {state: i for i, state in enumerate(STATES)}
TEXT, OPEN, CLOSE = 0, 1, 2


def step(state: tuple[int, int], chunk: str) -> tuple[tuple[int, int], list[tuple[int, int, str]]]:
    """The state after a chunk, and its pieces (mode, kind, text).

    Text that may begin a tag is held back as state, and comes as a piece of the chunk that decides.
    """
    mode, k = state
    pieces: list[tuple[int, int, str]] = []
    at = 0
    while True:
        tag = TAGS[mode]
        if k:
            rest = chunk[at : at + len(tag) - k]
            if tag.startswith(rest, k):
                if k + len(rest) < len(tag):
                    return (mode, k + len(rest)), pieces
                pieces.append((mode, CLOSE if mode else OPEN, tag))
                at, mode, k = at + len(rest), 1 - mode, 0
                continue
            pieces.append((mode, TEXT, tag[:k]))  # no tag after all; the next can only begin in this chunk
            k = 0
        found = chunk.find(tag, at)
        if found >= 0:
            if found > at:
                pieces.append((mode, TEXT, chunk[at:found]))
            pieces.append((mode, CLOSE if mode else OPEN, tag))
            at, mode = found + len(tag), 1 - mode
            continue
        last = chunk.rfind("<", max(at, len(chunk) - len(tag) + 1))
        held = len(chunk) - last if last >= 0 and tag.startswith(chunk[last:]) else 0
        if len(chunk) - held > at:
            pieces.append((mode, TEXT, chunk[at : len(chunk) - held]))
        return (mode, held), pieces


class Map:
    """What a run of chunks makes of every state that it may begin in: (state after it, blocks opened).

    States that have met, with the same number of blocks opened since, go on together.
    """

    def __init__(self) -> None:
        self.now = {state: [(i, 0)] for i, state in enumerate(STATES)}  # state: (first state, blocks opened)

    def feed(self, chunk: str) -> None:
        moved: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for state, begun in self.now.items():
            after, pieces = step(state, chunk)
            opened = sum(kind == OPEN for _, kind, _ in pieces)
            moved.setdefault(after, []).extend((i, n + opened) for i, n in begun)
        self.now = moved

    def columns(self) -> tuple[list[int], list[int]]:
        ends, opened = [0] * len(STATES), [0] * len(STATES)
        for state, begun in self.now.items():
            for i, n in begun:
                ends[i], opened[i] = NUMBER[state], n
        return ends, opened


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _maps(schema: pa.Schema, keys: int):
    """One row for each run of rows with the same keys and block: (keys, block, ends, opened)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, made, done = None, None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        for row in _keyed(batches):
            if row[: keys + 1] != group:
                if made:
                    done.append((*group, *made.columns()))
                    if len(done) >= 1000:
                        yield rows()
                        done.clear()
                group, made = row[: keys + 1], Map()
            made.feed(row[keys + 2] or "")
        if made:
            done.append((*group, *made.columns()))
        if done:
            yield rows()

    return run


def _starts(keys: list[str], schema: pa.Schema):
    """For each block of a stream: the state it begins in, blocks opened before; on the last one also how the stream ends."""

    def run(blocks: pa.Table) -> pa.Table:
        state, opened, rows = 0, 0, []
        table = sorted(blocks.to_pylist(), key=lambda r: (r["_block"] is not None, r["_block"]))
        for i, row in enumerate(table):
            begin = (*(row[k] for k in keys), row["_block"], state, opened)
            state, opened = row["ends"][state], opened + row["opened"][state]
            rows.append((*begin, state if i == len(table) - 1 else None, opened))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _pieces(schema: pa.Schema, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, block, done = None, None, 0, []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if row[: keys + 1] != group:
                    group, state, block = row[: keys + 1], STATES[row[keys + 3]], row[keys + 4]
                state, found = step(state, row[keys + 2] or "")
                for part, (mode, kind, text) in enumerate(found):
                    block += kind == OPEN
                    done.append((*row[:keys], row[keys + 1], part, block if mode or kind == OPEN else None, kind, text))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []

    return run


def _arrow(fields: list[T.StructField]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType(fields))


def think_pieces(chunks: DataFrame, keys: list[str], block: Column, order: str = "seq", text: str = "text") -> DataFrame:
    """(keys, order, part, block, text): the text of all chunks in pieces, without the tags of closed blocks.

    ``block`` cuts the order of a stream: a column that never falls as ``order`` (unique in a stream)
    rises. Text outside blocks has a null block; blocks are numbered from 1 in each stream. What a
    chunk ends with comes later if it may begin a tag, with the chunk that decides, or as the last
    piece of its stream, where the order is that of the last chunk.
    """
    bounded_batches(chunks.sparkSession)
    rows = chunks.select(*keys, block.cast("long").alias("_block"), F.col(order), F.col(text).alias("_text"))
    key_fields = [rows.schema[k] for k in keys]
    long_, list_ = T.LongType(), T.ArrayType(T.IntegerType())
    field = T.StructField

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", order)

    map_fields = [*key_fields, field("_block", long_), field("ends", list_), field("opened", T.ArrayType(long_))]
    maps = dealt(rows).mapInArrow(_maps(_arrow(map_fields), len(keys)), T.StructType(map_fields))
    start_fields = [*key_fields, field("_block", long_), field("_state", T.IntegerType()), field("_before", long_), field("_end", T.IntegerType()), field("_opened", long_)]
    starts = stored(maps.groupBy(*keys).applyInArrow(_starts(keys, _arrow(start_fields)), T.StructType(start_fields)), "think-starts")

    def with_keys(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        """Joined where keys are equal, or both null."""
        renamed = right.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(names)), *(c for c in right.columns if c not in names))
        met = [left[c].eqNullSafe(renamed[f"_k{i}"]) for i, c in enumerate(names)]
        return left.join(renamed, met, "left").drop(*(f"_k{i}" for i in range(len(names))))

    begun = with_keys(rows, starts.select(*keys, "_block", "_state", "_before"), [*keys, "_block"])
    piece_fields = [*key_fields, rows.schema[order], field("part", long_), field("block", long_), field("_kind", T.IntegerType()), field("text", T.StringType())]
    found = dealt(begun).select(*keys, "_block", order, "_text", "_state", "_before").mapInArrow(
        _pieces(_arrow(piece_fields), len(keys)), T.StructType(piece_fields)
    )
    # a stream that ends inside a block has not closed its last one; what was held back comes last
    state_of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("_end"))
    ends = starts.where("_end IS NOT NULL").select(
        *keys, F.when(state_of([mode for mode, _ in STATES]) == 1, F.col("_opened")).alias("_unclosed"), state_of([TAGS[mode][:k] for mode, k in STATES]).alias("_held")
    )
    last = rows.groupBy(*keys).agg(F.max(order).alias(order))
    held = with_keys(last, ends.where("_held != ''"), keys).where("_held IS NOT NULL")
    held = held.select(*keys, order, F.lit(1 << 40).alias("part"), F.col("_unclosed").alias("block"), F.lit(TEXT).alias("_kind"), F.col("_held").alias("text"))
    whole = with_keys(found.unionByName(held), ends.select(*keys, "_unclosed"), keys)
    outside = F.col("block").eqNullSafe(F.col("_unclosed")) & F.col("block").isNotNull()
    kept = whole.where((F.col("_kind") == TEXT) | outside)
    return kept.select(*keys, order, "part", F.when(~outside, F.col("block")).alias("block"), "text")
