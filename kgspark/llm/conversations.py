"""Repair of the structure of conversations by cheapest edits: a checkpointed dynamic programme.

A repaired conversation is empty, or an optional system row and then pairs of user and assistant. Rows are kept
(0), given another role (3), deleted (4; due for blank rows and for those whose role and text came earlier) or
inserted without text (3); a row that breaks off and is not deleted costs 3 more. Among the cheapest edits the
ASCII-least string of their initials (D, I, K, R) counts.

Four states say what the rows so far end with. Backward vectors (the least cost of the rest, by state) are stored
only at every square root of the rows; walking forward, each block's vectors are computed again from the
checkpoint behind it, and of the tight edits the least is taken. Conversations beyond LONG_ROWS or LONG_BYTES
have their checkpoints made by Spark: ranges of rows become 4 x 4 matrices of least costs (which combine in any
grouping), and a conversation's matrices, one for about every square root of its rows, are folded from the end.
The forward walk streams over a task's sorted rows and holds one block. A hash over the whole repaired text is
sequential by nature, so one conversation is walked by one task, in memory of one block and its audit string.

Order: by turn (nulls first); within a turn, where nothing else is said, by role and text. Defined results: nulls
in role or text read as one space, in conv_id or turn as one space in the key of the damage; rows of a null
conv_id are one conversation; an empty role has no initial and fits nowhere; a conversation without rows has
zeros, an empty audit and the hash of nothing; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import bounded_batches, stored

LONG_ROWS = 20_000
LONG_BYTES = 16_000_000
KEEP, REROLE, DELETE, INSERT, BROKEN_OFF = 0, 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)  # what the rows so far end with
NEXT = (USER, USER, ASSISTANT, USER)  # the role that may follow, besides a system row at the start
END = (0, 6, 3, 0)  # what it costs to end here: the inserts that are missing
FAR = 1 << 40
NAMES = {USER: "user", ASSISTANT: "assistant"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
SPACE = " \t\n\x0b\f\r"

Vector = tuple[int, int, int, int]


def kind_of(must_go: bool, initial: str, broken_off: bool) -> int:
    """0 for a row that has to go; else twice its role's state, and 1 if it breaks off; no role of the three: 8 or 9."""
    return 0 if must_go else 2 * STATE.get(initial, 4) + broken_off


def kept_as(kind: int, state: int) -> int | None:
    """The state after a row is kept, if it may be."""
    role = kind // 2
    return role if role == NEXT[state] or role == SYSTEM and state == START else None


def back(after: Vector, kind: int) -> Vector:
    """The vector before a row, from the vector after it."""
    found = []
    for state in range(4):
        least = DELETE + after[state]
        if kind:
            broken = BROKEN_OFF * (kind & 1)
            least = min(least, REROLE + broken + after[NEXT[state]])
            kept = kept_as(kind, state)
            if kept is not None:
                least = min(least, KEEP + broken + after[kept])
        found.append(least)
    user = min(found[USER], INSERT + found[ASSISTANT])
    assistant = min(found[ASSISTANT], INSERT + found[USER])
    return min(found[START], INSERT + user), min(found[SYSTEM], INSERT + user), user, assistant


def matrix(kinds: bytes) -> list[int]:
    """Least costs of a range of rows from each state (row) to each state (column), inserts before rows included."""
    columns = []
    for state in range(4):
        vector = tuple(0 if s == state else FAR for s in range(4))
        for kind in reversed(kinds):
            vector = back(vector, kind)
        columns.append(vector)
    return [columns[to][at] for at in range(4) for to in range(4)]


def before(costs: list[int], after: Vector) -> Vector:
    return tuple(min(costs[4 * at + to] + after[to] for to in range(4)) for at in range(4))


def edits(kinds: bytes, after: Vector, state: int) -> Iterator[tuple[str, int]]:
    """The least tight edits of a range of rows, given the vector behind it: (initial, state after it), one by one."""
    step = max(1, math.isqrt(len(kinds)))
    checkpoints = {len(kinds): after}
    vector = after
    for i in range(len(kinds) - 1, -1, -1):
        vector = back(vector, kinds[i])
        if i % step == 0:
            checkpoints[i] = vector
    for first in range(0, len(kinds), step):
        last = min(first + step, len(kinds))
        vectors = [checkpoints[last]]
        for i in range(last - 1, first - 1, -1):
            vectors.append(back(vectors[-1], kinds[i]))
        vectors.reverse()
        for i in range(first, last):
            here, rest, kind = vectors[i - first], vectors[i - first + 1], kinds[i]
            while True:
                broken = BROKEN_OFF * (kind & 1)
                if here[state] == DELETE + rest[state]:
                    yield "D", state
                    break
                if here[state] == INSERT + here[NEXT[state]]:
                    state = NEXT[state]
                    yield "I", state
                    continue
                kept = kept_as(kind, state)
                if kept is not None and here[state] == KEEP + broken + rest[kept]:
                    state = kept
                    yield "K", state
                else:
                    state = NEXT[state]
                    yield "R", state
                break


def last_edits(state: int) -> Iterator[tuple[str, int]]:
    while END[state]:
        state = NEXT[state]
        yield "I", state


class Walk:
    """One conversation's rows in order: counts, edits and the hash of the repaired text."""

    def __init__(self, conv_id, checkpoints: list[tuple[int, Vector]]) -> None:
        self.conv_id = conv_id
        self.checkpoints = iter(checkpoints)  # (rows, vector behind them); none: the whole conversation at once
        self.whole = not checkpoints
        self.room, self.after = next(self.checkpoints, (0, END))
        self.rows: list[tuple[str, str]] = []
        self.kinds = bytearray()
        self.turns = [None, None, 0]  # least, largest, how many
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.state, self.cost, self.audit, self.hash, self.lines = START, 0, [], hashlib.sha256(), 0
        self.previous = None  # turn, role, text
        self.initial = None

    def row(self, turn, role: str, text: str, at_first: bool) -> None:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        again = not at_first or self.previous == (turn, role, text)
        self.previous = (turn, role, text)
        shown = text.rstrip(SPACE)
        broken_off = bool(shown) and shown[-1] not in ".!?"
        fault = "blank" if not shown else "duplicate" if again else "truncated" if broken_off else None
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = role[:1]
        self.kinds.append(kind_of(fault in ("blank", "duplicate"), role[:1], broken_off))
        self.rows.append((role, text))
        if not self.whole and len(self.kinds) == self.room:
            self.settle()
            self.room, self.after = next(self.checkpoints, (0, END))

    def line(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def settle(self) -> None:
        rows = iter(zip(self.rows, self.kinds))
        for initial, state in edits(bytes(self.kinds), self.after, self.state):
            self.audit.append(initial)
            if initial == "I":
                self.cost += INSERT
                self.line(NAMES[state], "")
            else:
                (role, text), kind = next(rows)
                self.cost += DELETE if initial == "D" else (REROLE if initial == "R" else KEEP) + BROKEN_OFF * (kind & 1)
                if initial != "D":
                    self.line(NAMES[state] if initial == "R" else role, text)
            self.state = state
        self.rows, self.kinds = [], bytearray()

    def result(self) -> tuple:
        self.settle()
        for initial, state in last_edits(self.state):
            self.audit.append(initial)
            self.cost += INSERT
            self.line(NAMES[state], "")
        low, high, distinct = self.turns
        gaps = 0 if low is None else high - low + 1 - distinct
        return (self.conv_id, gaps, *self.counts.values(), self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with ``copies`` (0 for a dropped one, 2 for a repeated one), damaged as the key of each says."""
    named = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.encode(F.concat(named("conv_id"), F.lit(":"), named("turn")), "UTF-8")), F.lit(20))
    return turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.when(fate == 4, "user").otherwise(named("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text")).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(turns: DataFrame) -> DataFrame:
    """The rows as they are, each once; nulls in role or text read as one space."""
    filled = [F.coalesce(F.col(name), F.lit(" ")).alias(name) for name in ("role", "text")]
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *filled, F.lit(1).alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """Adds ``at_first``: whether a row's turn is the first that has its role and text.

    The first turns come from a grouping that combines before the shuffle, and are joined by turn, so a text that
    fills a conversation meets itself neither in one group nor in one join key.
    """
    same = F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256)
    keyed = rows.withColumn("same", F.unhex(same))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("no"))  # null is least
    firsts = keyed.where("copies > 0").groupBy("conv_id", "same").agg(F.min(turn).alias("first"))
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), F.col("first.no").alias("_turn"), F.lit(True).alias("_first"))
    met = keyed["conv_id"].eqNullSafe(firsts["_conv"]) & keyed["turn"].eqNullSafe(firsts["_turn"]) & (keyed["same"] == firsts["_same"])
    return keyed.join(firsts, met, "left").select(*rows.columns, F.coalesce("_first", F.lit(False)).alias("at_first"))


ORDER = ["conv_id", "turn", "role", "text"]


def block_matrices(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """For long conversations: conv_id, range, block, n (rows), costs (their matrix), blocks in the order of rows.

    ``rows`` are those of long conversations, ``sizes`` their numbers of rows (n_rows). A block ends after the
    square root of these, or with LONG_BYTES of text.
    """
    bound = LONG_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kinds, size, key, previous, room = 0, bytearray(), 0, None, None, 0

        def made() -> pa.RecordBatch:
            values = [[key], [number], [len(kinds)], [matrix(bytes(kinds))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["conv_id", "block", "n", "costs"])

        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            for conv_id, turn, role, text, copies, at_first, n_rows in zip(*(c.to_pylist() for c in batch.columns)):
                if kinds and conv_id != key:
                    yield made()
                    number, kinds, size = number + 1, bytearray(), 0
                key, room = conv_id, math.isqrt(n_rows)
                for _ in range(copies):
                    again = not at_first or previous == (conv_id, turn, role, text)
                    previous = (conv_id, turn, role, text)
                    shown = text.rstrip(SPACE)
                    kinds.append(kind_of(not shown or again, role[:1], bool(shown) and shown[-1] not in ".!?"))
                    size += len(text)
                    if len(kinds) >= room or size >= bound:
                        yield made()
                        number, kinds, size = number + 1, bytearray(), 0
        if kinds:
            yield made()

    known = rows.join(sizes.select(F.col("conv_id").alias("_conv"), "n_rows"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    # equal rows lie in one range, so each range knows whether a row repeats the one before
    ranges = known.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    made = ranges.select(*ORDER, "copies", "at_first", "n_rows").mapInArrow(run, "conv_id long, block long, n long, costs array<long>")
    return made.withColumn("range", F.spark_partition_id())


def checkpoints(blocks: DataFrame) -> DataFrame:
    """The vector behind each block: conv_id, ns and vectors, blocks in order. One row for a long conversation."""

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("range", "block", "n", "costs"))))
        vector, found = END, []
        for *_, costs in reversed(rows):
            found.append(list(vector))
            vector = before(costs, vector)
        values = [[table.column("conv_id")[0].as_py()], [[r[2] for r in rows]], [found[::-1]]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["conv_id", "ns", "vectors"])

    return blocks.groupBy("conv_id").applyInArrow(fold, "conv_id long, ns array<long>, vectors array<array<long>>")


def walked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Streams over the sorted rows of each task; a long conversation's checkpoints come before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, given, done, types = None, None, [], [pa.int64()] * 7 + [pa.string()] * 2

        def made() -> pa.RecordBatch:
            names = [x.split()[0] for x in RESULT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

        for batch in batches:
            for conv_id, turn, role, text, copies, at_first, ns, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                if ns is not None:
                    given = conv_id, list(zip(ns, map(tuple, vectors)))
                    continue
                if walk is None or walk.conv_id != conv_id:
                    if walk:
                        done.append(walk.result())
                    walk = Walk(conv_id, given[1] if given and given[0] == conv_id else [])
                for _ in range(copies):
                    walk.row(turn, role, text, at_first)
            if done:
                yield made()
                done.clear()
        if walk:
            done.append(walk.result())
            yield made()

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    lists = ("array<long>", "ns"), ("array<array<long>>", "vectors")
    own = rows.select(*ORDER, "copies", "at_first", *(none(*x) for x in lists))
    ahead = marks.select("conv_id", none("long", "turn"), none("string", "role"), none("string", "text"), none("int", "copies"), none("boolean", "at_first"), "ns", "vectors")
    dealt = own.unionByName(ahead).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("ns").isNull(), *ORDER[1:])
    return dealt.mapInArrow(run, RESULT)


def repaired(rows: DataFrame) -> DataFrame:
    """Counts of faults, cheapest edits and the hash of the repaired text, for each conv_id of ``rows``.

    ``rows`` has conv_id, turn, role, text and copies: how often the row stands, 0 if only its conversation counts.
    """
    bounded_batches(rows.sparkSession)
    rows = stored(marked(rows), "conversation-rows")
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n_rows"), F.sum(F.col("copies") * F.length("text")).alias("n_text"))
    long = stored(sizes.where((F.col("n_rows") > LONG_ROWS) | (F.col("n_text") > LONG_BYTES)), "long-conversations")
    theirs = rows.join(long.select(F.col("conv_id").alias("_conv")), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    marks = stored(checkpoints(stored(block_matrices(theirs, long), "conversation-blocks")), "conversation-checkpoints")
    return walked(rows, marks)
