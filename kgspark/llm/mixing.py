"""Mixing sources to target weights in fixed-length blocks, drawn without keeping a list of what was drawn.

The words of a source, its documents in a repeatable pseudorandom order, form one line that is cut into
blocks of a fixed number of words. Every output shard draws how many of its slots go to each source, from a
multinomial over what the sources still owe, so that the shards together hold each source's share. The
slots of a source are numbered through, and a pseudorandom permutation of its block numbers, another one for
every pass over the source, says which block a slot holds. Slots and blocks meet in a join on that number.

A source's target is its weight's share of all words, at most REPEATS times its size; what is cut off goes to
the other sources by weight. Defined results: a null text has no words; a null source is a source and comes
last; sources without words have target 0; repeated rows are documents of their own; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import bounded_batches, stored

from .common import mixed, numbered, rows_of

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3
LONGEST = 256  # words of a block
LEAST_BLOCKS = 400  # a smaller source has shorter blocks, so that its share stays fine enough
SHARDS = 64
SEED = 8


def weights_of(sources: list[str | None]) -> dict[str | None, int]:
    """1, 2, 3 and again, by code point; null last."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: 1 + i % 3 for i, s in enumerate(order)}


def targets_of(sizes: dict, weights: dict, repeats: int = REPEATS) -> dict:
    """Words for each source: all sizes shared by weight, the excess over ``repeats`` sizes shared again."""
    target = {s: 0.0 for s in sizes}
    left, open_ = float(sum(sizes.values())), {s for s in sizes if sizes[s] > 0}
    while open_:
        per = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if per * weights[s] > repeats * sizes[s]}
        if not over:
            return target | {s: per * weights[s] for s in open_}
        for s in over:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def drawn(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws over what is owed; the last shard takes the rest."""
    owed, draw = np.array(quotas, np.int64), np.random.default_rng(seed)
    total, out = int(owed.sum()), np.zeros((shards, len(quotas)), np.int64)
    for shard in range(shards):
        room = total // shards + (shard < total % shards)
        while room:  # what a draw takes beyond the debt is drawn again
            took = np.minimum(draw.multinomial(room, owed / owed.sum()), owed)
            out[shard] += took
            owed -= took
            room -= int(took.sum())
    return out


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A permutation of 0 to size - 1 at the given places: a Feistel network, walked until it lands inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            left, right = x >> shift, x & mask
            for r in range(4):
                left, right = right, left ^ (mixed(right + np.uint64(key * 4 + r + 1) * np.uint64(0x9E3779B97F4A7C15)) & mask)
            out[todo] = x = (left << shift) | right
            todo = todo[x >= size]
    return out.astype(np.int64)


@dataclass
class Mix:
    """``slots``: shard, slot, source_no, block; ``pieces``: the documents' words in blocks; ``taken``: rows of documents with words taken."""

    slots: DataFrame
    pieces: DataFrame
    taken: DataFrame


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> Mix:
    """The driver holds one row for each source and the slot counts of ``shards`` shards."""
    spark = docs.sparkSession
    rows = stored(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("text_hash")), "mix-rows")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    weights = weights_of(list(sizes))
    targets = targets_of(sizes, weights)
    names = list(weights)
    length = [max(1, min(LONGEST, int(targets[s]) // LEAST_BLOCKS)) for s in names]
    blocks = [-(-sizes[s] // n) for s, n in zip(names, length)]
    quotas = [min(REPEATS * b, round(targets[s] / n)) for s, n, b in zip(names, length, blocks)]
    counts = drawn(quotas, shards, seed)
    facts = spark.createDataFrame(
        [(s, i, int(sizes[s]), float(targets[s]), length[i]) for i, s in enumerate(names)], "of string, source_no int, source_size long, target double, length int"
    )
    ends = np.cumsum(counts.reshape(-1))
    passed = np.cumsum(counts, 0) - counts  # slots of a source in earlier shards

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            cell = np.searchsorted(ends, slot, "right")
            shard, source = cell // len(names), cell % len(names)
            index = passed[shard, source] + slot - (ends[cell] - counts[shard, source])
            block = np.zeros(len(slot), np.int64)
            for s in np.unique(source):
                for turn in range(REPEATS):
                    at = np.flatnonzero((source == s) & (index // blocks[s] == turn))
                    block[at] = permuted(index[at] % blocks[s], blocks[s], (seed * len(names) + int(s)) * REPEATS + turn)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(slot), pa.array(source, pa.int32()), pa.array(block)], names=["shard", "slot", "source_no", "block"]
            )

    slots = spark.range(int(ends[-1]) if len(ends) else 0).mapInArrow(fill, "shard int, slot long, source_no int, block long")
    placed = numbered(rows, ["source"], "size")
    placed = placed.join(F.broadcast(facts), placed["source"].eqNullSafe(facts["of"])).drop("of")  # one row for each source
    placed = stored(placed, "mix-placed")
    inside = placed.where("size > 0").withColumn("end", F.col("start") + F.col("size"))
    inside = inside.withColumn("block", F.explode(F.expr("sequence(start div length, (end - 1) div length)")))
    first = F.greatest("start", F.col("block") * F.col("length"))
    last = F.least("end", (F.col("block") + 1) * F.col("length"))
    pieces = inside.select("source_no", "block", "pos", (first - F.col("start")).alias("first_word"), (last - first).alias("n_words"))
    times = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    pieces = stored(pieces.join(times, ["source_no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0))), "mix-pieces")
    taken = pieces.groupBy("source_no", "pos").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    taken = placed.join(taken, ["source_no", "pos"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return Mix(slots, pieces, taken)


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: for each pass over a source, what it takes of a document, under the document's own columns.

    A document that a pass takes whole keeps its text; of one that it takes in parts, the parts follow each
    other on lines of their own. Documents without words are not in a mix.
    """
    bounded_batches(docs.sparkSession)
    made = mix(docs, shards, seed)
    runs = made.pieces.where("times > 0").groupBy("source_no", "pos").agg(F.collect_list(F.struct("first_word", "n_words", "times")).alias("runs"))
    keys = ["doc_id", "source", "text_hash"]
    nth = lambda *by: F.row_number().over(W.partitionBy(*keys).orderBy(*by))
    takes = made.taken.select(*keys, "source_no", "pos", "size").join(runs, ["source_no", "pos"]).withColumn("nth", nth("pos"))
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    full = docs.select(F.struct(*others).alias("doc"), "doc_id", "source", "text").withColumn("text_hash", F.xxhash64("text")).withColumn("nth", nth(F.lit(0)))
    met = full.join(takes, [full[k].eqNullSafe(takes[k]) for k in (*keys, "nth")])
    rows = met.select("doc", "size", "runs", "text")
    word = re.compile(WORD)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 128):
                at, texts = [], []
                for i, (size, runs, text) in enumerate(zip(*(part.column(c).to_pylist() for c in ("size", "runs", "text")))):
                    runs.sort(key=lambda r: r["first_word"])
                    spans = None
                    for turn in range(max(r["times"] for r in runs)):
                        own = [r for r in runs if r["times"] > turn]
                        if sum(r["n_words"] for r in own) == size:
                            at.append(i), texts.append(text)
                            continue
                        spans = spans or [m.span() for m in word.finditer(text)]
                        lines: list[list[int]] = []
                        for r in own:
                            if lines and lines[-1][1] == r["first_word"]:
                                lines[-1][1] += r["n_words"]
                            else:
                                lines.append([r["first_word"], r["first_word"] + r["n_words"]])
                        at.append(i), texts.append("\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in lines))
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(at, pa.int64())), pa.array(texts, pa.string())], names=["doc", "text"])

    kind = met.sparkSession.createDataFrame([], rows.select("doc", "text").schema).schema
    out = rows.mapInArrow(cut, kind)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
