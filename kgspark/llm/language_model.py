"""Scores of a smoothed n-gram model, as one traversal of a weighted backoff automaton.

States are the histories that training has met (up to ORDER - 1 words, the beginning of a document among them)
and the empty one. From history h the arc of word w weighs log10 p(w|h) where training has met hw, else the
failure arc to the next shorter history weighs log10 of what h leaves to it. The smoothing takes PRIOR words
of every history from the next shorter one, and at the bottom one more of every word and of unknown ones:

    p(w) = (c(w) + 1) / (N + V + 1)        p(w|h) = (c(hw) + PRIOR * p(w|h')) / (c(h) + PRIOR)

so a state needs counts only, and each state's probabilities sum to one. A text is walked once from left to
right: the state is carried, failure arcs and word arcs add to the score.

The model grows with the corpus, so no task holds it. Documents are dealt into blocks of about BLOCK_BYTES by a
hash. A block asks for the counts of its own distinct n-grams: sorted keys, packed by part of the key range, one
row for each part. A part adds up what training counted of each key and answers every block; a block that has
its answers holds the piece of the automaton that its texts can reach. An n-gram that stands in every document
is asked for once a block, so no key is hot; the number of parts grows with the input. Words are named by 96
bits of a hash, which keeps counts of words right; longer n-grams by 64.

Defined results: a null text reads as empty and consists of the end alone; a null doc_id is kept; equal rows are
scored alike, count each, and lie in one block; without training texts every probability of a word is 1; an
empty table gives no rows; further columns are not read. A text longer than a block makes a block larger.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.session import bounded_batches

from .common import flat, mixed

ORDER = 2
PRIOR = 16.0
BLOCK_BYTES = 8_000_000
PART_BLOCKS = 2  # how many blocks' n-grams a part adds up, about

BEGIN, END = 0, 1  # numbers of the two marks in every block; their names cannot be words
MARKS = (b" begin", b" end")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Grams:
    """The distinct n-grams of one length in a block."""

    keys: np.ndarray  # sorted
    checks: np.ndarray | None  # 32 more bits, of words only
    trained: np.ndarray  # how often training texts of the block have each
    at: np.ndarray  # which one ends at each token; -1 where the document is too short


@dataclass
class Block:
    first: np.ndarray  # where each document begins (its mark)
    words: np.ndarray  # number of the word at each token
    grams: list[Grams]


def read(texts: list[str | None], training: list[bool], order: int) -> Block:
    names = dict(zip(MARKS, range(2)))
    words: list[int] = []
    first = []
    for text in texts:
        first.append(len(words))
        words.append(BEGIN)
        for word in (text or "").encode("utf-8", "surrogatepass").lower().split():  # bytes: ASCII letters, ASCII space
            words.append(names.setdefault(word, len(names)))
        words.append(END)
    at = np.array(words, np.int32)
    del words
    first = np.array(first, np.int64)
    sizes = np.diff(np.append(first, len(at)))
    counted = np.repeat(np.array(training, bool), sizes)
    place = np.arange(len(at), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
    digests = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in names), "<u8").reshape(-1, 2)
    named, checks = digests[:, 0].astype(np.uint64), (digests[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    ranks = np.lexsort((checks, named))
    found = [Grams(named[ranks], checks[ranks], np.bincount(at[counted], minlength=len(names))[ranks], np.argsort(ranks).astype(np.int32)[at])]
    before, number = named, at  # keys and numbers of n-grams one shorter, by number
    for n in range(2, order + 1):
        ends = np.flatnonzero(place >= n - 1)
        codes, own = np.unique(number[ends - 1].astype(np.int64) * len(names) + at[ends], return_inverse=True)
        joined = mixed(before[codes // len(names)] * FACTOR + named[codes % len(names)] + np.uint64(n))
        keys, same = np.unique(joined, return_inverse=True)
        number = np.full(len(at), -1, np.int32)
        number[ends] = same[own]
        trained = np.bincount(number[ends][counted[ends]], minlength=len(keys))
        found.append(Grams(keys, None, trained, number))
        before = keys
    return Block(first, at, found)


def planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all first bytes first: what is mostly zero lies together, for the shuffle to compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def numbers(body: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1).T).view(kind).ravel()


ASK = "block long, part long, n int, keys binary, checks binary, trained binary"
ANSWER = "block long, part long, n int, counts binary"


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def asks(block: Block, name: int, parts: int) -> pa.Table:
    """The block's n-grams, one row for each part and length that it has any of."""
    rows = []
    for n, grams in enumerate(block.grams, 1):
        part, begin = np.unique(part_of(grams.keys, parts), return_index=True)
        for p, a, z in zip(part.tolist(), begin.tolist(), [*begin[1:].tolist(), len(grams.keys)]):
            steps = np.diff(grams.keys[a:z], prepend=np.uint64(0))
            checks = None if grams.checks is None else planes(grams.checks[a:z])
            rows.append((name, p, n, planes(steps), checks, planes(grams.trained[a:z].astype(np.uint32))))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "part", "n", "keys", "checks", "trained"])


def added_up(part: pa.Table, n: int) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of one part and length: blocks, for each block the numbers of its n-grams, all counts, all keys."""
    rows = [r for r in zip(*(part.column(c).to_pylist() for c in ("n", "block", "keys", "checks", "trained"))) if r[0] == n]
    own = [np.cumsum(numbers(r[2], np.uint64), dtype=np.uint64) for r in rows]
    keys = flat(own, np.uint64)
    trained = flat((numbers(r[4], np.uint32) for r in rows), np.uint32)
    if n == 1:
        checks = flat((numbers(r[3], np.uint32) for r in rows), np.uint32)
        order = np.lexsort((checks, keys))
        new = np.ones(len(keys), bool)
        new[1:] = (np.diff(keys[order]) != 0) | (np.diff(checks[order]) != 0)
        inverse = np.empty(len(keys), np.int64)
        inverse[order] = np.cumsum(new) - 1
        distinct = keys[order][new]
    else:
        distinct, inverse = np.unique(keys, return_inverse=True)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, inverse, trained)
    ends = np.cumsum([len(x) for x in own]) if own else np.zeros(0, np.int64)
    return [r[1] for r in rows], np.split(inverse, ends[:-1]) if rows else [], counts, distinct


def answers(part: pa.Table) -> pa.Table:
    name = part.column("part")[0].as_py()
    rows = []
    for n in sorted(set(part.column("n").to_pylist())):
        blocks, own, counts, _ = added_up(part, n)
        rows += [(b, name, n, planes(counts[mine].astype(np.uint64))) for b, mine in zip(blocks, own)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["block", "part", "n", "counts"])


def word_totals(part: pa.Table) -> pa.Table:
    """Tokens and distinct tokens of training in one part; the mark of the beginning is no token."""
    _, _, counts, keys = added_up(part, 1)
    begin = np.frombuffer(blake2b(MARKS[BEGIN], digest_size=16).digest(), "<u8")[0]
    counts = counts[keys != begin]
    return pa.table({"tokens": [int(counts.sum())], "distinct": [int((counts > 0).sum())]})


def walk(block: Block, counts: list[np.ndarray], total: int, prior: float) -> list[float]:
    """Each document's score: one traversal from left to right that carries the state's length."""
    order = len(counts)
    seen, arc, failure = [], [], []  # by length of the n-gram that ends at a token
    p = (counts[0][block.grams[0].at] + 1) / total
    for n in range(1, order + 1):
        at = block.grams[n - 1].at
        c = np.where(at >= 0, counts[n - 1][at], 0) if len(counts[n - 1]) else np.zeros(len(at))
        if n > 1:
            left = np.roll(context, 1)  # noqa: F821 - count of the history, which ends one token before
            p = np.where(left > 0, (c + prior * p) / (left + prior), p)
        seen.append(c > 0)
        arc.append(np.log10(p))
        failure.append(np.log10(prior / (c + prior)))
        context = c
    scores = []
    bounds = [*block.first.tolist(), len(block.words)]
    for first, last in zip(bounds, bounds[1:]):
        met, weight, fall = ([x[first:last].tolist() for x in y] for y in (seen, arc, failure))
        state = 1 if order > 1 and met[0][0] else 0  # words of the history; the mark of the beginning is one
        score = 0.0
        for i in range(1, last - first):
            while state and not met[state][i]:
                score += fall[state - 1][i - 1]
                state -= 1
            score += weight[state][i]
            state = min(state + 1, order - 1) if met[state][i] else 0
        scores.append(score)
    return scores


def in_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list]]:
    """Texts and training marks of a stream, gathered up to a size."""
    texts, marks, held = [], [], 0
    for batch in batches:
        for text, training in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.append(text)
            marks.append(training)
            held += len(text or "")
            if held >= size:
                yield texts, marks
                texts, marks, held = [], [], 0
    if texts:
        yield texts, marks


def vocabulary_size(docs: DataFrame, parts: int) -> tuple[int, int]:
    """(tokens, distinct tokens) of the training texts; two numbers come to the driver."""
    size = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (texts, marks) in enumerate(in_blocks(batches, size)):
            yield from asks(read(texts, marks, 1), number, parts).to_batches()

    asked = docs.where("training").select("text", "training").mapInArrow(run, ASK).select("block", "part", "n", "keys", "checks", "trained")
    sums = asked.groupBy("part").applyInArrow(word_totals, "tokens long, distinct long").agg(F.sum("tokens"), F.sum("distinct")).first()
    return sums[0] or 0, sums[1] or 0


RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, training: Column, order: int | None = None, prior: float | None = None) -> DataFrame:
    """For every document its tokens, the score of single words and that of the model learnt where ``training`` holds."""
    bounded_batches(docs.sparkSession)
    order, prior = order or ORDER, prior or PRIOR
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(training, F.lit(False)).alias("training"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))
    parts = math.ceil(n_blocks / PART_BLOCKS)
    tokens, distinct = vocabulary_size(docs, parts)
    total = tokens + distinct + 1

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        block = read(rows.column("text").to_pylist(), rows.column("training").to_pylist(), order)
        return asks(block, key[0].as_py(), parts)

    def answer(rows: pa.Table) -> pa.Table:
        return answers(rows)

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        block = read(rows.column("text").to_pylist(), rows.column("training").to_pylist(), order)
        lists = sorted(zip(*(told.column(c).to_pylist() for c in ("n", "part", "counts"))))
        counts = [flat((numbers(c, np.uint64) for k, _, c in lists if k == n), np.uint64).astype(np.int64) for n in range(1, order + 1)]
        del lists
        of_word = counts[0][block.grams[0].at]
        token = block.words != BEGIN
        by_document = lambda x: np.add.reduceat(np.where(token, x, 0), block.first) if len(block.first) else x[:0]
        found = {
            "doc_id": rows.column("doc_id"),
            "n_tokens": by_document(np.ones(len(of_word), np.int64)),
            "n_known": by_document((of_word > 0).astype(np.int64)),
            "train_tokens": np.full(len(block.first), tokens),
            "base_score": by_document(np.log10((of_word + 1) / total)),
            "score": np.array(walk(block, counts, total, prior), float),
        }
        return pa.table(found)

    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))
    asked = dealt.groupBy("block").applyInArrow(ask, ASK)
    told = asked.groupBy("part").applyInArrow(answer, ANSWER)
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, RESULT)
