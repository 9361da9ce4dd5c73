"""Resampling by importance: documents whose runs of words are likelier in a target text than in the corpus.

A document is normalised once: its words in lower case, each after one separator. One scan stores the running
CRC-32 after every word; the running value of a word's beginning is one byte further than that of the word
before. With the CRC as a polynomial over GF(2), a run of words is the difference of two prefixes, the shorter
one shifted by the run's length (`shift`, by tables for 1, 2, 4, 8 ... bytes), so no run is ever built or read
a second time. Runs fall into BUCKETS by their CRC; a bucket's gain compares the target's share with the
corpus's, and a document is drawn by the sum of its runs' gains plus Gumbel noise that its id decides.

Counts of buckets leave a task as BUCKETS rows, so the driver gathers BUCKETS numbers whatever the input is. The
order of the draw is made of ranges of scores, one task each; a row's rank is its place in the range plus the
rows of earlier ranges. Scores and ranges are tables in the shared folder.

Defined results: a null text, or one without words, has no features and weight 0; a null doc_id draws its noise
from an empty id and comes last in ties; equal rows draw the same score and take successive ranks; texts longer
than PIECE bytes are worked on in pieces that hand on two words; without a target text all counts of it are 0;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import bounded_batches, stored

from .common import rows_of

BUCKETS = 10_000
LONGEST = 3  # words of a run
LEAST_WORDS = 20  # of a document that may be drawn
PIECE = 4_000_000  # bytes
SEED = 42

SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
NORMAL = bytes(x + 32 if 65 <= x <= 90 else 32 if x in SEPARATORS else x for x in range(256))
POLYNOMIAL = np.uint32(0xEDB88320)


def byte_steps() -> np.ndarray:
    """What a CRC register of one byte becomes when a zero byte follows."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), POLYNOMIAL, np.uint32(0))
    return table


STEP = byte_steps()
LOW = np.uint32(255)


def looked_up(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & LOW] ^ tables[1][(x >> np.uint32(8)) & LOW] ^ tables[2][(x >> np.uint32(16)) & LOW] ^ tables[3][x >> np.uint32(24)]


def shift_tables(levels: int = 32) -> list[np.ndarray]:
    """For each k the tables that shift by 2 ** k zero bytes."""
    x = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    found = [STEP[x & LOW] ^ (x >> np.uint32(8))]
    while len(found) < levels:
        single = found[-1]
        found.append(looked_up(single, single))
    return found


SHIFTS = shift_tables()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs moved on by so many bytes: what to cancel from a longer prefix's CRC."""
    out = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> k) & 1)
        out[at] = looked_up(SHIFTS[k], out[at])
    return out


def after_separator(crc: np.ndarray) -> np.ndarray:
    """The running CRCs one separator further."""
    register = ~crc
    return ~(STEP[(register ^ np.uint32(32)) & LOW] ^ (register >> np.uint32(8)))


class Prefixes:
    """Running CRCs of words of documents, one after the other: (crc at the beginning, crc at the end, length, document)."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, words: list[bytes], number: int, before: int = 0) -> int:
        pieces = [b" " + w for w in words]
        crcs = np.fromiter(accumulate(pieces, lambda crc, p: zlib.crc32(p, crc), initial=before), np.uint32, len(words) + 1)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.parts.append((after_separator(crcs[:-1]), crcs[1:], lengths, np.full(len(words), number)))
        return int(crcs[-1])

    def joined(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*self.parts))


def run_crcs(begin, end, length, document, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: place of the last word, CRC of the run."""
    moved = shift(begin, length)
    yield np.arange(len(end)), end ^ moved
    for n in range(1, longest):
        if len(end) <= n:
            return
        moved = shift(moved[: len(end) - n], length[n:] + 1)
        inside = np.flatnonzero(document[n:] == document[:-n])
        yield inside + n, end[inside + n] ^ moved[inside]


def cut(body: bytes, size: int) -> Iterator[bytes]:
    """The body in pieces that end between words."""
    at = 0
    while at < len(body):
        till = at + size
        till = len(body) if till >= len(body) else body.find(b" ", till)
        till = len(body) if till < 0 else till
        yield body[at:till]
        at = till


def features(texts: list[str | None], piece: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, buckets, documents of single words) of all runs; a document may come in several turns."""
    piece = piece or PIECE
    together = Prefixes()
    for number, text in enumerate(texts):
        body = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL)
        if len(body) <= piece:
            if words := body.split():
                together.add(words, number)
            continue
        crc, last = 0, None
        for part in cut(body, piece):
            if not (words := part.split()):
                continue
            here = Prefixes()
            if last:
                here.parts.append(last)
            crc = here.add(words, number, crc)
            arrays = here.joined()
            old = len(last[0]) if last else 0
            yield buckets_of(arrays, old)
            last = tuple(x[-(LONGEST - 1) :] for x in arrays)
    if together.parts:
        yield buckets_of(together.joined())


def buckets_of(arrays: tuple[np.ndarray, ...], old: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that end at word ``old`` or later, as (document, bucket), and the document of each such word."""
    document = arrays[3]
    found = [(at[at >= old], crc[at >= old]) for at, crc in run_crcs(*arrays)]
    at, crc = (np.concatenate(x) for x in zip(*found))
    return document[at], (crc % np.uint32(BUCKETS)).astype(np.int64), document[old:]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many runs of all texts fall into each bucket; texts has the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in rows_of(batch, 128):
                for _, buckets, _ in features(part.column(0).to_pylist()):
                    counts += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    bounded_batches(texts.sparkSession)
    counts = np.zeros(BUCKETS, np.int64)
    rows = texts.select("text").where("text is not null").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in rows.collect():  # at most BUCKETS rows
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all = int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 128):
                n = part.num_rows
                runs, weight, words = (np.zeros(n, np.int64) for _ in range(3))
                for document, buckets, of_word in features(part.column(1).to_pylist()):
                    runs += np.bincount(document, minlength=n)
                    words += np.bincount(of_word, minlength=n)
                    np.add.at(weight, document, gain[buckets])
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (words, runs, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED):
    """Gumbel noise that the seed and the id decide, in thousandths, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, per_cent: int = 5, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with its score, and its rank where it is among the drawn share of those that are long enough.

    ``target`` has the column ``text``; drawn are floor(per_cent * n / 100) of the n documents of at least
    ``least_words`` words, without replacement.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = stored(weighed(docs, gain).withColumn("score", F.col("weight") + noise(seed)), "resampling-scores")
    long_enough = F.col("n_words") >= least_words
    drawn = per_cent * scored.where(long_enough).count() // 100
    order = [F.desc("long_enough"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ranges = scored.withColumn("long_enough", long_enough).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranges = stored(ranges, "resampling-ranges")
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    offsets = ranges.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("range").orderBy(*order, "weight")) + F.col("before")
    rank = F.when(place <= drawn, place).cast("long").alias("rank")
    return ranges.join(offsets, "range").select("doc_id", "n_words", "n_features", "weight", "score", rank)
