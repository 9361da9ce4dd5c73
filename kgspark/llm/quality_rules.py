"""Quality rules with distribution divergence: a document against the languages' usual distributions.

The reference of a language is counted over all documents that carry its name: the share of each character
class, and the share of each of its COMMON most frequent words (the rest in one bin). A document is compared
with every reference by Jensen-Shannon distance, in bits, and the nearest language decides; documents with
fewer words than a guard are not judged by that histogram. Simple counts (words, symbols, repeated lines,
repeated word windows) fail a document before that.

Counts over the corpus leave a task as one row for each language and word. Defined results: a null text has no
words; rows without a language are judged, and teach nothing; without any reference no divergence fails a
document; repeated rows are judged alike and count each; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.session import bounded_batches, stored

from .common import rows_of

COMMON = 100
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent
CLASS_GUARD = 50  # words from which the class histogram is read
WORD_GUARD = 100
CLASS_LIMIT = 0.30  # Jensen-Shannon distance, 0 to 1
WORD_LIMIT = 0.50
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
FLUSH = 200_000  # words that a task gathers before it passes their counts on

# fixed values: the character classes of bytes, in this order
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "mark", "letter outside ASCII", "control")


def byte_classes() -> np.ndarray:
    of = np.full(256, len(CLASSES), np.int64)  # bytes inside a character belong to none
    of[:32] = of[127] = 8
    of[33:127] = 6
    for members, c in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), ((9, 10, 11, 12, 13, 32), 3), (b".,;:!?", 4), (b"#*$%&|<>", 5), (range(0xC0, 256), 7)):
        of[list(members)] = c
    return of


OF_BYTE = byte_classes()


def class_counts(text: str) -> np.ndarray:
    body = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.bincount(OF_BYTE, weights=np.bincount(body, minlength=256), minlength=len(CLASSES) + 1)[: len(CLASSES)]


def bare(word: str) -> str:
    """The form of a word that is counted: lower case, without marks at its ends."""
    return word.strip(".,;:!?\"'()").lower()


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms: 0 for equal ones, 1 for those without a common bin."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def references(docs: DataFrame, common: int = COMMON) -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """language: class histogram, place of each common word, word histogram (its last bin is all other words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[str, str], int] = Counter()
        classes: dict[str, np.ndarray] = {}

        def batch_of(rows) -> pa.RecordBatch:
            lang, item, n = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(item, pa.string()), pa.array(n, pa.int64())], names=["lang", "item", "n"])

        for batch in batches:
            for part in rows_of(batch):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    classes[lang] = classes.get(lang, 0) + class_counts(text)
                    for word, n in Counter(WORD.findall(text)).items():
                        words[lang, bare(word)] += n
                if len(words) > FLUSH:
                    yield batch_of([(lang, "w" + w, n) for (lang, w), n in words.items()])
                    words = Counter()
        yield batch_of([(lang, "w" + w, n) for (lang, w), n in words.items()])
        yield batch_of([(lang, f"c{i}", int(n)) for lang, row in classes.items() for i, n in enumerate(row)])

    bounded_batches(docs.sparkSession)
    known = docs.select("text", "lang").where("text is not null and lang is not null")
    counted = stored(known.mapInArrow(run, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")), "rule-counts")
    is_word = F.col("item").startswith("w")
    top = W.partitionBy("lang").orderBy(F.desc("n"), "item")
    first = counted.where(is_word & (F.length("item") > 1)).withColumn("no", F.row_number().over(top)).where(F.col("no") <= common)
    totals = counted.where(is_word).groupBy("lang").agg(F.sum("n").alias("n"))
    # what the driver holds: for each language its classes, its common words and one sum
    classes = {}
    for r in counted.where(~is_word).collect():
        classes.setdefault(r["lang"], np.zeros(len(CLASSES)))[int(r["item"][1:])] = r["n"]
    words: dict[str, list] = {}
    for r in first.orderBy("lang", "no").collect():
        words.setdefault(r["lang"], []).append((r["item"][1:], r["n"]))
    found = {}
    for r in totals.orderBy("lang").collect():
        own = words.get(r["lang"], [])
        counts = np.array([n for _, n in own] + [r["n"] - sum(n for _, n in own)], float)
        if counts.sum() and classes[r["lang"]].sum():
            found[r["lang"]] = (classes[r["lang"]], {w: i for i, (w, _) in enumerate(own)}, counts)
    return found


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first included."""
    if len(words) <= width:
        return 0
    ids: dict[str, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    n = len(at) - width + 1
    code = at[:n]
    for k in range(1, width):
        code = np.unique(code, return_inverse=True)[1] * len(ids) + at[k : k + n]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(len(at) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.minimum(np.flatnonzero(twice) + width, len(at)), -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def judged(docs: DataFrame, usual: dict, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """The counts, the divergences from the nearest language (null below the guards or without references) and the verdict."""
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, class_divergence double, word_divergence double, kept boolean"
    )
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]
    languages = list(usual.values())

    def measure(text: str) -> tuple:
        words = WORD.findall(text)
        seen, again = set(), 0
        for line in text.split("\n"):
            if line in seen:
                again += bool(WORD.search(line))
            seen.add(line)
        repeats = repeated_words(words)
        failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(words)
        of_class = of_words = None
        if languages and len(words) >= CLASS_GUARD:
            own = class_counts(text)
            of_class = min(divergence(own, c) for c, _, _ in languages)
        if languages and len(words) >= WORD_GUARD:
            counts = Counter(map(bare, words))
            gaps = []
            for _, place, reference in languages:
                own = np.zeros(len(reference))
                for w, i in place.items():
                    own[i] = counts.get(w, 0)
                own[-1] = len(words) - own.sum()
                gaps.append(divergence(own, reference))
            of_words = min(gaps)
        kept = not failed and (of_class is None or of_class <= class_limit) and (of_words is None or of_words <= word_limit)
        return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), again, repeats, failed, of_class, of_words, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 256):
                rows = [measure(t or "") for t in part.column(1).to_pylist()]
                columns = [part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:]))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
