"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word stands for itself and for its character n-grams, each hashed to a row of an embedding table; a
document is the average of all rows of all its words, whole text. Training is stochastic gradient descent
in numpy on a bounded sample of labelled documents; a temperature is then fitted on documents kept apart,
and the least probability a prediction may have is set from them. A word's share of the scores depends on
the word alone, so tasks look words up and add.

Defined results: a text that is null or has no letter is UNKNOWN with score 0 and rejected; a model without
training rows predicts UNKNOWN for all; repeated rows are predicted alike; an empty table gives no rows;
further columns are not read. Equal scores go to the first language by name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import bounded_batches

from .common import mixed, rows_of

UNKNOWN = "und"
ROWS = 1 << 15
WIDTH = 16
GRAMS = (2, 3, 4)
SAMPLE = 600  # training documents of each language at most; a bound of the fit, predictions read everything
CACHE = 600_000  # words that a worker keeps; a bound of memory, not of the text
LETTERS = 16 * CACHE  # and of the letters in them
TAKEN = 1 << 18  # letters that are made n-grams of at once, besides those of one word
WORD = re.compile(r"[^\W\d_]+")
OUTPUT = "doc_id long, lang_pred string, score double, rejected boolean"


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case. What the pattern takes besides (such as a half or a superscript) only parts them."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for w in found for c in f"{w} ").split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, row of the table) for each word and each of its n-grams.

    An n-gram's row is a hash of its code points; the words stand in one array, each between two marks.
    """
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array(list(map(len, marked)), np.int64)
    place = np.repeat(np.arange(len(words)), sizes)
    till = np.cumsum(sizes)[place]
    places, rows = [np.arange(len(words))], [np.array([xxhash.xxh32_intdigest(m.encode("utf-8", "surrogatepass")) % ROWS for m in marked], np.int64)]
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(code) < n:
                continue
            hashed = np.full(len(code) - n + 1, np.uint64(n))
            for k in range(n):
                hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + code[k : k + len(hashed)]
            inside = np.arange(len(hashed)) + n <= till[: len(hashed)]
            places.append(place[: len(hashed)][inside])
            rows.append((mixed(hashed[inside]) % np.uint64(ROWS)).astype(np.int64))
    return np.concatenate(places), np.concatenate(rows)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table and their shares in the document's average."""
    words = Counter(words_of(text))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    place, found = subwords(list(words))
    rows, inverse = np.unique(found, return_inverse=True)
    weight = np.bincount(inverse, np.array(list(words.values()), float)[place])
    return rows, weight / weight.sum()


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    """``table``: each row's share of the class scores, that is embedding times output weights."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def probabilities(self, totals: np.ndarray) -> np.ndarray:
        return softmax((totals + self.bias) / self.temperature)


def train(texts: list[str], languages: list[str], epochs: int = 6, rate: float = 0.6, seed: int = 7, rejected: float = 0.001) -> Model:
    """One document in five calibrates; the others are visited one at a time in a random order.

    ``rejected``: the share of correctly predicted calibration documents that the least probability may cost.
    """
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((ROWS, 0), np.float32), np.zeros(0))
    draw = np.random.default_rng(seed)
    bags = [bag(t) for t in texts]
    label = np.array([names.index(x) for x in languages])
    usable = draw.permutation([i for i, (rows, _) in enumerate(bags) if len(rows)])
    apart = usable[: len(usable) // 5]
    learned = usable[len(apart) :]
    embedding = np.zeros((ROWS, WIDTH))  # rows that no training word meets stay at zero and speak for no language
    output, bias = draw.normal(0, 1, (WIDTH, len(names))), np.zeros(len(names))
    steps, step = max(1, epochs * len(learned)), 0
    for _ in range(epochs):
        for i in draw.permutation(learned):
            rows, share = bags[i]
            now = rate * (1 - step / steps)
            step += 1
            hidden = share @ embedding[rows]
            error = softmax(hidden @ output + bias)
            error[label[i]] -= 1
            back = output @ error
            output -= now * np.outer(hidden, error)
            bias -= now * error
            embedding[rows] -= now * len(rows) ** 0.5 * share[:, None] * back[None, :]
    model = Model(names, (embedding @ output).astype(np.float32), bias)
    if len(apart):
        totals = np.array([bags[i][1] @ model.table[bags[i][0]] for i in apart])
        target = np.full((len(apart), len(names)), 1 / (len(apart) + 2) / len(names))  # never quite sure, however many were right
        target[np.arange(len(apart)), label[apart]] += 1 - target.sum(1)
        loss = lambda t: -(target * np.log(softmax((totals + bias) / t) + 1e-300)).sum()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        sure = model.probabilities(totals)
        right = sure.argmax(1) == label[apart]
        if right.any():
            model.least = float(min(np.quantile(sure.max(1)[right], rejected), max(0.4, 1.5 / len(names))))  # few languages share more probability
    return model


def sample(labelled: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """Up to about ``per_language`` documents of each language, chosen by a hash of the id."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    spread = 1 << 24
    place = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(spread))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (place < min(spread, spread * per_language // n)))
    return labelled.where(keep)


def fit(labelled: DataFrame, per_language: int = SAMPLE) -> Model:
    """From rows with doc_id, text and lang; texts or languages that are null teach nothing."""
    rows = sample(labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null"), per_language)
    found = sorted(rows.collect(), key=lambda r: (r["lang"], r["doc_id"] or 0, r["text"]))
    return train([r["text"] for r in found], [r["lang"] for r in found])


class Reader:
    """text to (place of its language, probability), or None; keeps the words it has looked up.

    ``sums`` has a line for each known word: its rows' shares of the scores, and how many rows it has.
    """

    def __init__(self, model: Model):
        self.model, self.known, self.letters = model, {}, 0
        self.sums = np.zeros((CACHE, len(model.languages) + 1))

    def full(self, words: Collection[str]) -> bool:
        return len(self.known) + len(words) > len(self.sums) or self.letters + sum(map(len, words)) > LETTERS

    def look_up(self, words: list[str]) -> None:
        if self.full(words):
            self.known.clear()
            self.letters = 0
            if len(words) > len(self.sums):
                self.sums = np.zeros((len(words), self.sums.shape[1]))
        at = len(self.known)
        ends = np.cumsum(list(map(len, words))) // TAKEN
        for own in np.split(np.arange(len(words)), np.flatnonzero(np.diff(ends)) + 1):
            place, rows = subwords(words[own[0] : own[-1] + 1])
            for k in range(len(self.model.languages)):
                self.sums[at + own, k] = np.bincount(place, self.model.table[rows, k], len(own))
            self.sums[at + own, -1] = np.bincount(place, minlength=len(own))
        self.letters += sum(map(len, words))
        self.known.update(zip(words, range(at, at + len(words))))

    def read(self, texts: list[str | None]) -> list[tuple[int, float] | None]:
        split = [words_of(t) if t and self.model.languages else () for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            if self.full(new):
                new = set().union(*split)  # all are forgotten
            self.look_up(sorted(new))
        out: list[tuple[int, float] | None] = []
        for words in split:
            if not words:
                out.append(None)
                continue
            sums = self.sums[list(map(self.known.__getitem__, words))].sum(0)
            p = self.model.probabilities(sums[:-1] / sums[-1])
            best = int(p.argmax())
            out.append((best, float(p[best])))
        return out


READERS: dict[int, Reader] = {}


def reader(model: Model) -> Reader:
    """One per Python worker and model, so that words learned in one task serve the next."""
    stamp = xxhash.xxh32_intdigest(model.table.tobytes())
    if stamp not in READERS:
        READERS.clear()
        READERS[stamp] = Reader(model)
    return READERS[stamp]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability), rejected."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of ROWS rows, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in rows_of(batch):
                found = reader(own).read(part.column(1).to_pylist())
                names = [own.languages[f[0]] if f else UNKNOWN for f in found]
                refused = [not f or f[1] < own.least for f in found]
                columns = [part.column(0), pa.array(names, pa.string()), pa.array([f[1] if f else 0.0 for f in found], pa.float64()), pa.array(refused, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUTPUT)


def recognized(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                found = reader(sent.value).read(part.column("text").to_pylist())
                yield part.filter(pa.array([bool(f) and f[1] >= sent.value.least for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
