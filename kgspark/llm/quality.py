"""Quality scores by a regularised quadratic discriminant over transformed document statistics.

A document becomes WIDTH numbers (shares as log odds, counts as logs) from its whole text. Each class has a
mean and a covariance, shrunk towards the pooled one and towards a sphere; the score is the log density
difference, from Mahalanobis distances through cached Cholesky factors, with the classes' frequencies and a
scale fitted on documents kept apart. Means and covariances are fitted on a bounded sample of labelled rows.

Defined results: a null text is empty, and an empty text has the statistics of nothing and is scored like
others; with labels of one class only, or none, that class's share (or one half) is every score; repeated
rows are scored alike; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import bounded_batches, stored

from .common import rows_of

SAMPLE = 8000  # labelled documents of each class at most; a bound of the fit, scores read everything
THRESHOLD = 0.3
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0xC3:] = True  # bytes that begin a letter outside ASCII count as letters
SEEN = np.ones(256, bool)
SEEN[0x80:0xC0] = False  # bytes inside a character


def odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    body = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    chars = int(counts[SEEN].sum())
    letters, upper = int(counts[LETTER].sum()), int(counts[65:91].sum())
    digits, symbols = int(counts[48:58].sum()), int(counts[SYMBOLS].sum())
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) - symbols
    share = counts[counts > 0] / max(1, len(body))
    words = body.split()
    of_word = Counter(words)
    most = max(of_word.values(), default=0)
    once = sum(1 for n in of_word.values() if n == 1)
    lines = [x for x in body.split(b"\n") if x.strip()]
    packed = len(zlib.compress(body, 1))
    return [
        float(np.log1p(len(words))),
        float(np.log1p(letters / max(1, len(words)))),
        odds(upper, max(letters, upper)),
        odds(digits, chars),
        odds(symbols, chars),
        odds(marks, chars),
        odds(int(counts[33]), chars),
        odds(letters, chars),
        odds(len(of_word), len(words)),
        odds(most, len(words)),
        odds(once, len(words)),
        odds(len(set(lines)), len(lines)),
        float(np.log1p(len(lines))),
        float(-(share * np.log2(share)).sum()),
        float(np.log((packed + 20) / (len(body) + 20))),
        float(np.log1p(max(map(len, of_word), default=0))),
    ]


WIDTH = len(statistics(""))


def described(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats``, one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 256):
                stats = [statistics(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Discriminant:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse Cholesky factors of the class covariances
    logs: list[float]  # log of the class share less half the log determinant
    scale: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        log = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.logs)]
        return log[1] - log[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), 1 / (1 + np.exp(-self.shift)))
        return 1 / (1 + np.exp(-np.clip(self.scale * self.difference(x) + self.shift, -30, 30)))


def discriminant(x: np.ndarray, y: np.ndarray, pooled: float, sphere: float) -> Discriminant:
    parts = [x[y == c] for c in (0, 1)]
    means = [p.mean(0) for p in parts]
    spreads = [(p - m).T @ (p - m) / len(p) for p, m in zip(parts, means)]
    common = sum(s * len(p) for s, p in zip(spreads, parts)) / len(x)
    factors, logs = [], []
    for spread, part in zip(spreads, parts):
        mixed = (1 - pooled) * spread + pooled * common
        mixed = (1 - sphere) * mixed + sphere * np.eye(len(mixed)) * np.trace(mixed) / len(mixed) + 1e-9 * np.eye(len(mixed))
        root = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(root))
        logs.append(float(np.log(len(part) / len(x)) - np.log(np.diag(root)).sum()))
    return Discriminant(means, factors, logs)


def learn(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Discriminant:
    """Shrinkage, scale and shift are those with the least log loss on a quarter of the rows, kept apart."""
    if len(set(y.tolist())) < 2 or min(np.bincount(y)) < 8:
        return Discriminant([], [], [], shift=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    order = np.random.default_rng(seed).permutation(len(y))
    apart, rest = order[::4], np.setdiff1d(order, order[::4])
    best = None
    for pooled in (0.0, 0.1, 0.3, 0.6, 1.0):
        for sphere in (0.001, 0.01, 0.05, 0.2):
            model = discriminant(x[rest], y[rest], pooled, sphere)
            raw = model.difference(x[apart])
            for scale in (0.05, 0.1, 0.2, 0.35, 0.6, 1.0):
                for shift in (-2.0, -1.0, 0.0, 1.0, 2.0):
                    z = np.clip(scale * raw + shift, -30, 30)
                    loss = np.logaddexp(0, np.where(y[apart] == 1, -z, z)).mean()
                    if best is None or loss < best[0] - 1e-9:
                        best = (loss, pooled, sphere, scale, shift)
    model = discriminant(x, y, *best[1:3])
    model.scale, model.shift = best[3:]
    return model


def fit(stats: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Discriminant:
    """``stats`` as of ``described``; ``labels`` has doc_id and quality (0, 1; others teach nothing)."""
    rows = stats.join(labels.select("doc_id", "quality").where("quality in (0, 1)"), "doc_id")
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}  # two rows
    spread, keep = 1 << 24, F.lit(False)
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(spread))
    for c, n in counts.items():
        keep = keep | ((F.col("quality") == c) & (place < min(spread, spread * per_class // n)))
    found = sorted((r["doc_id"], r["quality"], r["stats"]) for r in rows.where(keep).collect())
    x = np.array([r[2] for r in found], float).reshape(-1, WIDTH)
    return learn(x, np.array([r[1] for r in found], np.int64))


def scored(stats: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, WIDTH)
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Learns from ``labels`` and scores every row of ``docs``."""
    stats = stored(described(docs), "quality-stats")
    return scored(stats, fit(stats, labels, per_class), threshold)
