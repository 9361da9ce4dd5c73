"""Packing by power-of-two decomposition: every document is cut into pieces of binary length.

A document of n tokens becomes n // max_len pieces of max_len and one piece for each bit of the rest,
longest first. A piece is a sequence of its own, so no sequence crosses documents and none is padded;
pieces of equal length form one bucket, from which batches of a fixed shape are drawn.

Tokenizing and cutting need nothing but the document, so no row is shuffled. Defined results: a null or
empty text is the end token alone; repeated rows are packed each for itself; an empty table gives no
pieces; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgspark.session import bounded_batches

from .common import rows_of

END = 1
MAX_LEN = 2048
CACHE = 800_000  # words; a bound of memory, not of the text
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


class Encoder:
    """A tokenizer of a vocabulary file whose words do not reach across white space, with a word cache.

    A text's ids are those of its words between white space. Words of letters, digits and signs of ASCII
    and Latin-1 are cut further as the vocabulary's own pattern cuts them, and each part goes to the
    tokenizer's model; all other words go to the tokenizer whole.
    """

    ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python, not to the vocabulary's pattern
    WORD = re.compile(r"[^ \t\n\r]+")
    PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-zß-öø-ÿ0-9]+")
    SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    # a byte's letter: itself where it is visible, else the next from 256 on
    HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    LETTERS = {b: 256 + i for i, b in enumerate(HIDDEN)}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def look_up(self, word: str) -> bytes:
        if self.SIMPLE.fullmatch(word) and "<|" not in word:
            found = b""
            for part in self.PLAIN.findall(word.lower()):
                ids = self.parts.get(part)
                if ids is None:
                    if len(self.parts) >= CACHE:
                        self.parts.clear()
                    letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.LETTERS)
                    ids = self.parts[part] = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
                found += ids
        else:
            found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 40:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        words = self.WORD.findall(text) if self.ODD_SPACE.search(text) else text.split()
        found = list(map(self.words.get, words))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self.look_up(words[at])
        return b"".join(found)


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so that words learned in one task serve the next."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """The piece lengths of a document of n tokens, longest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, ids (unsigned 32-bit, little-endian), sequence_id, offset, bucket."""
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, last = encoder(tokenizer_path), np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in rows_of(batch, 256):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = code.encode(text or "") + last
                    n, at = len(ids) // 4, 0
                    for length in lengths(n, max_len):
                        rows.append((doc_id, at, length, n, ids[4 * at : 4 * (at + length)]))
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)

    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, SCHEMA)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per piece length: all sequences of a batch drawn from it have the same shape."""
    pieces.write.mode("append").partitionBy("bucket").parquet(path)
