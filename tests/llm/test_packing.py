import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from kgspark.llm import packing, queries

FOLDER = "/root/testdata/sf0.001"


def plain_ids(text, tokenizer=[]):
    if not tokenizer:
        tokenizer.append(Tokenizer.from_file(queries.vocabulary()))
    return tokenizer[0].encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer():
    code = packing.Encoder(queries.vocabulary())
    draw = random.Random(3)
    signs = ["a", "Z", "é", "É", "é", "́", "ß", "İ", "Σ", "σ", "7", "'", "s", "'s", "'LL", ".", "<|", "|>", "<|endoftext|>", "<|startoftext|>", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "\0", "漢", "\U0001f600", "½", "²", "ª", "º", "µ", "×", "÷", "Ÿ", "À", "Ð", "ð", "Þ", "ÿ", "¡", "­", "\x1f", "\x1d", "\u2028", "\u180e", "\ufeff", "ñ", "_", "#", "don't", "K"]
    texts = ["".join(draw.choices(signs, k=draw.randrange(0, 25))) for _ in range(12000)]
    for text in texts:
        assert np.frombuffer(code.encode(text), "<u4").tolist() == plain_ids(text), repr(text)


def test_lengths():
    for n in range(1, 200):
        found = packing.lengths(n, 32)
        assert sum(found) == n and all(x & (x - 1) == 0 and x <= 32 for x in found) and found == sorted(found, reverse=True)


def whole(pieces, docs):
    by = defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
    want = defaultdict(list)
    for d in docs:
        want[d.doc_id].append(plain_ids(d.text) + [1])
    assert set(by) == set(want)
    for doc_id, ids in want.items():
        assert len({tuple(x) for x in ids}) == 1
        found = sorted(by[doc_id], key=lambda r: r.start)
        for copy in range(len(ids)):
            own, at = found[copy :: len(ids)], 0
            for r in own:
                assert r.start == at and r.doc_tokens == len(ids[0]) and r.offset == 0
                at += r.length
                yield r, np.array(ids[0][r.start : r.start + r.length], "<u4").tobytes()
            assert at == len(ids[0])
    assert len({r.sequence_id for r in pieces}) == len(pieces)


def test_query_holds_every_id_once(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    for row, ids in whole(queries.op3(spark, FOLDER).collect(), docs):
        assert row.ids_crc32 == zlib.crc32(ids) and row.length <= 2048


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    pieces = packing.pack(odd_docs, queries.vocabulary(), max_len=64)
    for row, ids in whole(pieces.collect(), odd_docs.collect()):
        assert bytes(row.ids) == ids and row.bucket == row.length
    packing.write_buckets(pieces, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == pieces.count()
    assert packing.pack(no_docs, queries.vocabulary()).count() == 0
