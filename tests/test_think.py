"""Pieces of think blocks against the whole text."""

import random
import re

import pytest

from kgspark.operators import think

BLOCK = re.compile(r"(?s)<think>(.*?)</think>")


def drawn(draw, n):
    parts = ["<think>", "</think>", "<", "</", "<thi", "think>", "a", "b\n", "", "<</think>", "x" * 9]
    return "".join(draw.choice(parts) for _ in range(n))


def cut(draw, text):
    places = sorted(draw.choices(range(len(text) + 1), k=draw.randint(0, len(text)))) if text else []
    return [text[a:z] for a, z in zip([0, *places], [*places, len(text)])]


@pytest.mark.parametrize("seed", range(30))
def test_maps_compose(seed):
    """Any cut of the chunks into runs leads through the same states as all of them."""
    draw = random.Random(seed)
    chunks = cut(draw, drawn(draw, 30))
    for state in think.STATES:
        at, opened = state, 0
        for chunk in chunks:
            at, pieces = think.step(at, chunk)
            opened += sum(kind == think.OPEN for _, kind, _ in pieces)
        number, total = think.NUMBER[state], 0
        for _ in range(3):
            k = draw.randint(0, len(chunks))
            number, total = think.NUMBER[state], 0
            for run in (chunks[:k], chunks[k:]):
                made = think.Map()
                for chunk in run:
                    made.feed(chunk)
                ends, opens = made.columns()
                number, total = ends[number], total + opens[number]
            assert (think.STATES[number], total) == (at, opened)


def expected(text):
    return BLOCK.sub("", text), [b for b in BLOCK.findall(text)]


def put_together(rows):
    outside = "".join(r.text for r in rows if r.block is None)
    blocks = {}
    for r in rows:
        if r.block is not None:
            blocks[r.block] = blocks.get(r.block, "") + r.text
    return outside, blocks


def test_pieces_equal_the_whole_text(spark):
    draw = random.Random(77)
    streams = {(f"s{i}" if i else None, i % 3): drawn(draw, draw.choice([0, 3, 12, 40])) for i in range(60)}
    streams["hot", 0] = drawn(draw, 900)
    rows = []
    for (name, part), text in streams.items():
        chunks = list(text) if part == 1 else cut(draw, text)
        rows += [(name, part, i * 3, chunk) for i, chunk in enumerate(chunks)] + [(name, part, 10**6, None)]
    frame = spark.createDataFrame(rows, "name string, part int, seq long, text string").withColumnRenamed("part", "no").repartition(5)
    for width in (10**9, 50, 4):
        found = {}
        for r in think.think_pieces(frame, ["name", "no"], think.F.floor(think.F.col("seq") / width)).collect():
            found.setdefault((r.name, r.no), []).append(r)
        for key, text in streams.items():
            outside, blocks = put_together(sorted(found.get(key, []), key=lambda r: (r.seq, r.part)))
            plain, inside = expected(text)
            assert outside == plain, key
            assert {k: v for k, v in blocks.items()} == {i: b for i, b in enumerate(inside, 1) if b}


def test_no_chunks(spark):
    frame = spark.createDataFrame([], "name string, seq long, text string")
    assert think.think_pieces(frame, ["name"], think.F.lit(0)).count() == 0
