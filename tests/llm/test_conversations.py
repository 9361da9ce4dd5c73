import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import conversations, queries

FOLDER = "/root/testdata/sf0.01"
SPACE = "[\x20\x09-\x0D]"
COLUMNS = "conv_id long, turn long, role string, text string"


def damage(rows):
    """conv_id: its rows after damage, in order; written from the rule, without the operator."""
    found = {}
    for conv_id, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{show(conv_id)}:{show(turn)}".encode()) % 20
        role, text, own = show(role), show(text), found.setdefault(conv_id, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for own in found.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return found


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        last = re.sub(f"{SPACE}+\\Z", "", text)[-1:]
        found.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return found


def best(rows, kinds):
    """Least (cost, audit, lines) from every row and ending, by comparing whole strings."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    rest = {"": (0, "", []), "a": (0, "", []), "u": (3, "I", ["assistant:"]), "s": (6, "II", ["user:", "assistant:"])}
    for (_, role, text), fault in reversed(list(zip(rows, kinds))):
        here = {}
        last = re.sub(f"{SPACE}+\\Z", "", text)[-1:]
        broken = 3 if last and last not in ".!?" else 0
        for state, to in follows.items():
            options = [(4 + rest[state][0], "D" + rest[state][1], rest[state][2])]
            if fault not in ("blank", "duplicate"):
                name = {"u": "user", "a": "assistant"}[to]
                options.append((3 + broken + rest[to][0], "R" + rest[to][1], [f"{name}:{text}", *rest[to][2]]))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    k = role[:1]
                    options.append((broken + rest[k][0], "K" + rest[k][1], [f"{role}:{text}", *rest[k][2]]))
            here[state] = min(options)
        for _ in range(3):
            for state, to in follows.items():
                cost, audit, lines = here[to]
                name = {"u": "user", "a": "assistant"}[to]
                here[state] = min(here[state], (3 + cost, "I" + audit, [f"{name}:", *lines]))
        rest = here
    return rest[""]


def plain(rows):
    found = []
    for conv_id, own in damage(rows).items():
        kinds = faults(own)
        known = {t for t, _, _ in own if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = best(own, kinds)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        text = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found.append((conv_id, gaps, *(kinds.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, text))
    return sorted(found, key=str)


def listed(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_query_equals_plain(spark):
    rows = list(map(tuple, spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    found = queries.op11(spark, FOLDER)
    assert found.columns == [x.split()[0] for x in conversations.RESULT.split(", ")]
    assert listed(found) == plain(rows)


def drawn(seed, n, conversations_):
    draw = np.random.default_rng(seed)
    texts = ["Yes.", "no", "", "  ", "What? ", "Well.\n", "a. b", "...", "é!", "tail\x0b"]
    roles = ["user", "assistant", "system", "tool", "", "User"]
    return [(int(draw.integers(0, conversations_)), int(draw.integers(0, n)), str(draw.choice(roles, p=[0.3, 0.3, 0.2, 0.1, 0.05, 0.05])), str(draw.choice(texts))) for _ in range(n)]


ODD = [
    (None, None, None, None),
    (None, 3, "user", "Hello."),
    (900, None, "user", "Hello."),
    (900, None, "user", "Hello."),
    (900, 5, "assistant", "x" * 300_000 + "."),
    (900, 5, "assistant", "Again."),
    (900, -4, "system", "Be kind."),
]


def test_odd_rows_equal_plain(spark):
    rows = drawn(1, 600, 90) + ODD
    frame = spark.createDataFrame(rows, COLUMNS)
    clash = frame.select("*", *(F.lit("x").alias(n) for n in ("copies", "same", "first", "n_rows", "ns", "vectors", "range", "block", "at_first", "_conv")))
    assert listed(conversations.repaired(conversations.damaged(clash))) == plain(rows)
    assert conversations.repaired(conversations.damaged(frame.limit(0))).count() == 0


def test_long_conversations_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "LONG_ROWS", 5)
    monkeypatch.setattr(conversations, "LONG_BYTES", 200)
    rows = drawn(2, 1200, 4) + drawn(3, 200, 60) + ODD
    assert listed(conversations.repaired(conversations.damaged(spark.createDataFrame(rows, COLUMNS).repartition(5)))) == plain(rows)


@pytest.mark.parametrize("size", range(5))
def test_all_short_sequences(size):
    """Matrices of any grouping and the checkpointed walk, on every sequence of kinds."""
    kinds_of = (0, 2, 3, 4, 6, 7, 8)
    for kinds in product(kinds_of, repeat=size):
        kinds = bytes(kinds)
        vector = conversations.END
        for kind in reversed(kinds):
            vector = conversations.back(vector, kind)
        for at in range(size + 1):
            front, rear = conversations.matrix(kinds[:at]), conversations.matrix(kinds[at:])
            assert conversations.before(front, conversations.before(rear, conversations.END)) == vector
        steps = list(conversations.edits(kinds, conversations.END, conversations.START))
        assert sum(initial != "I" for initial, _ in steps) == size


def test_undamaged(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", None), (2, 1, None, "So.")]
    found = {r.conv_id: r for r in conversations.repaired(conversations.undamaged(spark.createDataFrame(rows, COLUMNS))).collect()}
    assert (found[1].cost, found[1].audit, found[1].illegal) == (0, "KK", 0)
    assert (found[2].blank, found[2].cost, found[2].audit) == (1, 8, "DD")
