"""Blocked scans must equal plain windows, whatever the blocks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kgspark.operators import ordered
from kgspark.operators.attempts import empty_outcomes, newest_attempts, numbered, outcomes, sufficiency_outcomes
from kgspark.operators.budget import (
    context_pack,
    dumped_length,
    json_length,
    limited,
    spaced_json_length,
    result_within_budget,
    within_budget,
)
from kgspark.operators.conversation import (
    chunk_summaries,
    coalesce_sections,
    content_chunks,
    split_thinking,
    stage_texts,
    turn_chunks,
)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, "a", "a", "a", "b"]), i, rng.choice([None, "x", "x", "y"]), rng.randint(0, 3))
            for i in range(500)]
    data += [("a", None, "x", 2), (None, None, None, 1)]  # rows without a place come first
    return spark.createDataFrame(data, "k string, at bigint, v string, n bigint").repartition(7)


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_blocked_scans(rows, width):
    block = F.floor(F.col("at") / width)
    plain = Window.partitionBy("k").orderBy("at")
    so_far = plain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = ["k"], ["at"], block
    summed = ordered.running_sum(rows, *key, F.col("n"), "s").exceptAll(rows.withColumn("s", F.sum("n").over(so_far)))
    assert summed.count() == 0
    before = ordered.previous(rows, *key, "v", "p").select("k", "at", "p.value")
    assert before.exceptAll(rows.select("k", "at", F.lag("v").over(plain))).count() == 0
    changed = F.when(F.row_number().over(plain) == 1, 1).when(F.lag("v").over(plain).eqNullSafe(F.col("v")), 0).otherwise(1)
    expected = rows.withColumn("c", changed).withColumn("r", F.sum("c").over(so_far)).drop("c")
    assert ordered.islands(rows, *key, "v", "r").exceptAll(expected).count() == 0
    kept = ordered.drop_repeats(rows, *key, "v")
    assert kept.exceptAll(rows.withColumn("c", changed).filter("c = 1").drop("c")).count() == 0
    assert kept.count() == expected.select("k", "r").distinct().count()


def test_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 1, 3000), (1, 2, 2500), (1, 3, 10), (2, 1, 5000), (2, 2, 7), (3, 1, 5001)],
                                 "q int, seq int, size int")
    for width in (None, 1, 2, 100):
        block = None if width is None else F.floor(F.col("seq") / width)
        kept = within_budget(rows, ["q"], ["seq"], F.col("size"), block=block)
        assert sorted((r.q, r.seq) for r in kept.collect()) == [(1, 1), (2, 1)]


def test_budget_keeps_all_small_rows(spark):
    rows = spark.range(3000).select(F.lit(1).alias("q"), F.col("id").alias("seq"), (F.col("id") % 2).alias("size"))
    kept = within_budget(rows, ["q"], ["seq"], F.col("size"), 1400, F.floor(F.col("seq") / 250))
    assert kept.count() == 2802 - 1
    assert result_within_budget(spark.range(3000), 100).count() == 11


def test_json_lengths(spark):
    import json

    data = [("plain", 1, None), ('q"\\\n\t\x7f/', -5, True), ("é😀中", 0, False)]
    rows = spark.createDataFrame(data, "a string, b int, c boolean")
    record = F.struct("a", "b", "c")
    found = rows.select("a", json_length(record).alias("native"), spaced_json_length(record, 3).alias("spaced"),
                        dumped_length(F.to_json(record, {"ignoreNullFields": "false"})).alias("dumped")).collect()
    expected = {a: len(json.dumps({"a": a, "b": b, "c": c})) for a, b, c in data}
    for row in found:
        assert row.spaced == row.dumped == expected[row.a]


def test_context_pack_and_limit(spark):
    results = spark.createDataFrame([(1, 1, "x" * 3000), (1, 2, "y" * 1000)], "question_id int, seq int, record string")
    extra = spark.createDataFrame([(1, 1, "z" * 900), (1, 2, "w" * 200)], "question_id int, seq int, record string")
    assert [len(r.record) for r in context_pack(results, extra).orderBy("part", "seq").collect()] == [3000, 1000, 900]
    assert limited(results, 1).count() == 1
    assert limited(results, 0).count() == limited(results, None).count() == limited(results, True).count() == 2


def test_attempts(spark):
    log = spark.createDataFrame(
        [(1, t, "e", 0) for t in range(1, 7)] + [(2, 1, "e", 0), (2, 2, None, 4), (3, 1, None, 0), (4, 1, "e", 0)],
        "question_id int, attempt int, error string, n_results int",
    )
    found = {r.question_id: (r.n_attempts, r.n_errors, r.first_success, r.status) for r in outcomes(log).collect()}
    assert found == {1: (6, 6, None, "exhausted"), 2: (2, 1, 2, "success"), 3: (1, 0, 1, "empty"), 4: (1, 1, None, "failed")}
    assert sorted(r.attempt for r in newest_attempts(log).filter("question_id = 1").collect()) == [4, 5, 6]
    again = numbered(log.withColumnRenamed("attempt", "t"), ["question_id"], ["t"], F.floor(F.col("t") / 2))
    assert again.filter("t <> attempt").count() == 0


def test_retry_loops(spark):
    rows = [(1, 1, 0, True), (1, 2, 3, False), (2, 1, 2, False), (3, 1, 0, True), *[(4, t, 0, True) for t in range(1, 8)],
            *[(5, t, int(t == 6), t < 6) for t in range(1, 8)], *[(6, t, None, None) for t in range(1, 6)]]
    log = spark.createDataFrame(rows, "question_id int, attempt int, n_results int, should_retry boolean")
    assert {r.question_id: (r.retries, r.status) for r in empty_outcomes(log).collect()} == {
        1: (1, "found"), 2: (0, "found"), 3: (0, "open"), 4: (5, "none"), 5: (5, "found"), 6: (4, "open")}
    assert {r.question_id: (r.retries, r.status) for r in sufficiency_outcomes(log).collect()} == {
        1: (1, "sufficient"), 2: (0, "sufficient"), 3: (0, "open"), 4: (3, "insufficient"), 5: (3, "insufficient"), 6: (3, "insufficient")}


def test_turn_chunks(spark):
    messages = spark.createDataFrame(
        [(1, 0, "assistant", "Plan", "p"), (1, 1, "user", None, "q1"), (1, 2, "assistant", "Query execution", "MATCH"),
         (1, 3, "system", None, "s"), (1, 4, "assistant", "Summary", "a"), (1, 5, "assistant", "Summary", "b"),
         (1, 6, "user", None, "q2")],
        "conv_id int, turn bigint, role string, section string, text string",
    )
    chunks = turn_chunks(messages, width=2)
    assert {r.turn: r.chunk for r in chunks.collect()} == {0: 0, 1: 1, 2: 1, 4: 1, 5: 1, 6: 2}
    found = {r.chunk: r for r in chunk_summaries(chunks).collect()}
    assert found[0].user_text == "" and found[0]["items"][0].code == "```json\np\n```"
    assert found[1].user_text == "q1" and found[1].summary_text == "ab"
    assert [i.code for i in found[1]["items"]] == ["```cypher\nMATCH\n```"]
    assert found[2]["items"] == [] and found[2].summary_text == ""


def test_sections_join_over_end_markers(spark):
    a = "assistant"
    messages = spark.createDataFrame(
        [(1, 1, a, "A", "x"), (1, 2, a, "A", "DONE"), (1, 3, a, "A", "y"), (1, 4, a, "B", "z"), (1, 5, a, "A", None),
         (1, 6, "user", "A", "q1"), (1, 7, "user", "A", "q2"), (1, 8, a, "A", "v"), (1, 9, None, "A", "w")],
        "s int, seq bigint, role string, section string, text string",
    )
    found = coalesce_sections(messages, ["s"], ["seq"], F.floor(F.col("seq") / 2)).orderBy("run")
    assert [tuple(r) for r in found.collect()] == [
        (1, 1, a, "A", 2, "xy"), (1, 2, a, "B", 1, "z"), (1, 3, a, "A", 1, ""), (1, 4, "user", "A", 1, "q1"),
        (1, 5, "user", "A", 1, "q2"), (1, 6, a, "A", 1, "v"), (1, 7, None, "A", 1, "w")]


def test_thinking(spark):
    chunks = spark.createDataFrame(
        [(1, 1, "S", "```json"), (1, 2, "S", "a<think> deep\n "), (1, 3, "S", "thought </think>b"), (1, 4, "S", "DONE"),
         (1, 5, "Thinking", "x"), (1, 6, "S", "<think> </think>c<think>open"), (1, 7, "S", "```")],
        "stream_id int, seq bigint, section string, text string",
    )
    texts = split_thinking(stage_texts(content_chunks(chunks), ["stream_id"]))
    row = texts.collect()[0]
    assert row.thinking == ["deep\n thought"] and row.text == "abc<think>open"
