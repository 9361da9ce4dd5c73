"""Streams give what the batch jobs give."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kgspark.plans.ingest import load_metabolites, quarantined
from kgspark.sources.graph_store import GraphStore
from kgspark.operators.conversation import coalesce_sections
from kgspark.streaming.chunks import ChunkFold, Scan, fold_stream
from kgspark.streaming.ingest import ingest_stream, merge_arrived
from kgspark.streaming.sections import section_pieces, section_texts

CHUNKS = "stream_id string, seq bigint, section string, text string"


def folded(chunks, section):
    scan, events = Scan(section=section), []
    for chunk in chunks:
        events += scan.feed(chunk)
    return events + scan.finish()


def test_chunk_rules():
    assert folded(["a", "```json", "DONE", "b"], "S") == [
        ("S", "a", True), ("S", "```json", False), ("S", "DONE", False), ("S", "b", True), ("S", "DONE", False)]
    # a block over several chunks is lifted whole; blank ones vanish
    assert folded(["x<think> a", "b </thi", "nk>y<think> </think>", "z"], "S") == [
        ("Thinking", "ab", False), ("S", "xy", True), ("S", "z", True), ("S", "DONE", False)]
    # an opening tag split over chunks is text
    assert folded(["<th", "ink>a</think>"], "S") == [
        ("S", "<th", True), ("S", "ink>a</think>", True), ("S", "DONE", False)]
    # an unclosed block is text in the end
    assert folded(["a<think>b"], "S") == [("S", "a<think>b", True), ("S", "DONE", False)]
    # a closing tag first: what follows the opening tag is thinking
    assert folded(["</think>a<think>b"], "S") == [("Thinking", "b", False), ("S", "</think>a", True), ("S", "DONE", False)]
    assert folded(["t"], "Thinking") == [("Thinking", "t", False), ("Thinking", "DONE", False)]


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_chunk_stream_equals_the_fold(spark, tmp_path):
    rng = random.Random(2)
    streams = {f"s{i}": [rng.choice(["a", "<think>", "</think>", "```", "b<think>c</think>", "DONE", ""]) for _ in range(12)]
               for i in range(9)}
    rows = [(s, n, "S", c) for s, chunks in streams.items() for n, c in enumerate(chunks)]
    for part, keep in enumerate([lambda r: r[1] < 5, lambda r: r[1] >= 5]):
        ends = [(s, 99, "S", None) for s in streams] if part else []
        data = [r for r in rows if keep(r)] + ends
        rng.shuffle(data)
        spark.createDataFrame(data, CHUNKS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    source = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")
    run(fold_stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(out))
    found = {}
    for row in spark.read.parquet(out).orderBy("stream_id", "n").collect():
        found.setdefault(row.stream_id, []).append((row.section, row.text, row.kept))
    assert found == {s: folded([c for c in chunks if c], "S") for s, chunks in streams.items()}


def test_section_stream_equals_the_batch_job(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, n, rng.choice(["user", "assistant", "assistant", "assistant", None]), rng.choice(["A", "B", None]), rng.choice(["x", "y", "DONE", None]))
            for c in range(4) for n in range(40)]
    schema = "conv_id bigint, seq bigint, role string, section string, text string"
    for i in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == i], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run(section_pieces(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out")))
    live = section_texts(spark.read.parquet(str(tmp_path / "out"))).select("conv_id", "run", "role", "section", "n", "text")
    batch = coalesce_sections(spark.createDataFrame(rows, schema), ["conv_id"], ["seq"], F.floor(F.col("seq") / 7))
    assert sorted(map(str, live.collect())) == sorted(map(str, batch.select(*live.columns).collect()))


def test_file_stream_builds_the_same_graph(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for part in range(2):
        records = "".join(
            f"<metabolite><accession>M{i}</accession><name>n{part}</name>"
            f"<synonyms><synonym>s{part}{i % 2}</synonym></synonyms>"
            f"<diseases><disease><name>d{i % 3}</name><omim_id>{part}{i}</omim_id></disease></diseases></metabolite>\n"
            for i in range(5 + part)
        )
        (folder / f"f{part}.xml").write_text(f"<records>\n{records}</records>")
    batch = GraphStore(spark, str(tmp_path / "batch"))
    load_metabolites(spark, batch, str(folder))
    live = GraphStore(spark, str(tmp_path / "live"))
    run(ingest_stream(spark, live, str(folder), str(tmp_path / "cp"), merge_every=2, files_per_batch=1))
    assert live.snapshot() == 1
    odd = GraphStore(spark, str(tmp_path / "odd"))  # two batches in groups of three: the rest is merged at the end
    run(ingest_stream(spark, odd, str(folder), str(tmp_path / "cp2"), merge_every=3, files_per_batch=1))
    for store in (batch, live, odd):
        store.answer = (sorted(map(str, store.all_nodes().collect())), sorted(store.edges().collect()))
    # files arrive in the order of their names here, as the batch job takes them
    assert live.answer == batch.answer == odd.answer
    merge_arrived(live, "metabolite", 0, 1)
    assert sorted(map(str, live.all_nodes().collect())) == batch.answer[0]
    assert live.nodes("Metabolite").filter(F.col("name") == "n1").count() == 6


def test_streams_keep_what_does_not_parse(spark, tmp_path, capsys):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.xml").write_text("<r><metabolite><accession>M1</accession></metabolite><metabolite><accession>M2<oops></accession></metabolite></r>")
    store = GraphStore(spark, str(tmp_path / "g"))
    run(ingest_stream(spark, store, str(folder), str(tmp_path / "cp")))
    assert [r.accession for r in store.nodes("Metabolite").collect()] == ["M1"]
    bad = quarantined(store, "metabolite").collect()
    assert len(bad) == 1 and "M2" in bad[0]["_malformed"]
    assert "1 metabolite records do not parse" in capsys.readouterr().out


class Lists:
    """The handle of a stateful operator, with states in memory that count what is written."""

    def __init__(self):
        self.written = 0

    def getValueState(self, *_):  # noqa: N802
        return Value(self)

    def getListState(self, *_):  # noqa: N802
        return Value(self)


class Value:
    def __init__(self, handle):
        self.handle, self.held = handle, []

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[0] if self.held and isinstance(self.held[0], tuple) and len(self.held[0]) > 1 else iter(self.held)

    def update(self, row):
        self.held = [row]
        self.handle.written += len(str(row))

    def appendValue(self, row):  # noqa: N802
        self.held.append(row)
        self.handle.written += len(row[0])

    def clear(self):
        self.held = []


def test_open_block_is_written_once():
    """A block of 10^5 chunks in 1,000 batches: what is written to the state grows with the chunks, not with their square."""
    fold, handle = ChunkFold(), Lists()
    fold.init(handle)
    chunks = ["before<think>"] + [f"thought {i} </" for i in range(100_000)] + ["</think>after"]
    out = []
    for at in range(0, len(chunks), 100):
        part = chunks[at : at + 100]
        rows = pd.DataFrame({"seq": range(at, at + len(part)), "section": ["S"] * len(part), "text": part})
        out += [tuple(r) for frame in fold.handleInputRows(("k",), [rows], None) for r in frame.itertuples(index=False)]
    assert [(r[2], r[4]) for r in out] == [("Thinking", False), ("S", True)]
    assert out[0][3] == "".join(chunks[1:-1]).strip() and out[1][3] == "beforeafter"
    assert handle.written < 2 * sum(map(len, chunks))


def test_folds_of_any_batches_agree():
    rng = random.Random(8)
    for _ in range(60):
        chunks = [rng.choice(["a", "<think>", "</think>", "</th", "ink>", "b<think>c</think>", "DONE", "x</think>y<think>z"]) for _ in range(14)]
        fold, got = ChunkFold(), []
        fold.init(Lists())
        cuts = sorted(rng.sample(range(1, 14), 4))
        for a, z in zip([0, *cuts], [*cuts, 14]):
            rows = pd.DataFrame({"seq": range(a, z), "section": ["S"] * (z - a), "text": chunks[a:z]})
            got += [tuple(r)[2:] for f in fold.handleInputRows(("k",), [rows], None) for r in f.itertuples(index=False)]
        last = pd.DataFrame({"seq": [99], "section": ["S"], "text": [None]}, dtype=object)
        got += [tuple(r)[2:] for f in fold.handleInputRows(("k",), [last], None) for r in f.itertuples(index=False)]
        assert got == folded(chunks, "S"), chunks
