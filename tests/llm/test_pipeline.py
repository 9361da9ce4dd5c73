"""Every stage against a plain version of itself, each on what the stage before has left."""

import os
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from kgspark import session
from kgspark.llm import mixing
from kgspark.session import stored

from .test_packing import plain_ids
from .test_secret_scan import plain as plain_findings
from .test_set_join import plain as plain_components

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def chain(spark):
    """The documents, and what each stage makes of its predecessor's."""
    odd = spark.createDataFrame(
        [(10_001, None, None, None, None), (10_002, "", "en", "x", 0), (10_003, "12 34", "en", None, 5)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(odd)
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        found[name] = docs
    return found


def rows_of(frame):
    return Counter(map(tuple, frame.collect()))


def test_stages_in_their_order(chain):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "packing"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert chain[name].columns == chain["documents"].columns
        assert dict(chain[name].dtypes) == dict(chain["documents"].dtypes)


def test_unrecognized_languages_go(chain):
    before, after = rows_of(chain["documents"]), rows_of(chain["language ID"])
    assert not after - before
    gone = [r for r in before - after]
    assert {10_001, 10_002, 10_003} <= {r[0] for r in gone} and len(gone) < 3 + 0.03 * sum(before.values())


def test_one_document_of_each_group_stays(chain):
    docs = chain["language ID"].collect()
    stays = {d for d, _, c in plain_components([(r.doc_id, r.text) for r in docs], 80, 100, 5) if d == c}
    assert rows_of(chain["n-gram Jaccard join"]) == Counter(tuple(r) for r in docs if r.doc_id in stays)


def test_secrets_are_redacted(chain):
    found = Counter()
    for r in chain["n-gram Jaccard join"].collect():
        text, at, out = r.text, 0, ""
        for start, _, end, _ in plain_findings(text):
            if start >= at:
                out += text[at:start] + "[secret]"
            at = max(at, end)
        text = out + text[at:]
        found[(r.doc_id, text, r.lang, r.source, len(text))] += 1
    assert rows_of(chain["secret scans"]) == found


def test_the_mix_takes_what_its_targets_say(chain):
    before = chain["secret scans"]
    text = {r.doc_id: r.text for r in before.collect()}
    words = Counter()
    for r in chain["mixing sources to target weights"].collect():
        own = Counter(WORD.findall(r.text))
        assert not own - Counter(WORD.findall(text[r.doc_id])) and r.n_chars == len(r.text)
        words[r.doc_id] += sum(own.values())
    assert words == +Counter({r.doc_id: r.taken for r in mixing.mix(before).taken.collect()})


def test_packing_holds_every_id_once(chain):
    want = Counter((r.doc_id, tuple(plain_ids(r.text) + [1])) for r in chain["mixing sources to target weights"].collect())
    got, pieces = Counter(), {}
    for r in chain["packing"].orderBy("sequence_id").collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and not r.length & (r.length - 1)
        if not r.start:
            pieces[r.doc_id] = []
        pieces[r.doc_id] += ids
        if len(pieces[r.doc_id]) == r.doc_tokens:
            got[r.doc_id, tuple(pieces[r.doc_id])] += 1
    assert got == want


def test_run_is_the_chain(spark):
    frame = corpus_pipeline.run(spark, FOLDER)
    assert frame.count() > 0 and {"doc_id", "start", "length", "ids", "sequence_id"} <= set(frame.columns)


def test_run_keeps_one_table_of_a_stage(spark, monkeypatch):
    """A stage's table goes once the next one is written; the last one stays for the packing."""
    step = lambda k: lambda spark, docs, folder: docs.where(f"doc_id % {k} = 0")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", step(2)), ("b", step(3)), ("c", step(5)), ("d", step(1))])
    before = {x for x in os.listdir(f"{session.shared_dir(spark)}/kgspark") if x.startswith("pipeline-")}
    frame = corpus_pipeline.run(spark, FOLDER)
    after = {x for x in os.listdir(f"{session.shared_dir(spark)}/kgspark") if x.startswith("pipeline-")} - before
    assert [x.rsplit("-", 1)[0] for x in after] == ["pipeline-c"]
    assert sorted(r.doc_id for r in frame.collect()) == [0, 30, 60, 90, 120, 150, 180]
