import zlib

import numpy as np

from kgspark.llm import language_id, queries

FOLDER = "/root/testdata/sf0.01"


def test_query_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op5(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    apart = [r for r in rows if r.held_out]
    assert {r.doc_id for r in apart} == {d for d in docs if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in apart]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.01
    assert rows == queries.op5(spark, FOLDER).collect()


def test_unknown_text_is_rejected_and_known_text_is_not(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    strange = spark.createDataFrame([(1, "漢字仮名交 文章例文 日本語文"), (2, "жзйк лмнп рстф хцчш щъыэ"), (3, "12 34 !!"), (4, None), (5, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.predict(strange, model).collect()}
    assert all(r.rejected for r in found.values())
    assert [found[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and [found[i].score for i in (3, 4, 5)] == [0.0] * 3
    assert found[1].lang_pred != "und"
    kept = language_id.recognized(docs, model)
    assert kept.columns == docs.columns and kept.count() > 0.99 * docs.count()


def test_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    rows = language_id.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (2, 3, 6)) for r in rows)
    assert language_id.recognized(odd_docs, model).columns == odd_docs.columns
    assert language_id.predict(no_docs, model).count() == 0
    empty = language_id.fit(no_docs)
    assert {(r.lang_pred, r.score, r.rejected) for r in language_id.predict(odd_docs, empty).collect()} == {("und", 0.0, True)}


def test_long_runs_of_letters_are_read_to_their_end(monkeypatch):
    """Of one run without spaces the first 64 letters are of one language, all others of the other."""
    texts = ["abcdefg hij abcd efghij", "klmnopq rst klmn opqrst"] * 20
    model = language_id.train(texts, ["one", "two"] * 20)
    run = "abcdefghij" * 7 + "klmnopqrst" * 60
    rows, share = language_id.bag(run)
    assert model.probabilities(share @ model.table[rows]).argmax() == 1
    best, score = language_id.Reader(model).read([run])[0]
    assert best == 1
    monkeypatch.setattr(language_id, "TAKEN", 50)
    monkeypatch.setattr(language_id, "LETTERS", 500)
    again = language_id.Reader(model)
    assert [again.read([f"{run} {i * 'a'}b", run])[1] for i in range(3)] == [(best, score)] * 3


def test_probabilities_equal_the_bags_own(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    model = language_id.fit(docs)
    read = language_id.reader(model)
    for r in docs.collect():
        rows, share = language_id.bag(r.text)
        assert abs(read.read([r.text])[0][1] - model.probabilities(share @ model.table[rows]).max()) < 1e-5


def test_texts_without_letters_are_of_no_language(spark):
    model = language_id.train(["one two three four", "eins zwei drei vier"] * 20, ["en", "de"] * 20)
    texts = ["½ ²", "Ⅷ ③", "12 _ 34", "٣٤", None, "x²y", "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert [found[i] == "und" for i in range(7)] == [True, True, True, True, True, False, False]
    assert language_id.words_of("x²y ½ Zwei_drei ③a") == ["x", "y", "zwei", "drei", "a"]


def test_two_languages_still_reject(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang in ('de', 'fr')")
    model = language_id.fit(docs)
    assert 0.5 < model.least <= 0.75
    assert language_id.recognized(docs, model).count() > 0.99 * docs.count()


def test_held_out_is_a_boolean_for_null_ids(spark, tmp_path):
    rows = [(i, "one two three", "en") for i in range(30)] + [(None, "one two", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.held_out for r in queries.op5(spark, str(tmp_path)).where("doc_id is null").collect()] == [False]
