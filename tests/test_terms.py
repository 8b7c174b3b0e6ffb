"""Work within documents: no word is shuffled, parts of batches and repeated ids give what whole ones give."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkgrain.functions import terms
from talkgrain.operators import search, summaries

TEXTS = ["Alpha beta gamma delta epsilon. Beta beta beta gamma Anna Maria. One two.", "", "the of and", "alpha beta alpha beta gamma! Delta beta alpha zeta eta? We met Dr Jones in Rome there.", "x"]
WORK = {
    "keywords": summaries.top_keywords,
    "terms": summaries.top_terms,
    "pairs": summaries.co_occurring,
    "topics": summaries.topics,
    "summary": summaries.summary,
    "tf_idf": lambda docs: summaries.tf_idf(summaries.by_document(docs)),
    "extractive": lambda docs: summaries.extractive(summaries.by_document(docs), entities=True),
    "lead": lambda docs: summaries.lead(summaries.by_document(docs), entities=True),
    "text_rank": lambda docs: summaries.text_rank(summaries.by_document(docs)),
}


def _docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 4)], "doc_id long, text string")


@pytest.mark.parametrize("name", WORK)
def test_no_word_is_shuffled(spark, name):
    plan = WORK[name](_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", WORK)
def test_copies_have_equal_results(spark, name):
    rows = {}
    for r in WORK[name](_docs(spark).coalesce(1)).collect():
        rows.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i in range(len(TEXTS)):
        assert all(sorted(rows.get(i + k * len(TEXTS), [])) == sorted(rows.get(i, [])) for k in range(4))


def test_parts_give_what_the_whole_gives(monkeypatch):
    words = pa.array([t.lower().split() for t in TEXTS * 3])
    sents = pa.array([[s.split() for s in t.lower().split(".") if s.split()] for t in TEXTS * 3])
    work = [
        lambda: terms.top_of(words, 3, ["the"]),
        lambda: terms.top_of(words, 3, ["the"], words),
        lambda: terms.pairs_of(words, 5, 2, []),
        lambda: terms.topics_of(words, 5, 2, 2, []),
        lambda: terms.scores_of(sents, terms.Sentences.tf_idf),
    ]
    places = lambda: [sorted((x["term"], x["places"]) for x in row) for row in terms.places_of(words).to_pylist()]
    whole, placed = [f().to_pylist() for f in work], places()
    monkeypatch.setattr(terms, "AT_ONCE", 3)
    assert [f().to_pylist() for f in work] == whole and places() == placed


def test_texts_of_a_repeated_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "apple apple pear"), (1, "apple fig"), (2, "fig"), (None, "kiwi")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.word, r.n, r.place) for r in summaries.top_keywords(docs).collect()), key=str)
    assert got == [(1, "apple", 3, 1), (1, "fig", 1, 2), (1, "pear", 1, 3), (2, "fig", 1, 1), (None, "kiwi", 1, 1)]


def test_snippets_with_folded_and_plain_words(spark):
    df = spark.createDataFrame([("one Thé of-the e-mail x2 THE, and",)], "t string")
    got = df.select(search.snippet(F.col("t"), ["of-the", "the"]).alias("s")).first().s
    assert got == "one <b>Thé</b> <b>of-the</b> e-mail x2 <b>THE,</b> and"


def test_talk_reads_the_documents_once(spark):
    from talkgrain.plans import signal_queries

    plan = signal_queries._talk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
