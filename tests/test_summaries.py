"""Graph ranks against a plain power iteration, and on a document too long for a matrix of its sentences."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.operators import summaries


def _plain(sents, damping=0.85):
    n, names = len(sents), sorted({w for s in sents for w in s})
    v = np.array([[s.count(w) for w in names] for s in sents], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = v @ v.T
    for i in range(n):
        w[i, i] = 0
        w[i] = w[i] / w[i].sum() if w[i].max() > 0 else 0
    score = np.full(n, 1 / n)
    for _ in range(100):
        new = (1 - damping) / n + damping * (w.T @ score)
        done, score = np.abs(new - score).sum() < 1e-4, new
        if done:
            break
    return score if n > 1 else [1.0]


def _ranks(spark, docs):
    rows = [(d, i, len(sents), s) for d, sents in enumerate(docs) for i, s in enumerate(sents)]
    sent = spark.createDataFrame(rows, "doc_id long, i int, n long, words array<string>")
    return {(r.doc_id, r.i): r.score for r in summaries.text_rank(sent).collect()}


def test_text_rank_against_power_iteration(spark):
    r = random.Random(5)
    docs = [[[r.choice("abcdefghijklmnop") for _ in range(6)] for _ in range(n)] for n in (1, 2, 9, 40)]
    docs.append([list("aabbc"), list("vwxyz"), list("abcde")])  # the second has no neighbour
    got = _ranks(spark, docs)
    for d, sents in enumerate(docs):
        assert [got[d, i] for i in range(len(sents))] == pytest.approx(list(_plain(sents)), abs=1e-9)


def test_text_rank_of_a_long_document(spark):
    n = 60_000  # a matrix would have 29 GB
    got = _ranks(spark, [[[f"w{i}", f"w{i + 1}", "a", "b", "c"] for i in range(n)]])
    assert len(got) == n and sum(got.values()) == pytest.approx(1, abs=1e-6)


def test_length_scores(spark):
    """0.6 at 5 and just below 10 words it rises to 1; beyond 80 it falls in proportion."""
    words = [1, 4, 5, 7, 9, 10, 40, 41, 60, 80, 81, 160]
    df = spark.createDataFrame([(w,) for w in words], "w int")
    got = [r.s for r in df.select(summaries.length_score(F.col("w")).alias("s")).collect()]
    assert got == pytest.approx([0.2, 0.8, 0.6, 0.76, 0.92, 1, 1, 0.99, 0.8, 0.6, 80 / 81, 0.5])


def test_names(spark):
    from talkgrain.functions import text as T

    cases = {
        "Yesterday Anna Maria met Dr Smith in New York.": [(1, "Anna Maria", "name"), (4, "Dr Smith", "name"), (7, "New York", "place")],
        "The talk by prof. Jones, Brown and (Green) Hill": [(4, "Jones", "person"), (5, "Brown", "name"), (7, "Green", "name"), (8, "Hill", "name")],
        "Bank": [],
        "we asked Deutsche Bank, ACME and Élan-Vital Ltd": [(2, "Deutsche Bank", "organization"), (6, "Élan-Vital Ltd", "organization")],
        "x " + " ".join(["Word"] * 20): [(1, " ".join(["Word"] * 8), "name")],
        "": [],
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    got = {r.s: [tuple(x) for x in r.n] for r in df.select("s", T.names(F.col("s")).alias("n")).collect()}
    assert got == cases


LEAD_TEXTS = [(1, "We saw Anna Maria in the town. Then all went home by the river."), (2, "this one stands all alone."), (3, "short."), (4, None)]


def _cuts(df):
    """How often the optimized plan cuts texts into sentences."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("(?<=")


def test_lead_scores_cut_sentences_once(spark):
    sents = summaries.by_document(spark.createDataFrame(LEAD_TEXTS, "doc_id long, text string"))
    found = summaries.lead(sents)
    assert _cuts(found) == _cuts(sents)
    assert sorted((r.doc_id, r.i, round(r.score, 9)) for r in found.collect()) == [(1, 0, 0.876), (1, 1, 0.756), (2, 0, 1.0)]


def test_lead_scores_with_names_cut_sentences_once(spark):
    sents = summaries.by_document(spark.createDataFrame(LEAD_TEXTS, "doc_id long, text string"))
    found = summaries.lead(sents, entities=True)
    assert _cuts(found) == _cuts(sents)
    assert sorted((r.doc_id, r.i, round(r.score, 6)) for r in found.collect()) == [(1, 0, 0.890286), (1, 1, 0.756), (2, 0, 1.0)]


@pytest.mark.parametrize("name", ["lead_scores", "lead_scores_with_names"])
def test_lead_scores_of_odd_rows_equal_sql(spark, tmp_path, name):
    """One sentence, none, null texts, null doc_ids."""
    from talkgrain.plans import registry
    from tests.compare import both

    rows = [*LEAD_TEXTS, (None, LEAD_TEXTS[0][1] * 3), (5, ""), (6, " ".join(["Word"] * 90) + ". Then we met Dr Smith there at noon")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    have, want = both(spark, tmp_path, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert have == want and len(have) > 4
