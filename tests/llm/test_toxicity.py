"""Toxicity: folding, longest matches against a plain scan, held-out accuracy, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from talkgrain.llm import langid, toxicity
from talkgrain.llm.queries import QUERIES
from tests.llm import cases


@pytest.mark.parametrize(
    ("text", "want"),
    [("1d10t M0RON", "idiot moron"), ("Ѕtuрid ｓcum", "stupid scum"), ("tra$h! $cum!", "trash! scum!"), ("st​upid", "stupid"), ("mail 2024 7", "mail 2024 7"), ("wow!! no|on", "wow!! nolon"), ("Été", "été"), ("", "")],
)
def test_fold(text, want):
    assert toxicity.fold(text) == want


def test_longest_match_equals_a_plain_scan():
    r = random.Random(2)
    lexicon = toxicity.Lexicon({"<abab": (9, 1), "<abab>": (1, 9), "<abba": (5, 5), "<ababa>": (9, 0), "<élan": (5, 0)}, 20, 100)
    keys = sorted(lexicon.weights, key=len, reverse=True)
    for _ in range(200):
        text = " ".join("".join(r.choice("ab") for _ in range(r.randrange(1, 7))) if r.random() < 0.8 else r.choice(["trash can", "trash", "élans", "ïdiot", "class clown"]) for _ in range(r.randrange(12)))
        line, i, want = toxicity.marked(text)[0], 0, {}
        while i < len(line):
            k = next((k for k in keys if line.startswith(k, i)), None)
            if k:
                want[k] = want.get(k, 0) + 1
            i += len(k) if k else 1
        want |= {"<idiot>": n} if (n := text.count("ïdiot")) else {}
        assert dict(lexicon.found(text)[0]) == want
    assert lexicon.weights["<abab"] > lexicon.weights["<abab>"] and lexicon.weights["<trash><can>"] == 0
    assert lexicon.weight("<ababa>", (1, 0)) < lexicon.weight("<ababa>")


def _scored(spark, docs, labels, train):
    return {r.doc_id: r for r in toxicity.score(docs, labels, train).collect()}


def test_held_out_accuracy_and_disguise(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op11_toxicity"](spark, sf).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.92 * len(rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 2
    extra = spark.createDataFrame([(10**6, cases.prose(4, 60) + " y0u 1D1OT, you w0rthle$$ mоrоn"), (10**6 + 1, cases.prose(4, 60)), (10**6 + 2, "by the trash can"), (10**6 + 3, None)], "doc_id long, text string")
    found = _scored(spark, docs.select("doc_id", "text").unionByName(extra), labels, ~langid.held_out(F.col("doc_id"), 4, 2))
    assert found[10**6].score > 0.3 > max(found[10**6 + i].score for i in (1, 2, 3)) and found[10**6].n_hits == 3


def test_odd_rows_and_no_labels(spark):
    docs = cases.odd(spark).withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 1), (5, 0)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0), labels.where("toxic = 0")):
        rows = toxicity.score(docs, own, F.lit(True)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(cases.empty(spark), labels, F.lit(True)).collect() == []
