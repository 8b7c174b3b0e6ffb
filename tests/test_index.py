"""An index that is kept up finds what a rebuilt one finds."""

import random

import pytest
from pyspark.sql import functions as F

from talkgrain.operators import search
from talkgrain.operators.index import SearchIndex

SCHEMA = "session long, seg long, text string"
KEY = ("session", "seg")


def _ranks(df):
    return {(r.session, r.seg): pytest.approx(r["rank"]) for r in df.collect()}


def test_changes_equal_a_rebuilt_index(spark, tmp_path):
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "e-mail", "Éclair", "mail", "x"]
    say = lambda: " ".join(r.choice(words) for _ in range(r.randrange(12)))
    frame = lambda rows: spark.createDataFrame([(*k, t) for k, t in rows.items()], SCHEMA)
    now = {(s, g): say() for s in range(6) for g in range(8)}
    now[0, 0] = None
    index = SearchIndex(spark, str(tmp_path / "kept"), KEY)
    index.rebuild(frame(now))
    queries = (["alpha"], ["beta", "gamma"], ["e-mail"], ["éclair", "mail"], ["absent"], ["--"])

    def same():
        texts = frame(now)
        for q in queries:
            assert _ranks(index.search(q)) == _ranks(search.bm25(texts, list(KEY), q)), q
        assert {(x.session, x.seg) for x in index.docs().collect()} == set(now)

    same()
    edited = {k: say() for k in r.sample(sorted(now), 9)} | {(9, 1): "alpha e-mail"}
    index.upsert(frame(edited), 1)
    now |= edited
    same()
    gone = r.sample(sorted(now), 7) + [(77, 7)]
    index.remove(frame({k: "" for k in gone}), 2)
    now = {k: t for k, t in now.items() if k not in gone}
    same()
    index.remove_sessions(spark.createDataFrame([(3,), (55,)], "session long"), 3)
    now = {k: t for k, t in now.items() if k[0] != 3}
    same()
    back = {(3, 2): "alpha beta gamma", gone[0]: "e-mail alpha"}  # what was removed comes back
    index.upsert(frame(back), 4)
    index.upsert(frame(back), 4)  # a step that is done again changes nothing
    now |= back
    same()
    index.compact(5)
    assert sorted(p.name for p in (tmp_path / "kept/docs").iterdir()) == ["gen=5"]
    same()
    index.rebuild(frame(now), 6)
    same()


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path), ("seg",))
    index.rebuild(spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "seg long, text string"))
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert [r.seg for r in index.search(["alpha"]).collect()] == [1]
    index.remove(spark.createDataFrame([(1,)], "seg long"), 1)
    assert index.search(["alpha"]).collect() == [] and index.docs().where(F.col("seg") == 2).count() == 1
