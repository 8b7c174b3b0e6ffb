"""Joins against plain loops."""

import math
import random

import numpy as np

from talkgrain.operators import clusters, joins


def _greedy(rows):
    taken, out = set(), []
    for key in sorted({(s, l) for s, l, _, _ in rows}):
        own = sorted((-x, r) for s, l, r, x in rows if (s, l) == key and (s, r) not in taken)
        if own:
            taken.add((key[0], own[0][1]))
            out.append((*key, own[0][1], -own[0][0]))
    return out


def _both(spark, rows):
    pairs = spark.createDataFrame(rows, "session long, l long, r long, similarity double")
    have = joins.greedy_in_order(pairs, ["session"])
    assert have.columns == pairs.columns
    return have, sorted(map(tuple, have.collect())), _greedy(rows)


def test_greedy_matching_against_a_plain_loop(spark):
    r = random.Random(1)
    rows = list({(s, i, d): (s, i, d, r.choice([0.3, 0.5, 0.5, 0.9])) for s in (0, 1) for i in range(8) for d in r.sample(range(40), 12)}.values())
    rows += [(2, i, d, 1.0) for i in range(4) for d in range(3)]  # all want the same segments, and one gets none
    have, got, want = _both(spark, rows)
    assert got == want and len([x for x in got if x[0] == 2]) == 3
    assert _both(spark, [])[1] == []


def test_refused_record_displaces_a_later_one(spark):
    _, got, want = _both(spark, [(0, 1, 3, 0.9), (0, 2, 3, 0.9), (0, 2, 5, 0.8), (0, 3, 5, 0.9), (0, 3, 6, 0.4)])
    assert got == want == [(0, 1, 3, 0.9), (0, 2, 5, 0.8), (0, 3, 6, 0.4)]


def test_no_task_holds_a_session(spark):
    pairs = spark.createDataFrame([(0, i, d, 0.5) for i in range(2) for d in range(50)], "session long, l long, r long, similarity double")
    plan = joins.greedy_in_order(pairs, ["session"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "hashpartitioning(session#" in plan and ", l#" in plan


def test_identities_in_several_blocks_are_compared_as_in_one(spark, monkeypatch):
    known = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(20)], "nearest long, centroid array<double>")
    own = spark.createDataFrame([(i, [math.cos(i / 3), math.sin(i / 3)]) for i in range(30)], "vec_id long, v array<double>")
    whole = sorted(map(tuple, clusters.identified(own, known).collect()))
    monkeypatch.setattr(clusters, "ENROLLED", 3)
    monkeypatch.setattr(clusters, "CENTRES", 4)
    assert sorted(map(tuple, clusters.identified(own, known).collect())) == whole
    assert [r[1] for r in whole[::3]] == list(range(10))


def test_blocks_leave_pairs_out_but_no_nearest(spark, monkeypatch):
    rng = np.random.default_rng(6)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()
    points = unit(rng.normal(size=(300, 3)))
    known = spark.createDataFrame([(i, v) for i, v in enumerate(points + points[:5])], "nearest long, centroid array<double>")  # some twice
    own = spark.createDataFrame([(i, v) for i, v in enumerate([*unit(rng.normal(size=(120, 3))), *points[:7], [0.0, 0.0, 0.0]])], "vec_id long, v array<double>")
    whole = sorted(map(tuple, clusters.identified(own, known).collect()))
    monkeypatch.setattr(clusters, "ENROLLED", 10)
    monkeypatch.setattr(clusters, "CENTRES", 20)
    assert sorted(map(tuple, clusters.identified(own, known).collect())) == whole
    assert clusters._near_pairs(own, known).count() < 128 * 305 / 3


def test_similar_texts_equal_all_pairs(spark):
    rng = random.Random(4)
    sets = [sorted(rng.sample("abcdefghijklmnop", rng.randint(1, 12))) for _ in range(80)]
    left = spark.createDataFrame(list(enumerate(sets[:40])), "l long, set array<string>")
    right = spark.createDataFrame(list(enumerate(sets[40:])), "r long, set array<string>")
    want = {(i, j) for i, a in enumerate(sets[:40]) for j, b in enumerate(sets[40:]) if 10 * len(set(a) & set(b)) >= 3 * len(set(a) | set(b))}
    assert {(x.l, x.r) for x in joins.similar_texts(left, right, 0.3).collect()} == want
