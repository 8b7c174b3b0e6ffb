import hashlib
import random

import numpy as np
import pytest

from talkgrain.llm import exact_substrings as X
from talkgrain.llm import near_dedup as N
from talkgrain.llm.components import connected_components
from tests.llm import cases


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    todo = True
    while todo:
        todo = False
        for a in sets:
            for b in sets:
                u = len(sets[a] | sets[b])
                if u and label[a] < label[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * u:
                    label[b], todo = label[a], True
    return label, sets


def test_near_duplicates_of_odd_rows(spark):
    docs = cases.odd(spark)
    got = N.near_duplicates(docs).collect()
    label, sets = plain_components({(i, t) for i, t in cases.texts(docs) if i is not None})
    own = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(own) == len(label) and len(got) == len(own) + 2
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in own.items()} == {i: (len(sets[i]), c, c == i) for i, c in label.items()}
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_near_duplicates_in_a_group_with_outliers(spark, monkeypatch):
    """Copies that are not like the pivot, but like each other, are still found; blocks are small here."""
    monkeypatch.setattr(N, "BLOCK", 4)
    base, r = cases.prose(11, 80), random.Random(5)
    rows = [(0, base)] + [(i, cases.near(base, i, r.randrange(0, 9))) for i in range(1, 60)]
    rows += [(100 + i, cases.near(rows[7 * i + 3][1], 1000 + i, 2)) for i in range(8)]
    got = N.near_duplicates(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], cases.SCHEMA)).collect()
    label, _ = plain_components(rows)
    assert {x.doc_id: x.component_id for x in got} == label


def test_near_duplicates_of_nothing(spark):
    df = N.near_duplicates(cases.empty(spark))
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"] and df.count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64)) for _ in range(2))
    both = np.union1d(a, b)
    assert (np.maximum(N.registers(a), N.registers(b)) == N.registers(both)).all()
    x, y = N.registers(np.concatenate((a, b[:1000]))).astype(int), N.registers(both).astype(int)
    got = N.joint_estimate(*(np.array([v]) for v in ((x > y).sum(), (x < y).sum(), (x == y).sum())), np.array([3000.0]), np.array([4000.0]))[0]
    assert abs(got - 0.75) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 40), (40, 41), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 100: 40}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removal(rows, size):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            if w in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(w)
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("most", [X.INDEX_BYTES, 20_000, 1])
def test_removal_of_odd_rows(spark, monkeypatch, most):
    """With 1 every anchor is split until it has one context."""
    monkeypatch.setattr(X, "INDEX_BYTES", most)
    docs = cases.odd(spark)
    got = X.remove_repeats(docs).collect()
    rows = sorted({(i, t) for i, t in cases.texts(docs) if i is not None})
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == plain_removal(rows, X.LENGTH)
    assert len(got) == len(rows) + 2 and all(r.n_removed == 0 for r in got if r.doc_id is None)


def test_removal_of_nothing(spark):
    assert X.remove_repeats(cases.empty(spark)).count() == 0


def test_index_against_plain_windows():
    r = random.Random(3)
    for _ in range(60):
        parts = [bytes(r.choice(b"ab") for _ in range(r.randrange(30, 160))) for _ in range(3)]
        contexts = [b"".join(r.choice(parts)[: r.randrange(20, 160)] for _ in range(3)) for _ in range(8)]
        contexts = [c for c in dict.fromkeys(contexts) if len(c) >= X.LENGTH]
        seen, want = set(), []
        for c in contexts:
            hit = [k for k in range(len(c) - X.LENGTH + 1) if c[k : k + X.LENGTH] in seen or seen.add(c[k : k + X.LENGTH])]
            want.append(hit)
        if contexts:
            assert [[k for s, e in own for k in range(s, e)] for own in X.repeats(contexts)] == want


def test_index_streams_ranks_and_matches():
    """Rank and match length of every suffix, against sorting all of them."""
    r = random.Random(9)
    for _ in range(30):
        contexts = list({"".join(r.choice("ab") for _ in range(r.randrange(1, 40))).encode(): 0 for _ in range(12)})
        suffixes = sorted((c[i:] + b"\xff", k, i) for k, c in enumerate(contexts) for i in range(len(c) + 1))
        rank, match = X.RunIndex(contexts).stream(np.array([len(c) for c in contexts]))
        for at, (s, k, i) in enumerate(suffixes):
            if i < len(contexts[k]):
                before = suffixes[at - 1][0] if at else b""
                same = next(j for j in range(len(s)) if j >= len(before) or s[j] != before[j] or s[j] == 255)
                assert (rank[k, i], match[k, i]) == (at, same)


def test_halves_of_a_piece_hold_their_anchors():
    r = random.Random(1)
    for width in (32, 66, 83, 92, 96, 98, 99, 100):
        for _ in range(200):
            p = r.randrange(0, 101 - width)
            n = r.randrange(1, 102 - width)
            first = max(0, p - r.randrange(0, 101 - width))
            windows = [t for t in range(first, first + n) if t <= p and p + width <= t + 100]
            if not windows or windows[0] != first:
                continue
            parts = X.halves(0, len(windows), p - first, width)
            assert [lo + i for _, lo, m, _ in parts for i in range(m)] == list(range(len(windows)))
            longer = width + (100 - width + 1) // 2
            assert all(lo + m - 1 <= lo + a and lo + a + longer <= lo + 100 for _, lo, m, a in parts)


def test_removal_among_near_equal_contexts_of_one_anchor(spark, monkeypatch):
    """A common passage, followed and preceded by much the same, in more contexts than an index takes."""
    monkeypatch.setattr(X, "INDEX_BYTES", 3_000)
    r, line = random.Random(8), cases.prose(21, 30)
    rows = [(i, f"{r.choice('xyz')}{cases.prose(r.randrange(30), 3)} {line} {cases.prose(r.randrange(40), 3)}{r.choice('pq')}", None, None, None) for i in range(400)]
    got = X.remove_repeats(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == plain_removal([x[:2] for x in rows], X.LENGTH)


def test_runs_cover_every_window_once():
    for text in (cases.prose(1, 300), "ab" * 400, "x" * 500, "abc" * 50 + cases.prose(2, 50)):
        _, first, n = X.anchor_runs(text.encode())
        covered = [k for s, m in zip(first.tolist(), n.tolist(), strict=True) for k in range(s, s + m)]
        assert covered == list(range(len(text) - X.LENGTH + 1))
