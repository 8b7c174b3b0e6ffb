"""Operators without SQL, or with edge cases that the tables lack, against plain versions."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.operators import clusters, joins, lifecycle, search, summaries


def _topics(text, k=20, most=5, reach=49, stop=()):
    words = [w for w in text.lower().split() if len(w) >= 2 and w not in stop]
    top = sorted(set(words), key=lambda w: (-words.count(w), w))[:k]
    stream = [w for w in words if w in top]
    near = {w: {w} for w in top}
    for i, a in enumerate(stream):
        for b in stream[i + 1 : i + 1 + reach]:
            near[a].add(b)
            near[b].add(a)
    used, out = set(), []
    for w in top:
        if w not in used:
            own = [m for m in top if m in near[w] and m not in used]
            out.append((w, own, sum(words.count(m) for m in own)))
            used |= set(own)
    return [(i, w, own, n / max(x[2] for x in out)) for i, (w, own, n) in enumerate(out[:most])]


def test_topics_against_a_plain_version(spark):
    r = random.Random(2)
    names = [f"k{a}{b}" for a in "xyz" for b in "pqrstuvw"]
    docs = [" ".join(r.choice(names[j * 6 : j * 6 + 6]) for j in range(4) for _ in range(60)), "one alone", " ".join(r.choice(names) for _ in range(400)), "", "the of and"]
    got = {}
    for row in summaries.topics(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect():
        got.setdefault(row.doc_id, []).append((row.place, row.label, row.members, row.weight))
    from talkgrain.functions.text import TOPIC_STOP_WORDS

    for i, t in enumerate(docs):
        want = _topics(t, stop=TOPIC_STOP_WORDS)
        assert sorted(got.get(i, [])) == pytest.approx(want) if not want else [(p, w, m, pytest.approx(x)) for p, w, m, x in want] == sorted(got[i])


def _linkage(v, most, apart):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    own = [[i] for i in range(len(v))]
    while len(own) > 1:
        d, a, b = min((float(np.mean([1 - v[i] @ v[j] for i in own[x] for j in own[y]])), x, y) for x, y in itertools.combinations(range(len(own)), 2))
        if len(own) <= most and d > apart:
            break
        own[a] += own.pop(b)
    return {frozenset(c) for c in own}


@pytest.mark.parametrize(("most", "apart"), [(10, 0.6), (3, 0.05), (10, 0.02)])
def test_average_linkage_against_merging_by_hand(spark, most, apart):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(3):
        v = rng.normal(size=(24, 6)) + 3 * rng.normal(size=(4, 6))[rng.integers(0, 4, 24)]
        rows += [(g, i, [float(x) for x in v[i]]) for i in range(24)]
        want[g] = _linkage(v, most, apart)
    found = {}
    for r in clusters.average_linkage(spark.createDataFrame(rows, "g long, i long, v array<double>"), "g", "i", "v", most, apart).collect():
        found.setdefault(r.g, {}).setdefault(r.cluster, set()).add(r.i)
    assert {g: {frozenset(c) for c in own.values()} for g, own in found.items()} == want


def test_speakers_keep_their_number_over_chunks(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [x + 0.05 for x in v]
    rows = [(1, 0, 0, a, 5), (1, 0, 1, b, 5), (1, 1, 0, near(b), 5), (1, 1, 1, near(a), 5), (1, 2, 0, c, 5), (1, 2, 1, b, 5), (2, 0, 0, c, 1)]
    got = {(r.session, r.chunk, r.speaker): r.global_speaker for r in joins.align_speakers(spark.createDataFrame(rows, "session long, chunk long, speaker long, embedding array<double>, samples long")).collect()}
    assert got == {(1, 0, 0): 0, (1, 0, 1): 1, (1, 1, 0): 1, (1, 1, 1): 0, (1, 2, 0): 2, (1, 2, 1): 1, (2, 0, 0): 0}


def test_why_a_diarized_text_is_not_complete(spark):
    long = "a text of some thirty letters, or a few more"
    cases = [
        ("", "x", 0, 0, 30_000, None),
        ("  \n", "", 0, 0, 30_000, None),
        (long, "  ", 0, 0, 30_000, "diarized_text_empty"),
        (long, None, None, None, 30_000, "diarized_text_empty"),
        (long, "a text", 0, 0, 1_000, "diarized_text_much_shorter_than_full_text"),
        (long, long, 20_000, 10_000, 30_000, "diarized_time_coverage_too_small"),
        (long, long, 20_000, 11_000, 30_000, None),
        (long, long, None, 10_000, 30_000, None),
        (long, long + "   ", 9_999, 10, 30_000, None),
        ("a text of twenty char", "a text o", 0, 0, 20_000, "diarized_text_much_shorter_than_full_text"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f string, d string, w long, s long, c long, want string")
    got = df.select("i", "want", lifecycle.completeness(*(F.col(x) for x in "fdwsc")).alias("got")).collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


def test_phrases_need_their_tokens_next_to_each_other(spark):
    texts = ["my e-mail is here", "e and mail", "mail e", "no hit", "E MAIL e mail", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r.i: r.tfs[0] for r in search.occurrences(df, ["i"], search.phrases(["e-mail"])).collect() if r.tfs[0]}
    assert found == {0: 1, 4: 2}
    assert {r.i for r in search.bm25(df, ["i"], ["e-mail", "here"]).collect()} == {0}
    assert search.bm25(df, ["i"], ["--"]).count() == 0


def test_nearest_and_holding_intervals_against_plain_loops(spark):
    r = random.Random(4)
    segs = [(k, i, s, s + r.randrange(0, 9), r.randrange(3)) for k in range(3) for i, s in enumerate(sorted(r.randrange(0, 200) for _ in range(12)))]
    words = [(k, i, s, s + r.randrange(0, 3)) for k in range(4) for i, s in enumerate(r.randrange(0, 220) for _ in range(60))]
    got = {(x.k, x.word): x.label for x in joins.best_overlap(spark.createDataFrame(words, "k long, word long, start long, end long"), spark.createDataFrame(segs, "k long, seg long, start long, end long, label int"), ["k"], 50).collect()}
    for k, i, s, e in words:
        own = [x for x in segs if x[0] == k]
        over = max(((min(e, x[3]) - max(s, x[2]), -x[1], x[4]) for x in own if min(e, x[3]) > max(s, x[2])), default=None)
        near = min(((abs(s + e - x[2] - x[3]), x[1], x[4]) for x in own), default=(0, 0, 0))
        assert got[k, i] == (over or near)[2]
    chunks = [(k, i, r.choice([0, 5, 9])) for k in range(3) for i in range(7)] + [(3, 0, 0)]
    points = [(k, p, r.randrange(-5, 60)) for k in range(5) for p in range(40)]
    found = {(x.k, x.point): x.idx for x in joins.chunk_at(spark.createDataFrame(points, "k long, point long, at long"), spark.createDataFrame(chunks, "k long, idx long, duration long"), ["k"]).collect()}
    want = {}
    for k, p, at in points:
        begin, own = 0, [c for c in chunks if c[0] == k]
        for _, i, d in own:
            if begin <= max(at, 0) < begin + d or (i == own[-1][1] and max(at, 0) >= begin + d):
                want[k, p] = i
                break
            begin += d
    assert found == want


def _plain_snippet(text, terms, width):
    words = text.split()
    tokens = [(i, t) for i, w in enumerate(words) for t in re.findall(r"[a-z0-9]+", w.lower())]
    hits = [(tokens[k][0], tokens[k + len(p) - 1][0], q) for q, p in enumerate(terms) for k in range(len(tokens) - len(p) + 1) if [t for _, t in tokens[k : k + len(p)]] == p]
    if not hits:
        return None
    starts = {max(min(a, len(words) - width), 0) for a, _, _ in hits}
    inside = lambda s: [h for h in hits if h[0] >= s and h[1] < s + width]
    s = min(starts, key=lambda s: (-len({q for _, _, q in inside(s)}), s))
    a, b = {h[0] for h in inside(s)}, {h[1] for h in inside(s)}
    body = " ".join(("<b>" if i in a else "") + w + ("</b>" if i in b else "") for i, w in enumerate(words) if s <= i < s + width)
    return ("..." if s else "") + body + ("..." if s + width < len(words) else "")


def test_snippets_against_a_plain_version(spark):
    r = random.Random(12)
    vocabulary = ["of", "the", "and", "of-the", "x", "y", "z", "e-mail", "mail.", "The-of-the", "--", "a-a-a-a"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(60))) for _ in range(120)] + ["", "   ", "nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for width in (3, 8, 32):
        got = {x.i: x.s for x in df.select("i", search.snippet(F.col("text"), ["of-the", "and", "e-mail", "a"], width).alias("s")).collect()}
        assert got == {i: _plain_snippet(t, [["of", "the"], ["and"], ["e", "mail"], ["a"]], width) for i, t in enumerate(texts)}


def test_tokens_without_diacritics(spark):
    from talkgrain.functions import text as T

    words = ["Nguyễn", "Łódź", "İstanbul", "ĞÜŞ", "Ἀθῆναι", "Ёлка", "ガラス", "naïve", "Z\u0335alg\u0301o", "한국어", "ǅ", "ﬁ"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, text string")
    got = {r.i: r.t for r in df.select("i", T.tokens(F.col("text")).alias("t")).collect()}
    assert [got[i][0] for i in range(10)] == ["nguyen", "łodz", "istanbul", "gus", "αθηναι", "елка", "ガラス", "naive", "zalgo", "한국어"]
    assert all(got[i] == [T.folded(w)] for i, w in enumerate(words))
    assert {r.i for r in search.bm25(df, ["i"], ["nguyen"]).collect()} == {0} and {r.i for r in search.bm25(df, ["i"], ["İstanbul"]).collect()} == {2}


def test_clusters_of_many_vectors_take_seconds():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 20))
    v = centres[rng.integers(0, 12, 2_000)] + rng.normal(size=(2_000, 20)) * 0.1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    start = time.perf_counter()
    label = clusters.labelled(len(v), clusters.merges(1 - v @ v.T), 20, 0.3)
    assert time.perf_counter() - start < 20 and label.max() <= 11
    same = 1 - v @ v.T < 0.05
    assert all(len(set(label[row])) == 1 for row in same[::97])


def test_merges_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 30, 60):
        v = rng.normal(size=(n, 4))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for most, apart in ((10, 0.6), (2, 0.1), (100, 0.3)):
            label = clusters.labelled(n, clusters.merges(1 - v @ v.T), most, apart)
            assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())} == _linkage(v, most, apart)
            firsts = [int(np.flatnonzero(label == k)[0]) for k in range(label.max() + 1)]
            assert firsts == sorted(firsts)


def test_groups_of_any_size_are_trimmed_and_cleaned(spark):
    r = random.Random(3)
    rows = [(None if i % 9 == 0 else "big" if i % 3 else f"g{i % 5}", i, r.randrange(50)) for i in range(400)] + [("five", 1_000 + i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i long, d long")
    own = {}
    for g, i, d in rows:
        own.setdefault(g, []).append((-d, i))
    want = {(g, i) for g, x in own.items() for k, (_, i) in enumerate(sorted(x)) if len(x) < 6 or k >= max(1, int(len(x) * 0.1))}
    assert {(x.g, x.i) for x in clusters.trimmed(df, "g", "d", "i").collect()} == want
    gone = set()
    for g, x in own.items():
        total = sum(-d for d, _ in x)
        left = total
        for i, d in sorted((i, -d) for d, i in x):
            if total > 300 and left > 0.85 * 300:
                gone.add((g, i))
            left -= d
    assert {(x.g, x.i) for x in lifecycle.to_clean_up(df, ["g"], "d", [F.col("i")], F.lit(300)).collect()} == gone


def test_folder_bytes_reads_no_content(spark, tmp_path):
    from talkgrain.sources import exports

    exports.write_texts(spark.createDataFrame([("a b", "x\ny"), ("a b", "é"), ("c", "")], "name string, body string"), str(tmp_path))
    found = exports.folder_bytes(spark, str(tmp_path), "name")
    assert {r["name"]: r.bytes for r in found.collect()} == {"a b": 4 + 3, "c": 1}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


def test_speakers_without_an_embedding_match_by_features(spark):
    low, high = [120.0, 20.0, 0.5, 1500.0, 0.01, 0.02], [300.0, 60.0, 0.5, 2500.0, 0.02, 0.03]
    near = lambda f: [f[0] + 5, *f[1:]]
    rows = [(1, 0, 0, None, low, 5), (1, 0, 1, [1.0, 0.0], high, 5)]
    rows += [(1, 1, 0, None, near(high), 5), (1, 1, 1, [0.0, 1.0], near(low), 5)]  # by features, as one of each pair has no embedding
    rows += [(1, 2, 0, [0.1, 1.0], [900.0] * 6, 1), (1, 2, 1, [-1.0, 0.0], high, 1)]  # by the embeddings they have by now; the other is new
    rows += [(2, 3, 4, None, low, 1), (2, 5, 0, None, None, 1)]  # the first chunk's keep their numbers
    df = spark.createDataFrame(rows, "session long, chunk long, speaker long, embedding array<double>, features array<double>, samples long")
    got = {(r.session, r.chunk, r.speaker): r.global_speaker for r in joins.align_speakers(df).collect()}
    assert got == {(1, 0, 0): 0, (1, 0, 1): 1, (1, 1, 0): 1, (1, 1, 1): 0, (1, 2, 0): 0, (1, 2, 1): 2, (2, 3, 4): 4, (2, 5, 0): 1}


def test_speakers_of_the_table_against_a_plain_fold(spark):
    from talkgrain.functions.vectors import SCALES, WEIGHTS
    from talkgrain.plans import vector_queries

    seen = {}
    real = joins.align_speakers
    try:
        joins.align_speakers = lambda df, *a: real(seen.setdefault("df", df), *a)
        got = sorted(map(tuple, vector_queries.QUERIES["aligned_speakers"](spark, "/root/testdata/sf0.001").collect()))
    finally:
        joins.align_speakers = real
    want = []
    rows = seen["df"].collect()
    assert any(r.embedding is None for r in rows) and any(r.embedding is not None for r in rows)
    for session in {r.session for r in rows}:
        known = []
        for place, chunk in enumerate(sorted({r.chunk for r in rows if r.session == session})):
            own = sorted((r for r in rows if (r.session, r.chunk) == (session, chunk)), key=lambda r: r.speaker)
            unit = lambda v: None if v is None else np.array(v) / np.linalg.norm(v)
            pairs = []
            for i, r in enumerate(own):
                for k, (v, f, _) in enumerate(known):
                    if r.embedding is not None and v is not None:
                        pairs.append((1 - unit(r.embedding) @ v, i, k, 0.4))
                    else:
                        pairs.append((sum(w * ((x - y) / s) ** 2 for x, y, s, w in zip(r.features, f, SCALES, WEIGHTS, strict=True)) ** 0.5, i, k, 2.0))
            to = {}
            for d, i, k, most in sorted(pairs):
                if d <= most and i not in to and k not in to.values():
                    to[i] = k
            fresh = len(known)
            for i, k in to.items():
                v, f, n = known[k]
                f, n = (f * n + np.array(own[i].features)) / (n + 1), n + 1
                if own[i].embedding is not None:
                    v = unit(own[i].embedding) if v is None else unit(v * n / (n + 1) + unit(own[i].embedding) / (n + 1))
                    n += 1
                known[k] = (v, f, n)
            for i, r in enumerate(own):
                if i not in to:
                    to[i], fresh = fresh, fresh + 1
                    known.append((unit(r.embedding), np.array(r.features), 1))
                want.append((session, chunk, r.speaker, to[i] if place else r.speaker))
    assert got == sorted(want)
