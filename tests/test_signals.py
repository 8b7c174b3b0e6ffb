"""Signal operators against plain versions, and planted changes and speakers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.functions import signals as S
from talkgrain.operators import signals
from talkgrain.plans import signal_queries
from tests.compare import both

SF = "/root/testdata/sf0.001"
RATE = 16_000


@pytest.mark.parametrize("name", sorted(signal_queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    have, want = both(spark, SF, signal_queries.QUERIES[name], signal_queries.ORACLE_SQL[name])
    assert have and have == want


def _table(spark, *xs):
    return spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in enumerate(xs)], "signal long, x array<double>")


def test_short_empty_and_null_signals(spark):
    df = _table(spark, [], [0.5], None, [0.0] * 400)
    x = F.col("x")
    rows = df.select("signal", S.pre_emphasised(x).alias("p"), S.high_passed(x).alias("h"), S.gained(x).alias("g"), S.resampled(x, 8000, 16000).alias("r"), S.crossings(x).alias("c")).orderBy("signal").collect()
    assert [rows[0][k] for k in "phgr"] == [[]] * 4 and rows[1].p == rows[1].h == rows[1].r == [0.5] and rows[1].c == 0
    assert rows[2].p is None and rows[2].h is None
    assert [r.signal for r in signals.mfcc(df).collect()] == [3]
    assert all(r.pitch is None and r.energy is None for r in signals.window_features(df).collect())


def test_cepstra_by_definition(spark):
    x = np.random.default_rng(1).normal(0, 0.1, 600)
    have = sorted(signals.mfcc(_table(spark, x)).collect(), key=lambda r: r.frame)
    e = x - 0.97 * np.concatenate([[0], x[:-1]])
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    points = [math.floor(round(700 * (10 ** (mel(RATE / 2) * i / 27 / 2595) - 1) * 512 / RATE, 6)) for i in range(28)]
    for r in have:
        f = e[r.frame * 160 : r.frame * 160 + 400] * [0.54 - 0.46 * math.cos(2 * math.pi * t / 400) for t in range(400)]
        p = [abs(sum(f * np.exp(-2j * np.pi * k * np.arange(400) / 512))) ** 2 for k in range(257)]
        logs = []
        for a, b, c in zip(points, points[1:], points[2:], strict=False):
            tri = [(c - k) / (c - b) if b <= k <= c and c > b else (k - a) / (b - a) if a <= k <= b and b > a else 0 for k in range(257)]
            logs.append(math.log(max(sum(map(float.__mul__, map(float, tri), map(float, p))), 1e-10)))
        want = [sum(v * math.cos(math.pi / 26 * (n + 0.5) * k) for n, v in enumerate(logs)) for k in range(13)]
        assert r.mfcc == pytest.approx(want, rel=1e-6, abs=1e-6)
    assert [r.frame for r in have] == [0, 1]


def test_power_spectra_have_every_bin(spark):
    full = signal_queries.QUERIES["power_spectra"](spark, SF)
    frames = full.groupBy("signal", "frame").agg(F.count("*").alias("n"), F.count_distinct("bin").alias("bins"), F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    assert {tuple(r)[2:] for r in frames.collect()} == {(257, 257, 0, 256)}


def test_spectra_by_definition(spark):
    x = np.random.default_rng(4).normal(0, 0.1, 600)
    e = x - 0.97 * np.concatenate([[0], x[:-1]])
    rows = signals.spectra(_table(spark, x)).collect()
    for r in rows:
        f = e[r.frame * 160 : r.frame * 160 + 400] * [0.54 - 0.46 * math.cos(2 * math.pi * t / 400) for t in range(400)]
        assert r.power == pytest.approx([abs(sum(f * np.exp(-2j * np.pi * k * np.arange(400) / 512))) ** 2 for k in range(257)], rel=1e-6, abs=1e-9)
    assert len(rows) == 2


def test_pitch_and_energy_of_a_tone(spark):
    t = np.arange(RATE) / RATE
    tone = 0.3 * np.sin(2 * np.pi * 200 * t)
    r = signals.window_features(_table(spark, tone)).first()
    assert r.pitch == pytest.approx(200, abs=2) and r.centroid == pytest.approx(200, abs=10) and r.jitter < 0.01
    assert r.energy == pytest.approx((20 * math.log10(0.3 / math.sqrt(2)) + 60) / 60, abs=1e-3)


def test_change_points_find_the_planted_change(spark):
    rng = np.random.default_rng(2)
    frames = np.vstack([rng.normal(0, 1, (150, 13)), rng.normal(3, 1, (150, 13))])
    rows = [(0, 0, i + 7, [float(v) for v in f]) for i, f in enumerate(frames)]
    rows += [(1, 0, i, [float(v) for v in f]) for i, f in enumerate(rng.normal(0, 1, (200, 13)))]
    df = spark.createDataFrame(rows, "signal long, region long, frame long, mfcc array<double>")
    found = signals.change_points(df).collect()
    assert found and all(r.signal == 0 for r in found) and min(abs(r.frame - 157) for r in found) <= 10


def test_two_speakers_take_turns_and_silence_is_one_turn(spark):
    rng = np.random.default_rng(3)
    mean, loud = [2.0] * 150 + [0.0] * 200 + [-2.0] * 150, [0.5] * 150 + [0.0] * 200 + [0.5] * 150
    rows = [(0, i, e + float(rng.random()) / 100, [float(v) for v in rng.normal(m, 0.5, 13)]) for i, (m, e) in enumerate(zip(mean, loud, strict=True))]
    rows += [(1, i, 0.0, [0.0] * 13) for i in range(23)]
    df = spark.createDataFrame(rows, "signal long, frame long, energy double, mfcc array<double>")
    rows = [tuple(r) for r in signals.diarized(df).select("signal", "start", "end", "label").orderBy("signal", "start").collect()]
    assert rows == [(0, 0, 1500, 0), (0, 3500, 5000, 1), (1, 0, 230, 0)]


def _plain_splits(frames):
    """Change detection with a fresh covariance of both sides at every split."""
    def log_det(x):
        return np.linalg.slogdet(np.cov(x.T) + 1e-6 * np.eye(x.shape[1]))[1]

    found, start, end = [], 0, 100
    while end <= len(frames):
        x, d = frames[start:end], frames.shape[1]
        n, best = len(x), (0, 0.0)
        for at in range(33, n - 33, 10):
            gain = 0.5 * (n * log_det(x) - at * log_det(x[:at]) - (n - at) * log_det(x[at:])) - 1.5 * 0.5 * (d + 0.5 * d * (d + 1)) * math.log(n)
            best = (at, gain) if gain > best[1] else best
        if best[1] > 0:
            found.append((start + best[0], best[1]))
            start, end = start + best[0], start + best[0] + 100
        else:
            end += 50
    return found


def test_change_points_of_the_table_equal_a_plain_loop(spark):
    talk = signal_queries._talk(spark, SF).where("energy > 0").orderBy("signal", "frame").toPandas()
    want = []
    for signal, own in talk.groupby("signal"):
        frames = np.array(own["mfcc"].tolist())
        want += [(signal, own["frame"].iloc[at], gain) for at, gain in _plain_splits(frames)]
    found = sorted((r.signal, r.frame, r.gain) for r in signal_queries.QUERIES["speaker_changes"](spark, SF).collect())
    assert len(found) > 10 and [x[:2] for x in found] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in found] == pytest.approx([x[2] for x in sorted(want)], rel=1e-6)


def test_talk_has_several_speakers(spark):
    rows = signal_queries.QUERIES["diarization"](spark, SF).collect()
    assert len({r.label for r in rows}) > 1 and all(r.start < r.end for r in rows)


def test_segment_vectors_equal_the_statistics(spark):
    rng = np.random.default_rng(8)
    rows = [(s, None if i % 37 == 0 else i // 25 % 5, i, [float(v) for v in rng.normal(size=5)] if s else [0.5] * 5) for s in range(3) for i in range(130 + s)]
    rows.append((9, 4, 0, [1.0, 2.0, 3.0, 4.0, 5.0]))
    df = spark.createDataFrame(rows, "signal long, segment long, frame long, mfcc array<double>")
    want = {(r.signal, r.segment): r.v for r in signals.embeddings(signals.segment_statistics(df, ["signal"]), ["signal"]).collect()}
    got = {(r.signal, r.segment): r.v for r in signals.segment_vectors(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
