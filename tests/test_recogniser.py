"""Live transcripts with timers: streams in any order and any batches equal the finished table; late rows are left out."""

import os
import random

import pytest
from pyspark.sql import functions as F

from talkgrain.streaming import recogniser as R

SCHEMA = "session long, ts timestamp, text string, final boolean"


def _at(spark, rows):
    df = spark.createDataFrame([(s, t, x, f) for s, t, x, f in rows], "session long, t double, text string, final boolean")
    return df.select("session", F.timestamp_millis((F.col("t") * 1000).cast("long") + 1_700_000_000_000).alias("ts"), "text", "final")


def _told(rows):
    """Plain loop over one session's rows."""
    line, out = R.Line(), []
    for at, text, final in sorted(rows):
        line = R.heard(line, at, text, final, out)
    while R.due(line) < 1 << 60:
        line = R.fired(line, out)
    return [(seq, cycle, text) for seq, cycle, _, text, _ in out]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0, "good", False), (1_000, "good morning", False), (5_000, "next sentence", True)], [(0, 0, "good morning"), (1, 0, "next sentence")]),
        ([(0, "one two", False), (54_999, "one two three", False)], [(0, 0, "one two three")]),
        # the recogniser is restarted at 55 s: what is open is confirmed, and the next cycle begins afresh
        ([(0, "one two", False), (56_000, "three four", False), (111_000, "five six", False)], [(0, 0, "one two"), (1, 1, "three four"), (2, 2, "five six")]),
        # silence stops it; the cycle that goes on is not a new one
        ([(0, "one two", True), (700_000, "three four", False)], [(0, 0, "one two"), (1, 10, "three four")]),
        ([(0, "hello there", True), (2_000, "hello there you", True)], [(0, 0, "hello there")]),
        # a session that was forgotten begins anew
        ([(0, "one two", True), (90_000_000, "three four", True)], [(0, 0, "one two"), (0, 0, "three four")]),
        ([(0, "", False), (1_000, "  ", True)], []),
    ],
)
def test_lines(rows, want):
    assert _told(rows) == want


def test_context_is_the_last_words_of_the_last_segments():
    out, line = [], R.Line()
    for i in range(6):
        line = R.heard(line, i * 1_000, " ".join(f"w{i}x{k}" for k in range(45)), True, out)
    assert len(out[-1][4].split()) == 100 and out[-1][4].split()[-1] == "w5x44" and out[0][4] == out[0][3]


def _hypotheses(seed, sessions=5):
    r, rows = random.Random(seed), []
    for s in range(sessions):
        t = r.random() * 10
        for _ in range(r.randrange(4, 12)):
            words = [r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randrange(1, 9))]
            for k in range(1, len(words) + 1):
                t += r.choice([0.2, 0.5, 1.5, 20])
                rows.append((s, round(t, 3), " ".join(words[:k]), r.random() < 0.1))
            t += r.choice([1, 5, 700])
    return rows


def test_table_equals_a_plain_loop(spark):
    rows = _hypotheses(1)
    got = {}
    for r in R.transcribed(_at(spark, rows)).orderBy("session", "seq").collect():
        got.setdefault(r.session, []).append((r.seq, r.cycle, r.text))
    want = {s: _told([(int(t * 1000) + 1_700_000_000_000, x, f) for k, t, x, f in rows if k == s]) for s in range(5)}
    assert got == want


def test_stream_out_of_order_equals_the_table(spark, tmp_path):
    rows = sorted(_hypotheses(2, 3), key=lambda r: r[1])
    end = max(t for _, t, _, _ in rows)
    # neighbours within the watermark are swapped between batches; the last batches move the watermark beyond all timers
    shuffled = sorted(rows, key=lambda r: r[1] + random.Random(str(r)).random() * 20)
    size = len(rows) // 4 + 1
    batches = [shuffled[i : i + size] for i in range(0, len(rows), size)] + [[(99, end + 2_000, "end", True)], [(99, end + 4_000, "end of it", True)], [(0, 5.0, "late and lost", True)]]
    for i, b in enumerate(batches):
        _at(spark, b).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        for f in (tmp_path / f"in/{i}").glob("*.parquet"):
            f.rename(tmp_path / f"in/{i}-part.parquet")
        os.utime(tmp_path / f"in/{i}-part.parquet", (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*-part.parquet").parquet(str(tmp_path / "in"))
    job = R.transcribe(stream, "30 seconds").writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(240)
    key = lambda df: sorted((r.session, r.seq, r.cycle, r.at, r.text, r.context) for r in df.collect())
    assert key(spark.sql("select * from told where session <> 99")) == key(R.transcribed(_at(spark, rows)))


def test_cycles_of_the_table(spark):
    from talkgrain.plans import live_queries

    sf = "/root/testdata/sf0.001"
    rows = {}
    for r in live_queries._hypotheses(spark, sf).select("session", F.unix_millis("ts").alias("at"), "text").collect():
        rows.setdefault(r.session, []).append((r.at, r.text, False))
    got = {}
    for r in live_queries.QUERIES["live_cycles"](spark, sf).orderBy("session", "seq").collect():
        got.setdefault(r.session, []).append((r.seq, r.cycle, r.text))
    assert got == {s: _told(x) for s, x in rows.items()} and max(c for x in got.values() for _, c, _ in x) > 0
