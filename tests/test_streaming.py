import pytest
from pyspark.sql import functions as F

from talkgrain.streaming import live


@pytest.mark.parametrize(
    ("before", "now", "silence", "want"),
    [
        ("hello", "hello world", 0.0, False),
        ("hello world", "another", 0.0, True),
        ("short", "x", 0.0, False),
        ("this is a long sentence", "this is", 0.0, True),
        ("this is it", "this", 0.5, False),
        ("this is it", "this", 1.5, True),
        ("", "anything", 5.0, False),
        ("abcdefgh", "ab", 0.0, True),
        ("abcd", "xyz", 9.0, False),
    ],
)
def test_rollover(before, now, silence, want):
    assert live.commits(before, now, silence) is want


def test_repeats():
    assert live.is_repeat("hello there", "hello there you")
    assert not live.is_repeat("hello", "goodbye")


def _partials(spark):
    rows = [(1, "2024-01-01 00:00:00", "good", False), (1, "2024-01-01 00:00:01", "good morning", False), (1, "2024-01-01 00:00:05", "next sentence", True), (2, "2024-01-01 00:00:00", "alone", False)]
    return spark.createDataFrame(rows, "session long, ts string, text string, final boolean").withColumn("ts", F.col("ts").cast("timestamp"))


def test_assembly_as_batch(spark):
    got = sorted(map(tuple, live.assemble_batch(_partials(spark)).collect()))
    assert got == [(1, 0, "good morning"), (1, 1, "next sentence"), (2, 0, "alone")]


def test_assembly_as_stream(spark, tmp_path):
    _partials(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(_partials(spark).schema).parquet(str(tmp_path / "in"))
    q = live.assemble(stream).writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.sql("select * from assembled").collect()))
    assert got == [(1, 0, "good morning"), (1, 1, "next sentence")]  # session 2 is still open


def test_minute_windows_as_stream(spark, tmp_path):
    """What the stream has put out by its last watermark is a part of the batch result."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("session"), "ts", "value")
    src = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = live.minute_windows(src.select(F.col("user_id").alias("session"), "ts", "value")).writeStream.format("memory").queryName("minutes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.session, r.start): r.n for r in spark.sql("select * from minutes").collect()}
    want = {(r.session, r.start): r.n for r in live.minute_windows(e).collect()}
    assert 0 < len(got) <= len(want)
    assert all(want[k] == n for k, n in got.items())


def test_text_and_context(spark):
    done = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e"), (1, 3, "f g")], "session long, seq long, text string")
    open_ = spark.createDataFrame([(1, "h"), (2, "")], "session long, text string")
    assert {r.session: r.text for r in live.live_text(done, open_).collect()} == {1: "a b c d e f g h", 2: ""}
    assert live.context_tail(done, 3, 4).first().context == "d e f g"
