"""Summaries of finalised sessions as a stream: replays change nothing, later batches only add."""

from pyspark.sql import functions as F

from talkgrain.operators import lifecycle, summaries
from talkgrain.streaming import upkeep

TEXT = "This is the first sentence of them. Here comes another one for you. A third sentence is here too. And the fourth one ends it all."


def _texts(spark):
    return spark.createDataFrame([(i, TEXT.replace("first", f"first{i}")) for i in range(6)], "session_id long, text string")


def _batches(spark):
    rows = [
        [(0, 0, 2, 1), (0, 1, 1, 2), (1, 0, 2, 3), (2, 0, 3, 4), (9, 0, 2, 5)],  # 1 is ready; 9 has no text
        [(0, 1, 2, 6), (2, 0, 2, 7), (2, 0, 3, 6), (1, 1, 1, 8)],  # 0 and 2 become ready, 1 is open again
        [(1, 1, 2, 9), (3, 0, 0, 10), (3, 0, 2, 11)],  # 1 keeps its summary, 3 is ready
    ]
    return [spark.createDataFrame(r, upkeep.CHUNK) for r in rows]


def _got(spark, root):
    return sorted((r.batch, r.session_id) for r in upkeep._written(spark, f"{root}/summaries", upkeep.SUMMARY).collect())


def test_replays_change_nothing(spark, tmp_path):
    step = upkeep.summarise_finalised(_texts(spark), str(tmp_path))
    for number, batch in enumerate(_batches(spark)):
        step(batch, number)
        once = _got(spark, tmp_path)
        step(batch, number)
        assert _got(spark, tmp_path) == once
    assert once == [(0, 1), (1, 0), (1, 2), (2, 3)]
    now = {(r.session_id, r.idx): r.status for r in upkeep.current(spark, f"{tmp_path}/chunks", upkeep.CHUNK, ["session_id", "idx"]).collect()}
    assert now == {(0, 0): 2, (0, 1): 2, (1, 0): 2, (1, 1): 2, (2, 0): 2, (3, 0): 2, (9, 0): 2}
    upkeep.compact(spark, f"{tmp_path}/chunks", upkeep.CHUNK, ["session_id", "idx"], 1)
    assert sorted(p.name for p in (tmp_path / "chunks").iterdir()) == ["batch=1", "batch=2"]
    assert {(r.session_id, r.idx): r.status for r in upkeep.current(spark, f"{tmp_path}/chunks", upkeep.CHUNK, ["session_id", "idx"]).collect()} == now


def test_stream_of_several_batches_equals_the_table(spark, tmp_path):
    for number, batch in enumerate(_batches(spark)):
        batch.coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))
    stream = spark.readStream.schema(upkeep.CHUNK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {r.session_id: r.summary for r in upkeep.run(stream, _texts(spark), str(tmp_path / "out")).collect()}
    last = spark.read.parquet(str(tmp_path / "in/*")).groupBy("session_id", "idx").agg(F.max_by("status", "seq").alias("status"))
    ready = lifecycle.final_status(last, "session_id").where("state = 'ready'")
    want = summaries.summary(_texts(spark).join(ready, "session_id").select(F.col("session_id").alias("doc_id"), "text"), k=3)
    assert got == {r.doc_id: r.summary for r in want.collect()} and len(got) == 4
    again = {r.session_id: r.summary for r in upkeep.run(stream, _texts(spark), str(tmp_path / "out")).collect()}
    assert again == got
