"""Framed backups: what is written comes back, newer and broken files are refused."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from talkgrain.plans import backup_queries
from talkgrain.sources import backup

SF = "/root/testdata/sf0.001"


def _rows(spark, n=7):
    rows = [(json.dumps({"id": i, "languageModeRaw": "en", "chunks": [{"index": k, "relativePath": f"a/{i}/{k}", "sizeBytes": k} for k in range(i % 3)], "segments": [{"index": 0, "text": "é😀"}]}), [(f"a/{i}/{k}", bytes([i, k]) * 50) for k in range(i % 3)]) for i in range(n)]
    return spark.createDataFrame(rows, backup.SCHEMA)


@pytest.mark.parametrize("frame", [1, 10**6])
def test_round_trip_and_layout(spark, tmp_path, frame):
    df = _rows(spark).repartition(2)
    spark.dataSource.register(backup.BackupSource)
    df.write.format(backup.FORMAT).option("path", str(tmp_path)).option("frameBytes", frame).mode("append").save()
    files = list(tmp_path.iterdir())
    assert all(f.suffix == backup.SUFFIX for f in files) and (len(files) == 7 if frame == 1 else len(files) <= 2)
    for f in files:  # offsets are prefix sums of lengths, and the last audio ends the file
        data = f.read_bytes()
        length = struct.unpack("<Q", data[:8])[0]
        audio = json.loads(data[8 : 8 + length])["audioFiles"]
        assert [a["offset"] for a in audio] == [sum(b["length"] for b in audio[:i]) for i in range(len(audio))]
        assert 8 + length + sum(a["length"] for a in audio) == len(data)
    got = {r.session.id: {a.relativePath: bytes(a.data) for a in r.audio} for r in backup.read_backup(spark, str(tmp_path)).collect()}
    assert got == {i: {f"a/{i}/{k}": bytes([i, k]) * 50 for k in range(i % 3)} for i in range(7)}
    first = backup.read_backup(spark, f"file://{tmp_path}").first().session
    assert first.segments[0].text == "é😀" and first.segments[0].speakerIndex == -1 and first.tags == [] and first.highlights == []


def test_newer_and_broken_files_are_refused(spark, tmp_path):
    backup.write_backup(_rows(spark), str(tmp_path / "a"))
    with pytest.raises(Exception, match="newer than 2"):
        backup.read_backup(spark, str(tmp_path / "a"), newest=2).collect()
    for name, data in (("b", b"\x07"), ("c", struct.pack("<Q", 10**9) + b"{}"), ("d", struct.pack("<Q", 4) + b"nope")):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"x{backup.SUFFIX}").write_bytes(data)
        with pytest.raises(Exception, match="not a backup"):
            backup.read_backup(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="mounted folder"):
        backup.read_backup(spark, "hdfs://x/y").collect()


def test_cut_audio_is_left_out_and_overwrite_replaces(spark, tmp_path):
    backup.write_backup(_rows(spark, 3).coalesce(1), str(tmp_path))
    file = next(tmp_path.iterdir())
    file.write_bytes(file.read_bytes()[:-1])
    assert {r.session.id: len(r.audio) for r in backup.read_backup(spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 1}
    backup.write_backup(_rows(spark, 2), str(tmp_path), "overwrite")
    assert backup.read_backup(spark, str(tmp_path)).count() == 2
    assert backup.new_sessions(backup.read_backup(spark, str(tmp_path)), spark.createDataFrame([(0,), (None,)], "session_id long")).select("session.id").collect()[0].id == 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception):
        backup.write_backup(_rows(spark).withColumn("session", F.when(F.rand(1) < 2, "no json")), str(tmp_path))
    assert not list(tmp_path.glob(f"*{backup.SUFFIX}"))


def test_backup_of_the_table(spark):
    got = backup_queries.QUERIES["framed_backup"](spark, SF)
    assert got.where("audio_md5 <> md5(text)").count() == 0 and got.count() == spark.read.parquet(f"{SF}/conversations.parquet").count()
