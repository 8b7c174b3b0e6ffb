"""Framed backups, written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.plans.register import registered
from talkgrain.sources import backup
from talkgrain.sources.scratch import scratch_root
from talkgrain.sources.tables import SEGMENTS, segments, table

QUERIES, ORACLE_SQL = {}, {}
query = registered(QUERIES, ORACLE_SQL)


def backed_up(spark, sf_dir) -> DataFrame:
    """(session, audio): conversations with their turns as segments; a turn's text is the audio of its chunk."""
    s = segments(spark, sf_dir)
    path = F.format_string("Audio/%d/%04d.m4a", "session_id", "ordinal")
    data = F.col("text").cast("binary")
    sort = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    each = s.where("session_id is not null").groupBy("session_id").agg(
        sort(F.col("ordinal").alias("index"), path.alias("relativePath"), F.length(data).cast("long").alias("sizeBytes")).alias("chunks"),
        sort(F.col("ordinal").alias("index"), F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), F.col("speaker").alias("speakerIndex"), F.col("text")).alias("segments"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct(F.col("start_ms").alias("atMs"), F.col("role").alias("label"))))).alias("highlights"),
        F.array_sort(F.collect_set("role")).alias("tags"),
        sort(path.alias("relativePath"), data.alias("data")).alias("audio"),
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.col("lang").alias("languageModeRaw"), F.col("source").alias("folder"))
    whole = each.join(docs, "session_id", "left").withColumn("id", F.col("session_id"))
    return whole.select(F.to_json(F.struct("id", "languageModeRaw", "folder", "chunks", "segments", "highlights", "tags")).alias("session"), "audio")


def _restored(spark, sf_dir) -> DataFrame:
    path = f"{scratch_root(spark)}/talkgrain/backup-{uuid.uuid4().hex}"
    backup.write_backup(backed_up(spark, sf_dir), path)
    return backup.read_backup(spark, path)


@query(
    f"with {SEGMENTS} select session_id, ordinal, start_ms, end_ms, speaker, s.text, lang as language, source as folder, 'Audio/' || session_id || '/' || lpad(ordinal::varchar, 4, '0') || '.m4a' as path, strlen(s.text) as audio_bytes, md5(s.text) as audio_md5 "
    "from segments s left join documents on doc_id = session_id"
)
def framed_backup(spark, sf_dir):
    """S09, S10, S38, S175: segments and the audio of their chunks, as they come back from framed files."""
    both = _restored(spark, sf_dir).select("session", F.explode("audio").alias("a")).select("session", "a.*")
    found = both.select("session.id", "session.languageModeRaw", "session.folder", "relativePath", "data", F.explode(F.arrays_zip("session.segments", "session.chunks")).alias("x"))
    seg, chunk = F.col("x.segments"), F.col("x.chunks")
    return found.where(F.col("relativePath") == chunk["relativePath"]).select(
        F.col("id").alias("session_id"), seg["index"].alias("ordinal"), seg["startMs"].alias("start_ms"), seg["endMs"].alias("end_ms"), seg["speakerIndex"].alias("speaker"), seg["text"].alias("text"),
        F.col("languageModeRaw").alias("language"), "folder", F.col("relativePath").alias("path"), F.length("data").cast("long").alias("audio_bytes"), F.md5("data").alias("audio_md5"),
    )


@query(
    f"with {SEGMENTS}, s as (select session_id, count(*) as n_segments, array_to_string(list_sort(list(distinct role)), ',') as tags, count(*) filter (role = 'system') as n_highlights from segments group by 1) "
    "select session_id, n_segments, tags, n_highlights from s where session_id % 2 = 1"
)
def restored_sessions(spark, sf_dir):
    """S37, S175: what a restore adds: sessions that are not there yet (the even ones are), with tags and highlights."""
    present = segments(spark, sf_dir).where("session_id % 2 = 0").select("session_id")
    new = backup.new_sessions(_restored(spark, sf_dir), present)
    return new.select(F.col("session.id").alias("session_id"), F.size("session.segments").cast("long").alias("n_segments"), F.array_join("session.tags", ",").alias("tags"), F.size("session.highlights").cast("long").alias("n_highlights"))
