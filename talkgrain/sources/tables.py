"""The driver's tables, and the session tables that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sessions; one starts every hour."""
    start = F.timestamp_add("HOUR", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("session_id"), "text", F.col("lang").alias("language"), F.col("source").alias("folder"), F.col("n_chars").alias("size_bytes"), start.alias("started_at"), (F.col("doc_id") % 3 != 0).alias("audio_kept")
    )


SESSIONS = (
    "sessions as (select doc_id as session_id, text, lang as language, source as folder, n_chars as size_bytes, "
    "timestamp '2024-01-01 00:00:00' + to_hours(doc_id) as started_at, doc_id % 3 <> 0 as audio_kept from documents)"
)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as segments of a second each; speaker 0 asks, 1 answers, -1 is not known."""
    speaker = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(-1)
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + 900).alias("end_ms"), speaker.alias("speaker"), "role", "text"
    )


SEGMENTS = (
    "segments as (select conv_id as session_id, turn as ordinal, turn * 1000 as start_ms, turn * 1000 + 900 as end_ms, "
    "case role when 'user' then 0 when 'assistant' then 1 else -1 end as speaker, role, text from conversations)"
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as audio chunks of an order's session."""
    return chunk_columns(table(spark, sf_dir, "lineitem"))


def chunk_columns(lines: DataFrame) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_linestatus") == "F", 2).otherwise(F.when(F.col("l_returnflag") == "A", 1).otherwise(2))
    return lines.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("idx"), (F.col("l_quantity") * 1000).cast("long").alias("duration"), F.col("l_extendedprice").cast("long").alias("size_bytes"), status.alias("status"))


CHUNKS = (
    "chunks as (select l_orderkey as session_id, l_linenumber as idx, cast(l_quantity * 1000 as bigint) as duration, cast(trunc(l_extendedprice) as bigint) as size_bytes, "
    "case when l_returnflag = 'R' then 3 when l_linestatus = 'F' then 2 when l_returnflag = 'A' then 1 else 2 end as status from lineitem)"
)


#: a recording of the embeddings table: the vectors of one label (under 1,000) and of this many successive ids, at most; and its SQL
PER_RECORDING = 2_000
RECORDING = f"(vec_id // {PER_RECORDING}) * 1000 + label"


def recording() -> Column:
    return F.floor(F.col("vec_id") / PER_RECORDING) * 1000 + F.col("label").cast("long")
