"""Upserts and summaries of sessions as they are finalised, micro-batch by micro-batch.

Every batch writes folders that bear its number, over what an earlier attempt at the same batch may have left: a replay changes
nothing. Reading takes the newest row of each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talkgrain.operators import lifecycle, summaries

CHUNK = "session_id long, idx long, status int, seq long"
SUMMARY = "session_id long, summary string"


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a table with their numbers; no rows if there is none yet."""
    full = StructType.fromDDL(f"{schema}, batch long")
    try:
        return spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def upsert_batch(rows: DataFrame, batch: int, path: str, keys: list[str], order: str) -> None:
    """Write the last row of each key, by `order`, as the batch's part of the table."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    last.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def current(spark: SparkSession, path: str, schema: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """The table after batch `upto` (else all): of each key the row of the latest batch."""
    rows = _written(spark, path, schema)
    rows = rows if upto is None else rows.where(F.col("batch") <= upto)
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("r")).select("r.*")


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], upto: int) -> None:
    """Fold all batches before `upto` into batch `upto`, so that reading does not grow with their number.

    Only batches that will not be replayed may be folded; `upto` itself keeps its newer rows. What it replaces is removed after the new part is there.
    """
    whole = current(spark, path, schema, keys, upto)
    whole.write.mode("overwrite").parquet(f"{path}/_folding")  # hidden from readers
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop.Path(f"{path}/batch={upto}"), True)
    fs.rename(hadoop.Path(f"{path}/_folding"), hadoop.Path(f"{path}/batch={upto}"))
    for status in fs.listStatus(hadoop.Path(path)):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < upto:
            fs.delete(status.getPath(), True)


def summarise_finalised(texts: DataFrame, root: str, sentences: int = 3) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over chunk states (session_id, idx, status, seq): a summary for each session that they make ready.

    texts: session_id, text. A session is ready when all its chunks are done; one that has a summary keeps it. Only the
    chunks of sessions that the batch touches are looked at, and only texts of ready ones are read on.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        upsert_batch(batch, number, f"{root}/chunks", ["session_id", "idx"], "seq")
        touched = spark.read.parquet(f"{root}/chunks/batch={number}").select("session_id").distinct()
        known = _written(spark, f"{root}/chunks", CHUNK).where(F.col("batch") <= number).join(touched, "session_id", "left_semi")
        states = known.groupBy("session_id", "idx").agg(F.max_by("status", "batch").alias("status"))
        ready = lifecycle.final_status(states, "session_id").where("state = 'ready'").select("session_id")
        had = _written(spark, f"{root}/summaries", SUMMARY).where(F.col("batch") < number).select("session_id")
        fresh = ready.join(had, "session_id", "left_anti")
        own = texts.join(fresh, "session_id", "left_semi").select(F.col("session_id").alias("doc_id"), "text")
        made = summaries.summary(own, k=sentences).select(F.col("doc_id").alias("session_id"), "summary")
        made.write.mode("overwrite").parquet(f"{root}/summaries/batch={number}")

    return step


def run(chunks: DataFrame, texts: DataFrame, root: str) -> DataFrame:
    """(session_id, summary) after everything that is there of a stream of chunk states; `root` holds tables and checkpoint."""
    job = chunks.writeStream.foreachBatch(summarise_finalised(texts, root)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return _written(chunks.sparkSession, f"{root}/summaries", SUMMARY).select("session_id", "summary")
