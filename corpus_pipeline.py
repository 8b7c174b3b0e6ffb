"""Documents to packed training sequences: language, near duplicates, benchmark leaks, secrets, packing.

Every stage takes the columns of documents and leaves others, whatever their names, behind. An empty table gives an empty result; texts
are taken whole, however long; null and empty texts have no letter and go in the first stage, later ones would keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.llm import langid
from talkgrain.llm.common import has_odd_ids, keyed, materialize
from talkgrain.llm.decontaminate import without_leaks
from talkgrain.llm.near_dedup import near_duplicates
from talkgrain.llm.packing import pack
from talkgrain.llm.secrets import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: a prediction that is less sure than this rejects the document; four languages that are all alike have a quarter each
SURE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is not told apart from the others, go; decided row by row.

    Rows that repeat a doc_id, or have none, are judged by their own texts; rows of one text share their fate.
    """
    docs = docs.select(COLUMNS)
    found = langid.judge(docs, langid.fit(docs))
    return docs.where((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= SURE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id, null ones last.

    Rows that repeat a doc_id are compared by their own texts; identical rows are one, even without a word.
    """
    docs = docs.select(COLUMNS)
    docs = materialize(docs.distinct(), "distinct") if has_odd_ids(docs) else docs
    rows = keyed(docs, "_row")
    copies = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).where("not kept")
    return rows.join(copies.select(F.col("doc_id").alias("_row")), "_row", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; decided row by row, without a join. Null texts hold none."""
    return without_leaks(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the texts; every document stays, a null text as it is. n_chars is that of the new text."""
    clean = redact(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a training sequence; rows that repeat a doc_id are packed one by one."""
    return pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]
#: no stage but the joins between them can be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
