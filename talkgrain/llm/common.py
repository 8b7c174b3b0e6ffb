"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.sources.scratch import discard, materialize, scratch_root  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def has_odd_ids(docs: DataFrame) -> bool:
    """Whether a doc_id is null or repeated."""
    return bool(docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count())


def keyed(docs: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """`docs` with a long `key` that is never null or repeated, has the order of doc_id (null ones last) and is fixed before use.

    `order` may name another order of null and repeated ids, by columns of which the first is doc_id.

    That is doc_id itself unless one is null or repeated; else the rows are numbered by a sort and written once. Equal ids
    are sorted by where they are read, so that they spread over the tasks.
    """
    if not has_odd_ids(docs):
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    ordered = docs.withColumn(key, F.monotonically_increasing_id()).orderBy(*(order or [F.col("doc_id").asc_nulls_last()]), key)
    return materialize(ordered.withColumn(key, F.monotonically_increasing_id()), "rows")
