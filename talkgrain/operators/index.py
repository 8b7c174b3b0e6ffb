"""A full-text index that is kept up: a base, later generations beside it, and marks for what they replace or remove.

Tables below `root`, by generation: docs (key, dl), postings (key, term, places; by bucket of the term, so that a search reads those of its
terms only) and gone (key; the segment's part is null where a whole session goes). A row is live unless a mark of a later
generation, or of the same one for upserts, stands against its key. Every step writes folders of its own generation over what a failed attempt left.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.functions import terms
from talkgrain.functions import text as T
from talkgrain.operators import search

BUCKETS = 16


@dataclass
class SearchIndex:
    """`key` names the columns of a segment's key, the session first."""

    spark: SparkSession
    root: str
    key: tuple[str, ...]

    def _write(self, df: DataFrame, table: str, gen: int, by: list[str] | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{table}/gen={gen}")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}/gen=*")

    def _add(self, segments: DataFrame, gen: int) -> None:
        """Docs and postings of segments (key, text); the texts are cut once for each of the two.

        Places are gathered in a segment's row, so no token is shuffled; only postings of repeated keys are put together after that.
        """
        listed = segments.select(*self.key, T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
        self._write(listed.select(*self.key, F.size("t").cast("long").alias("dl")), "docs", gen)
        own = terms.with_arrays(listed, "own", "array<struct<term: string, places: array<int>>>", terms.places_of, "t")
        each = own.select(*self.key, F.explode("own").alias("x")).select(*self.key, "x.*")
        if segments.groupBy(*self.key).count().where("count > 1").limit(1).count():
            each = each.groupBy(*self.key, "term").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
        self._write(each.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int")), "postings", gen, ["bucket"])

    def rebuild(self, segments: DataFrame, gen: int = 0) -> None:
        """An index of these segments alone, as generation `gen`; all others go once it is there."""
        none = segments.select(*self.key).limit(0)
        self._add(segments, gen)
        self._write(none, "gone", gen)
        self._drop(lambda g: g != gen)

    def upsert(self, segments: DataFrame, gen: int) -> None:
        """Segments replaced by key, new ones added."""
        self._write(segments.select(*self.key).distinct(), "gone", gen)
        self._add(segments, gen)

    def remove(self, keys: DataFrame, gen: int) -> None:
        self._write(keys.select(*self.key).distinct(), "gone", gen)

    def remove_sessions(self, sessions: DataFrame, gen: int) -> None:
        kinds = dict(self._read("docs").dtypes)
        rest = [F.lit(None).cast(kinds[k]).alias(k) for k in self.key[1:]]
        self._write(sessions.select(self.key[0], *rest).distinct(), "gone", gen)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows against which no later mark stands; the newest mark of each segment and of each session is looked up."""
        gone = self._read("gone").withColumnRenamed("gen", "_g")
        whole = reduce(lambda a, b: a & b, [F.col(k).isNull() for k in self.key[1:]], F.lit(True))
        newest = lambda df, on, name: df.groupBy(*on).agg(F.max("_g").alias(name))
        single = newest(gone.where(~whole) if len(self.key) > 1 else gone, list(self.key), "_one")
        found = rows.join(single, list(self.key), "left")
        if len(self.key) > 1:
            found = found.join(newest(gone.where(whole), [self.key[0]], "_all"), self.key[0], "left")
            found = found.where(F.coalesce(F.col("_all") <= F.col("gen"), F.lit(True))).drop("_all")
        return found.where(F.coalesce(F.col("_one") <= F.col("gen"), F.lit(True))).drop("_one")

    def docs(self) -> DataFrame:
        return self._live(self._read("docs")).select(*self.key, "dl")

    def postings(self, asked: list[str] | None = None) -> DataFrame:
        """key, term, places; of some terms only, whose buckets alone are read."""
        rows = self._read("postings")
        if asked is not None:
            rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in asked}))).where(F.col("term").isin(asked))
        return self._live(rows).select(*self.key, "term", "places")

    def search(self, query: list[str]) -> DataFrame:
        """key and rank of the segments that hold all terms, as `search.bm25` of the texts gives them."""
        asked = search.phrases(query)
        if not asked:
            return self.docs().select(*self.key, F.lit(0.0).alias("rank")).limit(0)
        parts = [(i, k, len(p), w) for i, p in enumerate(asked) for k, w in enumerate(p)]
        wanted = self.spark.createDataFrame(parts, "phrase int, k int, size int, term string")
        found = self.postings(sorted({w for p in asked for w in p})).join(F.broadcast(wanted), "term")  # a row a token of the query
        begins = found.select(*self.key, "phrase", "size", F.explode(F.transform("places", lambda p: p - F.col("k"))).alias("begin"))
        votes = begins.groupBy(*self.key, "phrase", "size", "begin").agg(F.count("*").alias("n")).where("n = size")
        tfs = votes.groupBy(*self.key).agg(F.array(*[F.count_if(F.col("phrase") == i) for i in range(len(asked))]).alias("tfs"))
        docs = self.docs()
        totals = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        return search.ranked(tfs.join(docs, list(self.key)), list(self.key), len(asked), totals)

    def compact(self, gen: int) -> None:
        """One generation of what is live, without marks; the others go once it is there."""
        docs, postings = self.docs(), self.postings()
        self._write(docs, "docs", gen)
        self._write(postings.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int")), "postings", gen, ["bucket"])
        self._write(docs.select(*self.key).limit(0), "gone", gen)
        self._drop(lambda g: g != gen)

    def _drop(self, old) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for table in ("docs", "postings", "gone"):
            for status in fs.listStatus(hadoop.Path(f"{self.root}/{table}")):
                name = status.getPath().getName()
                if name.startswith("gen=") and old(int(name[4:])):
                    fs.delete(status.getPath(), True)
