"""License mentions by diagonal voting.

DataFrame functions only. The hashes of all rolling word k-grams of a document (two words for the base phrases, TEXT_WORDS for
notices and whole license texts) are joined with the k-grams of the templates; a match counts if its words are equal too, and
votes for the diagonal (position in the document minus position in the template). Votes are counted by document, template
and diagonal; neighbouring diagonals, which stand for inserted or missing words, are merged; a span counts if the k-grams
verified in it cover enough of the template. A base phrase needs all of its k-grams on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.common import materialize
from talkgrain.llm.license_texts import BASE, NOTICES, TEXTS

BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: words of a k-gram of a notice or text (two pairs of words); a template has at least so many
TEXT_WORDS = 4
#: diagonals this near are one span
NEAR = 3
#: share of its k-grams that a span must cover, of a notice and of a whole text
COVER, TEXT_COVER = 0.9, 0.7


def words(text: Column) -> Column:
    """Words of a text in lower case. No character outside ASCII has a lower case that a phrase here could be spelt with."""
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def _joined(h: str, apart: int) -> Column:
    """Hash of each element of the array `h` of hashes and the one `apart` places on."""
    n = F.greatest(F.size(h) - apart, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + apart), n), lambda a, b: F.xxhash64(a, b))


def _hashed(table: DataFrame) -> DataFrame:
    """`table` with its array `w` of words hashed one by one, as `wh`, their 2-grams as `pairs` and 4-grams as `longs`."""
    hashed = table.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    return hashed.withColumn("pairs", _joined("wh", 1)).withColumn("longs", _joined("pairs", 2))


def templates(spark, base: list[tuple[str, str]], notices: list[tuple[str, str]], texts: list[tuple[str, str]]) -> DataFrame:
    """template, label, is_base, least, grams, k, at, h, gram: one row per k-gram; about as many rows as the lists have words."""
    rows = [(i, t, label, i < len(base), 1.0 if i < len(base) else COVER if i < len(base + notices) else TEXT_COVER) for i, (t, label) in enumerate(base + notices + texts)]
    table = spark.createDataFrame(rows, "template int, t string, label string, is_base boolean, least double")
    split = _hashed(table.withColumn("w", words(F.col("t"))))
    k = F.when(F.col("is_base"), 2).otherwise(TEXT_WORDS)
    own = split.select("template", "label", "is_base", "least", k.alias("k"), "w", F.posexplode(F.when(F.col("is_base"), F.col("pairs")).otherwise(F.col("longs"))).alias("at", "h"))
    grams = (F.size("w") - F.col("k") + 1).alias("grams")
    return own.select("template", "label", "is_base", "least", grams, "k", "at", "h", F.array_join(F.slice("w", F.col("at") + 1, F.col("k")), " ").alias("gram"))


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    `docs` needs doc_id and text; other columns are not looked at. A null or empty text has no words, no labels and score 0.
    Null and repeated doc_ids give a row per row. An empty table gives an empty result. score is the largest share of a
    template's k-grams that a counted span covers, 1 with a base phrase. Base phrases have two words or more, notices and
    texts TEXT_WORDS or more.

    The documents are read and split once: each row explodes into one row for itself, by which its words are counted, and
    one for each k-gram, and only what meets a template is written.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = _hashed(docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), words(text).alias("w")))
    n = F.size("w")
    each = own.select("doc_id", "row", "w", n.cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "pairs", "longs")).alias("i", "h"))
    pairs = F.greatest(n - 1, F.lit(0))
    wide = F.col("i") > pairs
    pos = F.when(F.col("i") == 0, -1).when(wide, F.col("i") - pairs - 1).otherwise(F.col("i") - 1)
    placed = each.select("doc_id", "row", "n_words", "w", "h", pos.alias("pos"), F.when(F.col("i") == 0, 0).when(wide, TEXT_WORDS).otherwise(2).alias("kd"))
    # as many rows as the lists of templates have words, whatever the corpus; k = 0 stands for the document itself
    table = templates(docs.sparkSession, base, notices, texts)
    itself = table.limit(0).unionByName(docs.sparkSession.range(1).selectExpr("-1 template", "'' label", "false is_base", "1D least", "1 grams", "0 k", "0 at", "0L h", "'' gram"))
    hits = placed.join(F.broadcast(table.unionByName(itself)), "h").where((F.col("k") == F.col("kd")) & ((F.col("k") == 0) | (F.array_join(F.slice("w", F.col("pos") + 1, F.col("k")), " ") == F.col("gram"))))
    hits = materialize(hits.select("doc_id", "row", "n_words", "template", "label", "is_base", "least", "grams", "k", "at", "pos"), "license-hits")

    key = ["row", "template", "label", "is_base", "least", "grams"]
    votes = hits.where("k > 0").groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"))
    places = votes.where("is_base and size(at) = grams").select("row", "label", "diagonal", F.lit(1.0).alias("cover"), F.lit(True).alias("is_base"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > NEAR, F.lit(False)).cast("int")
    merged = votes.where("not is_base").withColumn("apart", apart).withColumn("span", F.sum("apart").over(by)).groupBy(*key, "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"), F.min("diagonal").alias("diagonal"))
    spans = merged.withColumn("cover", F.col("n") / F.col("grams")).where("cover >= least").select("row", "label", "diagonal", "cover", F.lit(False).alias("is_base"))

    only = lambda c: F.when(F.col("is_base"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = places.unionByName(spans).groupBy("row").agg(
        F.count(only("diagonal")).alias("n_base"), F.min(only("diagonal")).cast("long").alias("first_word"), F.max(only("diagonal")).cast("long").alias("last_word"), joined(only("label")).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("cover").alias("score")
    )
    out = hits.where("k = 0").select("doc_id", "row", "n_words").join(found, "row", "left")
    zero = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").fillna(zero)
