"""Extractive summaries: TF-IDF, lead, graph ranking; keywords and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions import terms
from talkgrain.functions import text as T

LEAST_WORDS = 5


def whole(docs: DataFrame) -> DataFrame:
    """doc_id, texts: a row a doc_id, so that what concerns one document is done in its row and no word is shuffled.

    The texts of a repeated doc_id are one document's; only then are texts shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.groupBy("doc_id").agg(F.collect_list(text).alias("texts"))
    return docs.select("doc_id", F.array(text).alias("texts"))


def by_document(docs: DataFrame) -> DataFrame:
    """doc_id, sents: array of (sentence, words), the sentences of five words or more in their order."""
    cut = lambda t, k: F.transform(T.sentences(t), lambda s, p: F.struct(p.alias("p"), k.alias("k"), s.alias("sentence"), T.words(s).alias("words")))
    each = F.flatten(F.transform("texts", lambda t, k: F.filter(cut(t, k), lambda x: F.size(x["words"]) >= LEAST_WORDS)))
    one = F.when(F.size("texts") > 1, F.array_sort(each)).otherwise(each)
    return whole(docs).select("doc_id", F.transform(one, lambda x: F.struct(x["sentence"].alias("sentence"), x["words"].alias("words"))).alias("sents"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, i (from 0, among kept ones), n, sentence, words: sentences of five words or more."""
    each = by_document(docs).select("doc_id", F.size("sents").cast("long").alias("n"), F.posexplode("sents").alias("i", "x"))
    return each.select("doc_id", "i", "n", "x.*")


def _gathered(sent: DataFrame) -> DataFrame:
    """Rows by document (doc_id, sents), as they are or from rows by sentence (doc_id, i, words and more)."""
    if "sents" in sent.columns:
        return sent
    rest = [c for c in sent.columns if c not in ("doc_id", "i", "n")]
    put = F.array_sort(F.collect_list(F.struct("i", F.struct(*rest).alias("x"))))
    return sent.groupBy("doc_id").agg(F.transform(put, lambda s: s["x"]).alias("sents"))


def _each(docs: DataFrame, name: str) -> DataFrame:
    """A row a score. Outer, as the optimizer else asks for the size of `scores` above the scan and so computes them there too."""
    return docs.select("doc_id", F.posexplode_outer("scores").alias("i", name)).where("i is not null")


def _words() -> Column:
    return F.transform("sents", lambda s: s["words"]).alias("words")


def tf_idf(sent: DataFrame) -> DataFrame:
    """doc_id, i, tfidf: sum of tf / len * ln(n / df), as a share of the document's largest; from `by_document` or `sentences`."""
    docs = _gathered(sent).select("doc_id", _words())
    return _each(terms.with_arrays(docs, "scores", "array<double>", lambda words: terms.scores_of(words, terms.Sentences.tf_idf), "words"), "tfidf")


def position(i: Column, n: Column) -> Column:
    return F.when(i == 0, 1.0).when(i == n - 1, 0.8).otherwise(1 - 0.5 * i / n)


def length_score(words: Column) -> Column:
    """1 from 10 to 40 words; from 0.6 at 5 up to it and down to 0.6 at 80; in proportion below and beyond."""
    return F.when(words < 5, words / 5.0).when(words < 10, 0.6 + 0.4 * (words - 5) / 5.0).when(words <= 40, 1.0).when(words <= 80, 0.6 + 0.4 * (1 - (words - 40) / 40.0)).otherwise(80.0 / words)


def density(sentence: Column, words: Column) -> Column:
    """Names by word, 1 at most."""
    return F.least(F.lit(1.0), T.name_count(sentence) / F.greatest(words, F.lit(1)))


def extractive_scored(docs: DataFrame, entities: bool = False) -> DataFrame:
    """doc_id, sents, scores: 0.4 TF-IDF + 0.3 position + 0.15 length, and 0.15 density of names if `entities`; a single sentence scores 1."""
    n = F.size("sents")

    def score(s: Column, i: Column) -> Column:
        w = s["w"]
        named = density(s["sentence"], w) if entities else F.lit(0.0)
        return F.when(n == 1, 1.0).otherwise(0.4 * F.get("tfidf", i) + 0.3 * position(i, n) + 0.15 * length_score(w) + 0.15 * named)

    short = F.transform("sents", lambda s: F.struct(s["sentence"].alias("sentence"), F.size(s["words"]).alias("w")))
    known = docs.where("doc_id is not null").select("doc_id", short.alias("sents"), _words())
    known = terms.with_arrays(known, "tfidf", "array<double>", lambda words: terms.scores_of(words, terms.Sentences.tf_idf), "words")
    return known.select("doc_id", "sents", F.transform("sents", score).alias("scores"))


def lead_scored(docs: DataFrame, entities: bool = False) -> DataFrame:
    """doc_id, sents, scores: 0.8 max(0, 1 - 0.15 i) + 0.1 length, and 0.1 density of names if `entities`; a single sentence scores 1."""

    def score(s: Column, i: Column) -> Column:
        w = F.size(s["words"])
        own = 0.8 * F.greatest(F.lit(0.0), 1 - 0.15 * i) + 0.1 * length_score(w)
        return own + 0.1 * density(s["sentence"], w) if entities else own

    # a document's sentences stand outside of the lambda: what is put in their place by the optimizer would be computed for each of them
    scores = F.when(F.size("sents") == 1, F.array(F.lit(1.0))).otherwise(F.transform("sents", score))
    return docs.select("doc_id", "sents", scores.alias("scores"))


def text_rank_scored(docs: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """doc_id, sents, scores by power iteration on cosine similarities of term counts (`terms.Sentences.ranks`)."""
    own = docs.select("doc_id", F.transform("sents", lambda s: s.dropFields("words")).alias("sents") if "sentence" in docs.schema["sents"].dataType.elementType.names else F.lit(None).alias("sents"), _words())
    return terms.with_arrays(own, "scores", "array<double>", lambda words: terms.scores_of(words, lambda s: s.ranks(damping, rounds, tolerance)), "words")


def extractive(sent: DataFrame, entities: bool = False) -> DataFrame:
    """doc_id, i, score of `extractive_scored`, from `by_document` or `sentences`."""
    return _each(extractive_scored(_gathered(sent), entities), "score")


def lead(sent: DataFrame, entities: bool = False) -> DataFrame:
    """doc_id, i, score of `lead_scored`, from `by_document` or `sentences`."""
    return _each(lead_scored(_gathered(sent), entities), "score")


def text_rank(sent: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """doc_id, i, score of `text_rank_scored`, from `by_document` or `sentences`."""
    scored = _each(text_rank_scored(_gathered(sent), damping, rounds, tolerance), "score")
    return scored.select("doc_id", F.col("i").cast("long").alias("i"), "score")


#: an algorithm is a function of `by_document` that adds scores, a number a sentence; more may be added
ALGORITHMS = {"extractive": extractive_scored, "lead": lead_scored, "textrank": text_rank_scored}


def summary(docs: DataFrame, algorithm: str = "extractive", k: int = 5) -> DataFrame:
    """doc_id, summary: the k best sentences in their order."""
    scored = ALGORITHMS[algorithm](by_document(docs).where("doc_id is not null"))
    ranked = F.array_sort(F.transform("sents", lambda s, i: F.struct((-F.round(F.get("scores", i), 9)).alias("s"), i.alias("i"), s["sentence"].alias("sentence"))))
    best = F.array_sort(F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["i"].alias("i"), x["sentence"].alias("sentence"))))
    return scored.where(F.size("sents") > 0).select("doc_id", F.array_join(F.transform(best, lambda x: x["sentence"]), " ").alias("summary"))


def _all_words(docs: DataFrame) -> DataFrame:
    """doc_id, texts, words: all words of a document in their order."""
    return whole(docs).select("doc_id", "texts", F.flatten(F.transform("texts", T.words)).alias("words"))


_TOP = "array<struct<word: string, n: long>>"


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode("top").alias("p", "x")).select("doc_id", "x.word", "x.n", (F.col("p") + 1).alias("place"))


def top_keywords(docs: DataFrame, k: int = 15) -> DataFrame:
    """doc_id, word, n, place: a document's most frequent words of two letters or more that are no stop words."""
    found = terms.with_arrays(_all_words(docs).drop("texts"), "top", _TOP, lambda words: terms.top_of(words, k, T.TOPIC_STOP_WORDS), "words")
    return _placed(found)


def named_entities(docs: DataFrame) -> DataFrame:
    """doc_id, text, n, kind: how often each name occurs in a document; its kind is that of its first place."""
    each = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("p", "sentence")).select("doc_id", "p", F.explode(T.names(F.col("sentence"))).alias("x"))
    return each.groupBy("doc_id", F.col("x.text").alias("text")).agg(F.count("*").alias("n"), F.min_by("x.kind", F.struct("p", "x.at")).alias("kind"))


def top_entities(docs: DataFrame, k: int = 15) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "text")
    return named_entities(docs).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_terms(docs: DataFrame, k: int = 15) -> DataFrame:
    """doc_id, word, n, place: keywords by their counts, names (of two letters or more) among them by twice theirs."""
    found = F.flatten(F.transform("texts", lambda t: F.flatten(F.transform(T.sentences(t), lambda s: F.transform(T.names(s), lambda x: x["text"])))))
    both = _all_words(docs).select("doc_id", "words", found.alias("names"))
    return _placed(terms.with_arrays(both, "top", _TOP, lambda words, names: terms.top_of(words, k, T.TOPIC_STOP_WORDS, names), "words", "names"))


def co_occurring(docs: DataFrame, k: int = 20, reach: int = 49) -> DataFrame:
    """doc_id, a, b: pairs of a document's top keywords that stand within `reach` of each other in its keyword stream."""
    known = _all_words(docs).where("doc_id is not null").drop("texts")
    known = terms.with_arrays(known, "pairs", "array<struct<a: string, b: string>>", lambda words: terms.pairs_of(words, k, reach, T.TOPIC_STOP_WORDS), "words")
    return known.select("doc_id", F.explode("pairs").alias("x")).select("doc_id", "x.*")


def topics(docs: DataFrame, k: int = 20, most: int = 5, reach: int = 49) -> DataFrame:
    """doc_id, place, label, members, weight: clusters of a document's top keywords, in the order of their counts.

    A keyword that is in no cluster yet takes all such keywords that stand near it, itself among them; a cluster weighs the
    sum of their counts, as a share of the document's largest.
    """
    kind = "array<struct<label: string, members: array<string>, weight: double>>"
    found = terms.with_arrays(_all_words(docs).drop("texts"), "found", kind, lambda words: terms.topics_of(words, k, most, reach, T.TOPIC_STOP_WORDS), "words")
    each = found.select("doc_id", F.posexplode("found").alias("place", "x"))
    return each.select("doc_id", F.col("place").cast("long").alias("place"), "x.*")
