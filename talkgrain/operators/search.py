"""Full-text search over postings, and keyword questions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.functions import text as T
from talkgrain.operators.filters import contains_folded
from talkgrain.sources.scratch import materialize

K1, B = 1.2, 0.75
#: hits that are kept before any filter
HIT_CAP = 200


def postings(segments: DataFrame, key: list[str]) -> DataFrame:
    """key, term, tf, dl: how often each token occurs in a segment, and the segment's length in tokens."""
    listed = segments.select(*key, T.tokens(F.col("text")).alias("t"))
    each = listed.select(*key, F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy(*key, "dl", "term").agg(F.count("*").alias("tf"))


def phrases(query: list[str]) -> list[tuple[str, ...]]:
    """The distinct terms of a query as tokens, cut as texts are; a term with punctuation inside is a phrase."""
    return list(dict.fromkeys(t for q in query if (t := tuple(w for w in re.split(r"[\W_]+", T.folded(q)) if w))))


def _counted(t: Column, phrase: tuple[str, ...]) -> Column:
    """How often a phrase's tokens stand next to each other in the tokens `t`."""
    if len(phrase) == 1:
        return F.size(F.filter(t, lambda w: w == phrase[0]))
    last = F.size(t) - len(phrase)
    starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
    there = lambda i: reduce(lambda a, b: a & b, [F.get(t, i - 1 + k) == w for k, w in enumerate(phrase)])
    return F.size(F.filter(starts, there))


def occurrences(segments: DataFrame, key: list[str], asked: list[tuple[str, ...]]) -> DataFrame:
    """key, dl, tfs: the tokens of each segment, and how often it has each phrase; a row a segment, without a shuffle."""
    listed = segments.select(*key, T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return listed.select(*key, F.size("t").cast("long").alias("dl"), F.array(*[_counted(F.col("t"), p).cast("long") for p in asked]).alias("tfs"))


def ranked(found: DataFrame, key: list[str], n_phrases: int, totals: DataFrame | None = None) -> DataFrame:
    """key and rank from rows (key, dl, tfs) of all segments, of which those without all phrases only count in the totals.

    `totals` (n, avgdl) is a row for all segments where `found` has only those with a phrase. `found` is read twice: for the
    totals, one row, and for the scores.
    """
    ns = range(n_phrases)
    df = F.array(*[F.count_if(F.get("tfs", i) > 0) for i in ns]).alias("df")
    stats = found.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), df) if totals is None else totals.crossJoin(found.agg(df))
    hits = found.where(reduce(lambda a, b: a & b, [F.get("tfs", i) > 0 for i in ns])).crossJoin(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    idf = lambda i: F.greatest(F.lit(1e-6), F.log((F.col("n") - F.get("df", i) + 0.5) / (F.get("df", i) + 0.5)))
    score = reduce(lambda a, b: a + b, [idf(i) * F.get("tfs", i) * (K1 + 1) / (F.get("tfs", i) + norm) for i in ns])
    return hits.select(*key, (-score).alias("rank"))


def bm25(segments: DataFrame, key: list[str], query: list[str]) -> DataFrame:
    """key and rank (minus the BM25 score, so that better is less) of the segments that hold all terms.

    A term of several tokens, such as "e-mail" or a quoted phrase, must be there with its tokens next to each other. To search one
    session, give its segments only. A query without a token finds nothing. The texts are cut once; what is counted is written
    and read for totals and scores.
    """
    asked = phrases(query)
    if not asked:
        return segments.select(*key, F.lit(0.0).alias("rank")).limit(0)
    return ranked(materialize(occurrences(segments, key, asked), "occurrences"), key, len(asked))


def capped(hits: DataFrame, key: list[str], cap: int = HIT_CAP) -> DataFrame:
    """The best hits; facets apply after this cap, as the feature wants it."""
    return hits.orderBy("rank", *key).limit(cap)


def substring_hits(segments: DataFrame, query: str) -> DataFrame:
    return segments.where(contains_folded(F.col("text"), query))


def answers(segments: DataFrame, question: list[str], limit: int = 10) -> DataFrame:
    """Segments that hold any keyword, each once by its first keyword, the first `limit` of them."""
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(w).alias("keyword")) for i, w in enumerate(question)]))
    pairs = segments.withColumn("q", asked).select("*", "q.*").drop("q")
    hit = pairs.where(F.contains(F.collate("text", "UNICODE_CI_AI"), F.collate("keyword", "UNICODE_CI_AI")))
    first = hit.groupBy("session_id", "ordinal").agg(F.min("ord").cast("long").alias("ord"))
    return first.orderBy("ord", "session_id", "ordinal").limit(limit)


def snippet(text: Column, query: list[str], width: int = 32) -> Column:
    """The `width` words with most of the query's distinct terms, the first of equals, each term's places in <b>; null without any.

    Words are what white space parts; a term's tokens may lie in several words or several in one. Windows begin at a term's
    place, or earlier where the text ends. A window is compared with the places that can lie in it, so the work grows with
    the places and not with their square.
    """
    asked = phrases(query)
    one = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  computed once

    def tokens(w: Column) -> Column:
        """T.tokens of a word; most words are one token as they stand."""
        return F.when(w.rlike("^[a-z0-9]+$"), F.array(w)).otherwise(T.tokens(w))

    def places(words: Column) -> Column:
        """Places (word, last word, term) by word."""
        cut = F.flatten(F.transform(words, lambda w, i: F.transform(tokens(w), lambda t: F.struct(i.alias("i"), t.alias("t")))))

        def of(tokens: Column, q: int) -> Column:
            phrase = asked[q]
            last = F.size(tokens) - len(phrase)
            there = lambda i: reduce(lambda a, b: a & b, [F.get(tokens, i + k)["t"] == w for k, w in enumerate(phrase)])
            starts = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)")), there)
            return F.transform(starts, lambda i: F.struct(F.get(tokens, i)["i"].alias("a"), F.get(tokens, i + len(phrase) - 1)["i"].alias("b"), F.lit(q).alias("q")))

        return one(cut, lambda tokens: F.array_sort(F.concat(*[of(tokens, q) for q in range(len(asked))])))

    def best(words: Column, hits: Column) -> Column:
        """The first word of the window with most terms."""
        n = F.size(words)

        def inside(h: Column, i: Column, start: Column, most: Column) -> Column:
            """Terms in the window from `start`, of which h, the i-th place, is one; it can hold `most` places."""
            first = F.greatest(i + 1 - F.when(start < h["a"], most).otherwise(0), F.lit(1))
            own = F.filter(F.slice(hits, first, 2 * most), lambda x: (x["a"] >= start) & (x["b"] < start + width))
            return F.size(F.array_distinct(F.transform(own, lambda x: x["q"])))

        def windows(most: Column) -> Column:
            start = lambda h: F.greatest(F.least(h["a"], n - width), F.lit(0))
            return F.array_min(F.transform(hits, lambda h, i: one(start(h), lambda at: F.struct((-inside(h, i, at, most)).alias("c"), at.alias("s")))))["s"]

        # the most tokens of a word, for each of `width` words and each term; computed once for all windows
        held = F.array_max(F.transform(words, lambda w: F.greatest(F.length(w) - F.length(F.regexp_replace(w, "[^\\p{L}\\p{N}]", "")) + 1, F.lit(1)))) * width * len(asked)
        return one(held, windows)

    def marked(words: Column, hits: Column, start: Column) -> Column:
        shown = F.slice(words, start + 1, width)
        inside = F.filter(hits, lambda x: (x["a"] >= start) & (x["b"] < start + width))

        def mark(own: Column) -> Column:
            opened = lambda w, i: F.when(F.exists(own, lambda x: x["a"] == i + start), F.concat(F.lit("<b>"), w)).otherwise(w)
            closed = lambda w, i: F.when(F.exists(own, lambda x: x["b"] == i + start), F.concat(w, F.lit("</b>"))).otherwise(w)
            body = F.array_join(F.transform(shown, lambda w, i: closed(opened(w, i), i)), " ")
            return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + width < F.size(words), "...").otherwise(""))

        return one(inside, mark)

    if not asked:
        return F.lit(None).cast("string")
    whole = lambda words: one(places(words), lambda hits: F.when(F.size(hits) > 0, one(best(words, hits), lambda s: marked(words, hits, s))))
    return one(F.filter(F.split(text, "\\s+"), lambda w: w != ""), whole)


def union_in_order(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct keys, those of `first` before those of `second`, each at its first place (column place in both)."""
    ranked = first.select(key, F.lit(0).alias("source"), "place").unionByName(second.select(key, F.lit(1).alias("source"), "place"))
    best = ranked.groupBy(key).agg(F.min(F.struct("source", "place")).alias("b"))
    return best.select(key, F.col("b.source").cast("long").alias("source"), F.col("b.place").cast("long").alias("place"))
