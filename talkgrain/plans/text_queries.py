"""Scalar text functions, similarity of texts, summaries and keywords."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrain.functions import text as T
from talkgrain.operators import joins, summaries
from talkgrain.plans.register import registered
from talkgrain.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}
query = registered(QUERIES, ORACLE_SQL)

_listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_STOP, _TOPIC_STOP = _listed(T.STOP_WORDS), _listed(T.TOPIC_STOP_WORDS)
_settled = lambda x: f"floor(({x}) * 1000000 + 0.5001) / 1000000"


def _pieces(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '\\s+'), lambda p: regexp_replace(p, '^[\\p{{P}}\\p{{S}}]+|[\\p{{P}}\\p{{S}}]+$', '', 'g')), lambda p: p <> '')"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '\\s+'), lambda w: w <> '')"


@query("select conv_id, turn, regexp_replace(regexp_replace('  ' || text || ' ' || chr(10), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') as collapsed, length(regexp_replace('  ' || text || ' ' || chr(10), '^\\s+|\\s+$', '', 'g')) as trimmed from conversations")
def trimmed_texts(spark, sf_dir):
    """Trimmed, and with single spaces."""
    padded = F.concat(F.lit("  "), "text", F.lit(" \n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.collapse(padded).alias("collapsed"), F.length(T.trim(padded)).cast("long").alias("trimmed"))


@query(f"select conv_id, turn, array_to_string({_pieces('text')}, '|') as terms from conversations")
def query_terms(spark, sf_dir):
    """Terms of a search query."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.search_terms(F.col("text")), "|").alias("terms"))


@query(f"select conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda p: regexp_replace(p, '^\\p{{P}}+|\\p{{P}}+$', '', 'g')), lambda w: length(w) >= 2 and not list_contains({_STOP}, w)), '|') as keywords from conversations")
def question_keywords(spark, sf_dir):
    """Keywords of a question."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.keywords(F.col("text")), "|").alias("keywords"))


@query(
    f"with w as (select conv_id, turn, list_distinct({_pieces('lower(text)')}) as s from conversations), p as (select conv_id, turn, s, lag(s) over (partition by conv_id order by turn) as b from w) "
    "select conv_id, turn, round(case when len(list_distinct(list_concat(s, b))) = 0 then 0 else len(list_intersect(s, b)) / len(list_distinct(list_concat(s, b)))::double end, 6) as jaccard from p where b is not null"
)
def turn_similarity(spark, sf_dir):
    """Word sets of successive turns."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.word_set(F.col("text")).alias("s"))
    p = w.withColumn("b", F.lag("s").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return p.select("conv_id", "turn", F.round(T.jaccard(F.col("s"), F.col("b")), 6).alias("jaccard"))


@query(
    "with t as (select conv_id, turn, text as a, lag(text) over (partition by conv_id order by turn) as b from conversations), "
    "x as (select conv_id, turn, unnest(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) as g from t where b is not null), y as (select conv_id, turn, unnest(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) as g from t where b is not null), "
    "xc as (select conv_id, turn, g, count(*) as c from x group by all), yc as (select conv_id, turn, g, count(*) as c from y group by all), s as (select conv_id, turn, sum(least(xc.c, yc.c)) as o from xc join yc using (conv_id, turn, g) group by 1, 2) "
    "select conv_id, turn, round(case when a = b then 1 when length(a) < 2 or length(b) < 2 then 0 else coalesce(2.0 * o / (length(a) + length(b) - 2), 0) end, 6) as dice from t left join s using (conv_id, turn) where b is not null"
)
def turn_dice(spark, sf_dir):
    """Character bigrams of successive turns as multisets."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    count = lambda c: t.select("conv_id", "turn", F.explode(T.bigrams(F.col(c))).alias("g")).groupBy("conv_id", "turn", "g").agg(F.count("*").alias(f"n_{c}"))
    shared = count("a").join(count("b"), ["conv_id", "turn", "g"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n_a", "n_b")).alias("o"))
    size = F.length("a") + F.length("b") - 2
    dice = F.when(F.col("a") == F.col("b"), 1.0).when((F.length("a") < 2) | (F.length("b") < 2), 0.0).otherwise(F.coalesce(2.0 * F.col("o") / size, F.lit(0.0)))
    return t.join(shared, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(dice, 6).alias("dice"))


@query(
    "with t as (select conv_id, turn, text as a, lag(text) over (partition by conv_id order by turn) as b from conversations) "
    "select conv_id, turn, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda k: substr(a, 1, k) = substr(b, 1, k))) as shared, starts_with(a, b) as grows from t where b is not null"
)
def turn_prefix(spark, sf_dir):
    """How many leading characters successive turns share."""
    b = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), b.alias("b")).where("b is not null")
    return t.select("conv_id", "turn", T.common_prefix(F.col("a"), F.col("b")).cast("long").alias("shared"), F.startswith("a", "b").alias("grows"))


@query(f"with i as (select item_id as l, list_distinct({_pieces('lower(text)')}) as a from benchmark), d as (select doc_id as r, list_distinct({_pieces('lower(text)')}) as b from documents) select l, r, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double, 6) as similarity from i, d where len(list_intersect(a, b)) >= 0.3 * len(list_distinct(list_concat(a, b))) and len(a) > 0")
def similar_passages(spark, sf_dir):
    """Documents whose word set is like that of an item."""
    left = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("l"), T.word_set(F.col("text")).alias("set"))
    right = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("r"), T.word_set(F.col("text")).alias("set"))
    return joins.similar_texts(left, right).select("l", "r", F.round("similarity", 6).alias("similarity"))


@query()
def matched_edits(spark, sf_dir):
    """Each item takes the best document that no earlier one took (tested against a plain loop)."""
    found = similar_passages(spark, sf_dir).withColumn("session", F.lit(0).cast("long"))
    return joins.greedy_in_order(found, ["session"])


_SPLIT = "list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。！？])\\s*', '\\1' || chr(10), 'g'), '\\n+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
_SENT = (
    f"x as (select doc_id, unnest({_SPLIT}) as sentence, generate_subscripts({_SPLIT}, 1) as p from documents), y as (select *, {_words('sentence')} as words from x), "
    "sent as (select doc_id, sentence, words, len(words) as w, row_number() over (partition by doc_id order by p) - 1 as i, count(*) over (partition by doc_id) as n from y where len(words) >= 5)"
)
_TFIDF = (
    f"{_SENT}, tok as (select doc_id, i, n, w, unnest(words) as term from sent), tf as (select doc_id, i, n, w, term, count(*) as tf from tok group by all), "
    "d as (select *, count(*) over (partition by doc_id, term) as df from tf), raw as (select doc_id, i, sum(tf / w * ln(n / df)) as raw from d group by 1, 2), "
    "tfidf as (select doc_id, i, case when max(raw) over (partition by doc_id) > 0 then raw / max(raw) over (partition by doc_id) else 0 end as tfidf from raw)"
)
_LENGTH = "case when w < 5 then w / 5.0::double when w < 10 then 0.6::double + 0.4::double * (w - 5) / 5 when w <= 40 then 1 when w <= 80 then 0.6::double + 0.4::double * (1 - (w - 40) / 40.0::double) else 80.0::double / w end"
_POSITION = "case when i = 0 then 1 when i = n - 1 then 0.8 else 1 - 0.5 * i / n end"
_SCORES = f"{_TFIDF}, scores as (select doc_id, i, sentence, case when n = 1 then 1.0 else 0.4 * tfidf + 0.3 * {_POSITION} + 0.15 * {_LENGTH} end as score from sent join tfidf using (doc_id, i))"


def _sentences(spark, sf_dir):
    return summaries.by_document(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"with {_SENT} select doc_id, i, n, w as words, sentence from sent")
def sentence_list(spark, sf_dir):
    """S111: sentences of five words or more."""
    found = summaries.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("i").cast("long").alias("i"), "n", F.size("words").cast("long").alias("words"), "sentence")


@query(f"with {_TFIDF} select doc_id, i, {_settled('tfidf')} as tfidf from tfidf")
def sentence_tf_idf(spark, sf_dir):
    """S53, S112: TF-IDF scores of sentences."""
    return summaries.tf_idf(_sentences(spark, sf_dir)).select("doc_id", F.col("i").cast("long").alias("i"), T.settled(F.col("tfidf")).alias("tfidf"))


@query(f"with {_SCORES} select doc_id, i, {_settled('score')} as score from scores")
def extractive_scores(spark, sf_dir):
    """S113, S116: composite scores of sentences."""
    return summaries.extractive(_sentences(spark, sf_dir)).select("doc_id", F.col("i").cast("long").alias("i"), T.settled(F.col("score")).alias("score"))


@query(f"with {_SENT} select doc_id, i, floor(1000000 * (case when n = 1 then 1.0::double else 0.8::double * greatest(0, 1 - 0.15::double * i) + 0.1::double * {_LENGTH} end) + 0.5001) / 1000000 as score from sent")
def lead_scores(spark, sf_dir):
    """S115: lead scores of sentences."""
    return summaries.lead(_sentences(spark, sf_dir)).select("doc_id", F.col("i").cast("long").alias("i"), T.settled(F.col("score")).alias("score"))


@query(f"with {_SCORES}, r as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, i) as r from scores) select doc_id, string_agg(sentence, ' ' order by i) as summary from r where r <= 5 group by 1")
def summary_texts(spark, sf_dir):
    """The five best sentences in their order."""
    return summaries.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def text_rank_scores(spark, sf_dir):
    """S114: graph ranks of sentences (tested against a plain power iteration)."""
    return summaries.text_rank(_sentences(spark, sf_dir)).select("doc_id", "i", F.round("score", 6).alias("score"))


_KEYWORDS = f"k as (select doc_id, word, count(*) as n from (select doc_id, unnest({_words('text')}) as word from documents) where length(word) >= 2 and not list_contains({_TOPIC_STOP}, word) group by all)"


@query(f"with {_KEYWORDS}, r as (select *, row_number() over (partition by doc_id order by n desc, word) as place from k) select * from r where place <= 15")
def keyword_list(spark, sf_dir):
    """S76, S117: the fifteen most frequent keywords of each document."""
    return summaries.top_keywords(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("place", F.col("place").cast("long"))


#: names in all sentences (x of _SENT): runs of capitalised words, their first words' places and kinds
_NAMES = (
    "nw as (select doc_id, p, unnest(regexp_split_to_array(sentence, '\\s+')) as w, generate_subscripts(regexp_split_to_array(sentence, '\\s+'), 1) as k from x), "
    "nb as (select doc_id, p, k, regexp_replace(w, '^[\\p{P}\\p{S}]+|[\\p{P}\\p{S}]+$', '', 'g') as bare, regexp_matches(w, '[\\p{P}\\p{S}]$') as ends, regexp_matches(w, '^[\\p{P}\\p{S}]') as begins from nw), "
    "nf as (select *, k > 1 and regexp_matches(bare, '^\\p{Lu}[\\p{Ll}\\p{M}''’]+(?:-\\p{Lu}?[\\p{Ll}\\p{M}''’]+)*$') as named from nb), "
    "nj as (select *, named and coalesce(lag(named) over o, false) and not coalesce(lag(ends) over o, false) and not begins as joined, lower(lag(bare) over o) as before from nf window o as (partition by doc_id, p order by k)), "
    "nr as (select *, sum(case when named and not joined then 1 else 0 end) over (partition by doc_id, p order by k) as run from nj), nn as (select *, row_number() over (partition by doc_id, p, run order by k) as r from nr where named), "
    f"names as (select doc_id, p, run, min(k) as k, string_agg(bare, ' ' order by k) as text, case when list_contains({_listed(T.TITLES)}, min_by(before, k)) then 'person' when list_contains({_listed(T.ORGANISATIONS)}, max_by(bare, k)) then 'organization' "
    f"when list_contains({_listed(T.PLACES)}, min_by(before, k)) then 'place' else 'name' end as kind from nn where r <= {T.NAME_WORDS} group by 1, 2, 3)"
)
_ENTITIES = f"{_NAMES}, entities as (select doc_id, text, count(*) as n, min_by(kind, struct_pack(p, k)) as kind from names group by 1, 2)"
#: _SENT with each sentence's density of names
_DENSE = f"{_NAMES}, ps as (select doc_id, p, row_number() over (partition by doc_id order by p) - 1 as i, len(words) as w from y where len(words) >= 5), dense as (select doc_id, i, least(1.0::double, (select count(*) from names m where m.doc_id = ps.doc_id and m.p = ps.p) / w) as e from ps)"


@query(f"with {_SENT}, {_ENTITIES}, r as (select *, row_number() over (partition by doc_id order by n desc, text) as place from entities) select doc_id, text, n, kind, place from r where place <= 15")
def named_entities(spark, sf_dir):
    """S76, S117: the fifteen most frequent names of each document and their kinds, by a stand-in for a tagger."""
    found = summaries.top_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n", "kind", F.col("place").cast("long").alias("place"))


@query(f"with {_SENT}, {_ENTITIES}, {_KEYWORDS}, b as (select doc_id, word, sum(n)::bigint as n from (select doc_id, word, n from k union all select doc_id, text, 2 * n from entities where length(text) >= 2) group by 1, 2), r as (select *, row_number() over (partition by doc_id order by n desc, word) as place from b) select * from r where place <= 15")
def keywords_with_names(spark, sf_dir):
    """S117: the fifteen best keywords of each document, names counted twice."""
    return summaries.top_terms(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("place", F.col("place").cast("long"))


@query(f"with {_SCORES}, {_DENSE} select doc_id, i, {_settled('case when n = 1 then score else score + 0.15 * e end')} as score from scores join dense using (doc_id, i) join (select doc_id, count(*) as n from scores group by 1) using (doc_id)")
def extractive_scores_with_names(spark, sf_dir):
    """S113: composite scores of sentences with their density of names."""
    return summaries.extractive(_sentences(spark, sf_dir), entities=True).select("doc_id", F.col("i").cast("long").alias("i"), T.settled(F.col("score")).alias("score"))


@query(f"with {_SENT}, {_DENSE} select doc_id, i, floor(1000000 * (case when n = 1 then 1.0::double else 0.8::double * greatest(0, 1 - 0.15::double * i) + 0.1::double * {_LENGTH} + 0.1::double * e end) + 0.5001) / 1000000 as score from (select sent.*, e from sent join dense using (doc_id, i))")
def lead_scores_with_names(spark, sf_dir):
    """S115: lead scores of sentences with their density of names; as in SQL, texts without a doc_id have none."""
    return summaries.lead(_sentences(spark, sf_dir).where("doc_id is not null"), entities=True).select("doc_id", F.col("i").cast("long").alias("i"), T.settled(F.col("score")).alias("score"))


@query(
    f"with {_KEYWORDS}, top as (select doc_id, word from (select *, row_number() over (partition by doc_id order by n desc, word) as place from k) where place <= 20), "
    f"s as (select doc_id, unnest({_words('text')}) as word, generate_subscripts({_words('text')}, 1) as p from documents), q as (select doc_id, word, row_number() over (partition by doc_id order by p) as p from s join top using (doc_id, word)), "
    "l as (select doc_id, word, unnest(list_distinct(list(word) over (partition by doc_id order by p rows between 1 following and 49 following))) as other from q) "
    "select distinct doc_id, least(word, other) as a, greatest(word, other) as b from l where word <> other"
)
def keyword_pairs(spark, sf_dir):
    """S117: keywords that stand near each other."""
    return summaries.co_occurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def topic_clusters(spark, sf_dir):
    """S117: clusters of keywords (tested against a plain version)."""
    return summaries.topics(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("weight", F.round("weight", 6))
