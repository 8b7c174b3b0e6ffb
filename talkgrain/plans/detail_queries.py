"""Lookups, phrases and snippets, tags, speakers, identities and health of recordings."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from talkgrain.functions import vectors as V
from talkgrain.operators import clusters, filters, lifecycle, search
from talkgrain.operators.index import SearchIndex
from talkgrain.operators.ranks import running
from talkgrain.plans.register import registered
from talkgrain.plans.vector_queries import acoustic_profiles
from talkgrain.sources.scratch import scratch_root
from talkgrain.sources.tables import CHUNKS, SEGMENTS, SESSIONS, chunks, segments, sessions, table

QUERIES, ORACLE_SQL = {}, {}
query = registered(QUERIES, ORACLE_SQL)
IDS = [3, 5, 8, 13, 21, 34, 55, 89, 144, 100_000_000]


@query(f"with {SEGMENTS} select session_id, ordinal, role, text from segments where session_id = 7 and ordinal = 1")
def segment_lookup(spark, sf_dir):
    """One segment by its key."""
    return segments(spark, sf_dir).where("session_id = 7 and ordinal = 1").select("session_id", "ordinal", "role", "text")


@query(f"with {CHUNKS} select session_id, idx, duration, size_bytes from chunks where session_id = 7 and idx = 1")
def chunk_lookup(spark, sf_dir):
    """One chunk by its key."""
    return chunks(spark, sf_dir).where("session_id = 7 and idx = 1").select("session_id", "idx", "duration", "size_bytes")


@query(f"with {SESSIONS} select session_id, folder, size_bytes from sessions where session_id in ({', '.join(map(str, IDS))})")
def sessions_by_ids(spark, sf_dir):
    """Sessions of a list of ids; ids that there aren't are left out."""
    return sessions(spark, sf_dir).where(F.col("session_id").isin(IDS)).select("session_id", "folder", "size_bytes")


@query(
    "select doc_id as filter_id, case doc_id % 7 when 0 then true when 1 then false when 2 then true when 3 then false when 4 then coalesce(lang, '') = '' when 5 then true else doc_id % 2 = 0 end as is_empty, "
    "case doc_id % 7 when 0 then false when 1 then false when 2 then false when 3 then true when 4 then coalesce(lang, '') <> '' when 5 then false else doc_id % 2 = 1 end as is_active from documents"
)
def filter_states(spark, sf_dir):
    """Whether stored filters ask for nothing, and whether they have a facet; the sort order is none. A filter for each document."""
    kind, lang = F.col("doc_id") % 7, F.col("lang")
    body = lambda **c: F.to_json(F.struct(*[(F.lit(v) if not isinstance(v, Column) else v).alias(k) for k, v in c.items()]))
    json = (
        F.when(kind == 0, body(query="  ", sort="oldest")).when(kind == 1, body(query=F.concat(F.lit("w"), "doc_id"))).when(kind == 2, F.lit(None)).when(kind == 3, body(query="x", date_from="2024-01-01", audio_kept=False))
        .when(kind == 4, body(language=lang, sort="newest")).when(kind == 5, F.lit('{"tag": "x')).otherwise(body(highlights_only=F.col("doc_id") % 2 == 1))
    )
    empty, active = filters.stored_states(F.col("json"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filter_id"), json.alias("json")).select("filter_id", empty.alias("is_empty"), active.alias("is_active"))


_TOK = "list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_PHRASE = (
    f"tok as (select doc_id, source, {_TOK} as t from documents), stat as (select count(*) as n, avg(len(t)) as avgdl from tok), "
    "occ as (select doc_id, source, len(t) as dl, 0 as phrase, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' and t[i + 1] = 'the')) as tf from tok union all select doc_id, source, len(t), 1, len(list_filter(t, lambda w: w = 'and')) from tok), "
    "hit as (select * from occ where tf > 0), d as (select phrase, count(*) as df from hit group by 1), "
    "ranked as (select doc_id, source, -sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as rank from hit join d using (phrase) cross join stat group by 1, 2 having count(*) = 2)"
)


@query(f"with {_PHRASE} select doc_id, round(rank, 6) as rank from ranked")
def phrase_search(spark, sf_dir):
    """S104: documents with a phrase of two tokens next to each other and a further term, by BM25."""
    hits = search.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], ["of-the", "and"])
    return hits.select("doc_id", F.round("rank", 6).alias("rank"))


#: the documents after the changes that kept_index makes
_CHANGED = "changed as (select source, doc_id, case when doc_id % 7 = 0 then 'of the and news ' || text else text end as text from documents where doc_id % 11 <> 3 and coalesce(source, '') <> 'src1' union all select 'new', doc_id, 'and of the ' || lang from documents where doc_id % 13 = 0)"


def kept_index(spark, sf_dir) -> SearchIndex:
    """Documents as segments of their source: indexed, a seventh edited, an eleventh removed, a session removed, new ones added."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang")
    index = SearchIndex(spark, f"{scratch_root(spark)}/talkgrain/index-{uuid.uuid4().hex}", ("source", "doc_id"))
    index.rebuild(docs)
    index.upsert(docs.where("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("of the and news "), "text")), 1)
    index.remove(docs.where("doc_id % 11 = 3"), 2)
    index.remove_sessions(docs.where("source = 'src1'").select("source").distinct(), 3)
    index.upsert(docs.where("doc_id % 13 = 0").select(F.lit("new").alias("source"), "doc_id", F.concat(F.lit("and of the "), "lang").alias("text")), 4)
    return index


@query(f"with {_CHANGED}, {_PHRASE.replace('from documents', 'from changed')} select doc_id, source, round(rank, 6) as rank from ranked")
def kept_index_search(spark, sf_dir):
    """S104, S108: search in an index that was changed, by BM25: base and later generations, without what was removed."""
    return kept_index(spark, sf_dir).search(["of-the", "and"]).select("doc_id", "source", F.round("rank", 6).alias("rank"))


@query(f"with {_CHANGED}, tok as (select source, doc_id, {_TOK} as t from changed), p as (select source, doc_id, unnest(t) as term, unnest(range(len(t))) as i from tok) select source, doc_id, term, count(*) as tf, array_to_string(list(i order by i), ',') as places from p where term in ('the', 'news', 'and', 'of', 'der') group by 1, 2, 3")
def kept_index_postings(spark, sf_dir):
    """S05, S108: live postings of some terms after the changes, and their places."""
    found = kept_index(spark, sf_dir).postings(["the", "news", "and", "of", "der"])
    return found.select("source", "doc_id", "term", F.size("places").cast("long").alias("tf"), F.array_join(F.col("places").cast("array<string>"), ",").alias("places"))


@query(f"with tok as (select conv_id, turn, {_TOK} as t from conversations where conv_id = 7) select conv_id, turn from tok where list_contains(t, 'the') or list_contains(t, 'is')")
def session_matches(spark, sf_dir):
    """S104: segments of one session that hold either of two terms, each searched for in that session only."""
    own = segments(spark, sf_dir).where("session_id = 7").select("session_id", "ordinal", "text")
    hits = search.bm25(own, ["session_id", "ordinal"], ["the"]).union(search.bm25(own, ["session_id", "ordinal"], ["is"]))
    return hits.select(F.col("session_id").alias("conv_id"), F.col("ordinal").alias("turn")).distinct()


@query(
    "with t as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as w from documents), p as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from t), "
    "k0 as (select doc_id, i, unnest(c) as t, generate_subscripts(c, 1) as j from (select doc_id, i, list_filter(regexp_split_to_array(strip_accents(lower(word)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as c from p)), "
    "k as (select doc_id, i as a, t, lead(t) over o as t2, lead(i) over o as b2 from k0 window o as (partition by doc_id order by i, j)), "
    "h as (select doc_id, a, b2 as b, 0 as q from k where t = 'of' and t2 = 'the' union all select doc_id, a, a, 1 from k where t = 'and' union all select doc_id, a, a, 2 from k where t = 'in'), "
    "s as (select distinct doc_id, greatest(least(a, len(w) - 32), 0) as s from h join t using (doc_id)), c as (select s.doc_id, s, count(distinct q) as c from s join h on h.doc_id = s.doc_id and a >= s and b < s + 32 group by 1, 2), "
    "best as (select doc_id, min(s) as s from (select *, max(c) over (partition by doc_id) as m from c) where c = m group by 1), "
    "shown as (select doc_id, s, i, case when exists (select 1 from h where h.doc_id = p.doc_id and a = i and b < s + 32) then '<b>' else '' end || word || case when exists (select 1 from h where h.doc_id = p.doc_id and b = i and a >= s) then '</b>' else '' end as word from p join best using (doc_id) where i >= s and i < s + 32) "
    "select doc_id, case when any_value(s) > 0 then '...' else '' end || string_agg(word, ' ' order by i) || case when any_value(s) + 32 < any_value(len(w)) then '...' else '' end as snippet from shown join t using (doc_id) group by 1"
)
def snippets(spark, sf_dir):
    """S107: the 32 words with most terms of a query, one of them a phrase; its places are marked."""
    cut = table(spark, sf_dir, "documents").select("doc_id", search.snippet(F.col("text"), ["of-the", "and", "in"]).alias("snippet"))
    return cut.where("snippet is not null")


@query(
    f"with {SEGMENTS}, names as (select distinct session_id, 0 as speaker, 'Guest ' || session_id as name from segments where session_id % 2 = 0) "
    "select session_id, ordinal, start_ms, case when speaker < 0 then null else coalesce(name, 'Speaker ' || (speaker + 1)) end as speaker_name from segments left join names using (session_id, speaker) where contains(strip_accents(lower(text)), 'ation')"
)
def named_hits(spark, sf_dir):
    """S109: segments with a substring, with the names of their speakers."""
    seg = segments(spark, sf_dir)
    names = seg.where("session_id % 2 = 0").select("session_id", F.lit(0).alias("speaker"), F.concat(F.lit("Guest "), "session_id").alias("name")).distinct()
    hits = seg.where(filters.contains_folded(F.col("text"), "ation")).join(names, ["session_id", "speaker"], "left")
    name = F.when(F.col("speaker") >= 0, F.coalesce("name", F.concat(F.lit("Speaker "), F.col("speaker") + 1)))
    return hits.select("session_id", "ordinal", "start_ms", name.alias("speaker_name")).orderBy("start_ms", "session_id")


@query(f"with {SEGMENTS} select session_id, ordinal, case when ordinal % 3 = 2 then 5 else speaker end as speaker from segments")
def reassigned_speakers(spark, sf_dir):
    """S165: segments whose speaker was changed by hand."""
    seg = segments(spark, sf_dir)
    changes = seg.where("ordinal % 3 = 2").select("session_id", "ordinal", F.lit(5).alias("speaker"))
    return lifecycle.reassigned(seg, changes, ["session_id", "ordinal"]).select("session_id", "ordinal", "speaker")


@query(
    f"with {SEGMENTS}, al as (select distinct session_id, speaker, speaker + session_id % 4 as g from segments where speaker >= 0) select s.session_id, s.ordinal, coalesce(g, s.speaker) as speaker, "
    "case when ordinal % 7 = 3 then text || ' (edited)' else text end as text, case when ordinal % 7 = 3 then text end as original_text, ordinal % 7 = 3 as is_user_edited from segments s left join al on al.session_id = s.session_id and al.speaker = s.speaker"
)
def finalised_segments(spark, sf_dir):
    """S174: global speakers and live edits, as they are applied when a session ends."""
    seg = segments(spark, sf_dir).select("session_id", "ordinal", "speaker", "text")
    alignment = seg.where("speaker >= 0").select("session_id", "speaker", (F.col("speaker") + F.col("session_id") % 4).alias("global_speaker")).distinct()
    edits = seg.where("ordinal % 7 = 3").select("session_id", "ordinal", F.concat("text", F.lit(" (edited)")).alias("edited_text"))
    return lifecycle.finalised(seg, alignment, edits, ["session_id", "ordinal"]).select("session_id", "ordinal", "speaker", "text", "original_text", "is_user_edited")


@query("select doc_id as session_id, case when toxic = 1 then 'flagged' else 'fine' end as tag from labels where quality = 1 union select doc_id, 'labelled' from labels")
def linked_tags(spark, sf_dir):
    """S35, S177: links of sessions and tags after some were added and others taken away; a link is there once."""
    labels = table(spark, sf_dir, "labels")
    link = lambda df, tag: df.select(F.col("doc_id").alias("session_id"), tag.alias("tag"))
    links = link(labels, F.when(F.col("toxic") == 1, "flagged").otherwise("fine"))
    added = lifecycle.upsert(links, link(labels, F.lit("labelled")).distinct(), ["session_id", "tag"])
    gone = link(labels.where("quality = 0"), F.when(F.col("toxic") == 1, "flagged").otherwise("fine"))
    return added.join(gone, ["session_id", "tag"], "left_anti").distinct()


@query(f"with {SESSIONS} select session_id, case when session_id % 10 = 0 then 'archive' when session_id % 10 <> 5 then folder end as folder from sessions")
def moved_sessions(spark, sf_dir):
    """S177: sessions put in a folder, and taken out of theirs."""
    s = lifecycle.set_where(sessions(spark, sf_dir), "folder", F.lit("archive"), F.col("session_id") % 10 == 0)
    return lifecycle.set_where(s, "folder", F.lit(None).cast("string"), F.col("session_id") % 10 == 5).select("session_id", "folder")


@query(
    "with u as (select user_id, count(*) as n, count(*) filter (event_type = 'error') as failed, (count(*) % 20) / 10.0 as disk, datediff('second', min(ts), max(ts)) / 3600.0 as hours, (max(event_id) % 400) as stale from events group by 1), "
    "h as (select *, (n % 9) as ok, (n % 7) * 2 as bad from u) "
    "select user_id, array_to_string(list_filter([case when disk < 0.5 then 'Disk space critically low (' || printf('%.1f', disk::double) || ' GB)' when disk < 1 then 'Disk space low (' || printf('%.1f', disk::double) || ' GB)' end, "
    "case when ok + bad > 5 and ok / (ok + bad) < 0.5 then 'Transcription failure rate is high (' || cast(floor((1 - ok / (ok + bad)) * 100) as int) || '%)' end, case when hours > 24 then 'Recording session exceeds 24 hours' end, "
    "case when stale > 120 then 'Recording may have stalled (no file activity for ' || stale || 's)' end], lambda x: x is not null), '; ') as warnings from h"
)
def health_warnings(spark, sf_dir):
    """S158: what health checks have to say; counts of a user's events for disk space, chunks and seconds."""
    span = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), (span / 3600).alias("hours"), (F.max("event_id") % 400).alias("stale"))
    found = lifecycle.warnings((F.col("n") % 20) / 10.0, F.col("n") % 9, (F.col("n") % 7) * 2, F.col("hours"), F.col("stale"))
    return u.select("user_id", F.array_join(found, "; ").alias("warnings"))


@query("with e as (select user_id, event_id, epoch_us(ts) as t, min(epoch_us(ts)) over (partition by user_id) as t0 from events) select user_id, ((t - t0) // 55000000)::bigint as cycle, count(*) as n from e group by 1, 2")
def recogniser_cycles(spark, sf_dir):
    """S148: recogniser cycles of 55 seconds, numbered from a session's start."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", t.alias("t"))
    start = e.groupBy("user_id").agg(F.min("t").alias("t0"))
    return e.join(start, "user_id").groupBy("user_id", F.floor((F.col("t") - F.col("t0")) / 55_000_000).alias("cycle")).agg(F.count("*").alias("n"))


@query(
    "with p as (select user_id, avg(value) as a, coalesce(stddev_pop(value), 0) as s, min(value) as lo, max(value) as hi, avg(abs(value - 50)) / 1000 as j from events group by 1), "
    "x as (select user_id, sqrt(2 * pow((a - 50) / 150, 2) + 1 * pow((s - 25) / 50, 2) + 1.5 * pow((lo - 1) / 20, 2) + 1.5 * pow((10 * hi - 990) / 1500, 2) + 0.5 * pow((j - 0.025) / 0.05, 2) + 0.5 * pow((s / 1000 - 0.025) / 0.1, 2)) as d from p) "
    "select user_id, case when d <= 1.3 then 'accepted_within_threshold' when d <= 2.0 then 'uncertain_between_accept_and_review' else 'distance_too_far' end as reason, round(greatest(0, least(1, 1 - d / 2.0)), 5) as confidence, d <= 0.9 as adapts from x"
)
def acoustic_identity(spark, sf_dir):
    """S125: what the distance of six acoustic features from an enrolled identity means."""
    reason, sure = clusters.verdict(F.col("d"), *clusters.ACOUSTIC[:2])
    return acoustic_profiles(spark, sf_dir).select("user_id", reason.alias("reason"), F.round(sure, 5).alias("confidence"), (F.col("d") <= clusters.ACOUSTIC[2]).alias("adapts"))


_UNIT = "list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[])))"


@query(
    f"with e as (select vec_id, label, {_UNIT} as v from (select vec_id, label, embedding::double[] as embedding from embeddings)), k as (select label, min_by(v, vec_id) as c, min(vec_id) as first from e group by 1), "
    "p as (select e.label, e.vec_id, v, c, round(1 - list_inner_product(v, c), 9) as d from e join k using (label) where vec_id <> first), b as (select label, min_by(vec_id, {'d': d, 'i': vec_id}) as vec_id from p group by 1), "
    "m as (select label, vec_id, d, case when d <= 0.22 then list_transform(range(1, 65), lambda i: 0.8 * c[i] + 0.2 * v[i]) else c end as m from p join b using (label, vec_id)) "
    "select label, vec_id, d <= 0.22 as adapted, list_transform(m, lambda x: round(x / sqrt(list_inner_product(m, m)), 5)) as centroid from m"
)
def adapted_identities(spark, sf_dir):
    """S126: an enrolled vector (a label's first) moves towards the nearest other one, if that is near enough."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.normalised(F.col("embedding")).alias("v"))
    first = e.groupBy("label").agg(F.min("vec_id").alias("first"))
    known = e.join(first, "label").where("vec_id = first").select("label", "first", F.col("v").alias("c"))
    pairs = e.join(known, "label").where("vec_id <> first").withColumn("d", F.round(V.distance(F.col("v"), F.col("c")), 9))
    best = pairs.groupBy("label").agg(F.min_by(F.struct("vec_id", "d", "v", "c"), F.struct("d", "vec_id")).alias("b")).select("label", "b.*")
    near = F.col("d") <= clusters.ADAPT
    moved = F.when(near, clusters.adapted(F.col("c"), F.col("v"))).otherwise(F.col("c"))
    return best.select("label", "vec_id", near.alias("adapted"), F.transform(moved, lambda x: F.round(x, 5)).alias("centroid"))


@query("with t as (select case when toxic = 1 then 'flagged' when quality = 1 then 'good' when quality = 0 then 'low' end as tag, doc_id from labels) select tag, count(*) as sessions, row_number() over (order by tag) as place from t where tag is not null group by 1")
def tag_scan(spark, sf_dir):
    """Tags by name, with the number of their sessions."""
    tag = F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")
    found = table(spark, sf_dir, "labels").select(tag.alias("tag"), "doc_id").where("tag is not null").groupBy("tag").agg(F.count("*").alias("sessions"))
    return found.withColumn("place", F.row_number().over(Window.orderBy("tag")).cast("long"))  # a row a tag, of three


@query("with f as (select source as folder, (count(*) * 7 % 5)::bigint as sort_order, count(*) as sessions from documents where source is not null group by 1) select folder, sort_order, sessions from f order by sort_order, folder")
def folders_in_order(spark, sf_dir):
    """Folders by their own order, then by name."""
    f = sessions(spark, sf_dir).where("folder is not null").groupBy("folder").agg((F.count("*") * 7 % 5).alias("sort_order"), F.count("*").alias("sessions"))
    return f.select("folder", "sort_order", "sessions").orderBy("sort_order", "folder")


@query(
    f"with {SEGMENTS}, {CHUNKS}, kids as (select session_id, 'segment' as kind, start_ms as at_ms, ordinal as id, role as label from segments union all select session_id, 'highlight', start_ms, ordinal, case when ordinal > 0 then role end from segments where speaker < 0 "
    "union all select session_id, 'chunk', idx, size_bytes, status::varchar from chunks where session_id in (select conv_id from conversations) union all select doc_id, 'tag', 0, 0, case when toxic = 1 then 'flagged' else 'fine' end from labels where doc_id in (select conv_id from conversations)) "
    "select session_id, kind, row_number() over (partition by session_id, kind order by at_ms, label nulls first, id) as place, at_ms, id, label from kids"
)
def session_children(spark, sf_dir):
    """What belongs to a session, in its own order: segments and highlights by time, chunks by index, tags by name."""
    seg = segments(spark, sf_dir)
    own = seg.select("session_id").distinct()
    some = lambda df, kind, at, id_, label: df.select("session_id", F.lit(kind).alias("kind"), at.cast("long").alias("at_ms"), id_.cast("long").alias("id"), label.cast("string").alias("label"))
    tag = F.when(F.col("toxic") == 1, "flagged").otherwise("fine")
    kids = [
        some(seg, "segment", F.col("start_ms"), F.col("ordinal"), F.col("role")),
        some(seg.where("speaker < 0"), "highlight", F.col("start_ms"), F.col("ordinal"), F.when(F.col("ordinal") > 0, F.col("role"))),
        some(chunks(spark, sf_dir).join(own, "session_id", "left_semi"), "chunk", F.col("idx"), F.col("size_bytes"), F.col("status")),
        some(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "session_id").join(own, "session_id", "left_semi"), "tag", F.lit(0), F.lit(0), tag),
    ]
    every = reduce(lambda a, b: a.unionByName(b), kids)
    return running(every, ["session_id", "kind"], [F.col("at_ms"), F.col("label").asc_nulls_first(), F.col("id")]).select("session_id", "kind", "place", "at_ms", "id", "label")


@query(
    f"with {SEGMENTS}, {SESSIONS}, p as (select session_id, text, row_number() over (partition by session_id order by start_ms, ordinal) as r from segments where length(text) > 0), v as (select session_id, nullif(substr(string_agg(text, ' ' order by r), 1, 200), '') as preview from p where r <= 3 group by 1), "
    "c as (select l_orderkey as session_id, count(*) as n from lineitem group by 1), t as (select doc_id, case when toxic = 1 and quality = 1 then 'flagged,good' when toxic = 1 then 'flagged' when quality = 1 then 'good' else '' end as tags from labels) "
    "select session_id, folder, started_at, audio_kept, preview, coalesce(n, 0) as chunk_count, coalesce(tags, '') as tags from sessions left join v using (session_id) left join c using (session_id) left join t on doc_id = session_id"
)
def session_summaries(spark, sf_dir):
    """What a list shows of each session: a preview of its first three segments, the number of chunks, tags."""
    seg = segments(spark, sf_dir).where("length(text) > 0")
    first = F.slice(F.array_sort(F.collect_list(F.struct("start_ms", "ordinal", F.left("text", F.lit(200)).alias("text")))), 1, 3)  # what is beyond 200 characters is not shown
    shown = seg.groupBy("session_id").agg(F.nullif(F.left(F.array_join(first["text"], " "), F.lit(200)), F.lit("")).alias("preview"))
    counts = chunks(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("chunk_count"))
    tags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session_id"), F.array_join(F.array_compact(F.array(F.when(F.col("toxic") == 1, "flagged"), F.when(F.col("quality") == 1, "good"))), ",").alias("tags"))
    s = sessions(spark, sf_dir).select("session_id", "folder", "started_at", "audio_kept")
    whole = s.join(shown, "session_id", "left").join(counts, "session_id", "left").join(tags, "session_id", "left")
    return whole.withColumns({"chunk_count": F.coalesce("chunk_count", F.lit(0).cast("long")), "tags": F.coalesce("tags", F.lit(""))})


@query("with p as (select user_id, avg(value) as a, coalesce(stddev_pop(value), 0) as s, min(value) as lo, max(value) as hi, avg(abs(value - 50)) / 1000 as j from events group by 1), f as (select user_id % 10 as speaker, [a, s, lo, 10 * hi, j, s / 1000] as f from p), l as (select speaker, unnest(f) as x, generate_subscripts(f, 1) as i from f) select speaker, i, round(avg(x), 6) as x from l group by 1, 2")
def acoustic_centroids(spark, sf_dir):
    """S122: the mean of six acoustic features of each speaker; ten speakers of users' profiles."""
    v = F.col("value")
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(v).alias("a"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"), (F.avg(F.abs(v - 50)) / 1000).alias("j"))
    each = p.select((F.col("user_id") % 10).alias("speaker"), F.posexplode(F.array("a", "s", "lo", 10 * F.col("hi"), "j", F.col("s") / 1000)).alias("i", "x"))
    return each.groupBy("speaker", (F.col("i") + 1).cast("long").alias("i")).agg(F.round(F.avg("x"), 6).alias("x"))
