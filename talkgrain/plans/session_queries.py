"""Scans, filters, joins and roll-ups over sessions, segments and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrain.functions import text as T
from talkgrain.operators import filters, lifecycle, search
from talkgrain.plans.register import registered
from talkgrain.sources.tables import CHUNKS, SEGMENTS, SESSIONS, chunks, segments, sessions, table

QUERIES, ORACLE_SQL = {}, {}
query = registered(QUERIES, ORACLE_SQL)
NOW = "2024-03-01 00:00:00"


WANTED = filters.SearchFilter(query="ation", date_from="2024-01-02 00:00:00", date_to="2030-01-01 00:00:00", language="fr")


@query(f"with {SESSIONS} select session_id, folder, size_bytes from sessions where started_at between timestamp '2024-01-02' and timestamp '2030-01-01' and language = 'fr' and contains(strip_accents(lower(text)), 'ation') order by started_at desc, session_id limit 20")
def search_page(spark, sf_dir):
    """A page of sessions that pass facets and hold a phrase."""
    found = filters.faceted(sessions(spark, sf_dir), WANTED).where(filters.contains_folded(F.col("text"), WANTED.query))
    return filters.page(filters.in_order(found.select("session_id", "folder", "size_bytes", "started_at")), 0).select("session_id", "folder", "size_bytes")


@query(f"with {SESSIONS} select session_id, language, folder, size_bytes, started_at from sessions")
def session_scan(spark, sf_dir):
    """All sessions, newest first."""
    return filters.in_order(sessions(spark, sf_dir).select("session_id", "language", "folder", "size_bytes", "started_at"))


@query(f"with {SESSIONS} select session_id, folder, size_bytes from sessions where session_id = 42")
def session_lookup(spark, sf_dir):
    """One session by id."""
    return sessions(spark, sf_dir).where("session_id = 42").select("session_id", "folder", "size_bytes").limit(1)


@query("select folder, row_number() over (order by folder) as place from (select distinct source as folder from documents)")
def folder_scan(spark, sf_dir):
    """Folders by name."""
    found = sessions(spark, sf_dir).select("folder").distinct()
    return found.withColumn("place", F.row_number().over(Window.orderBy("folder")).cast("long"))


@query(f"with {SESSIONS} select session_id, started_at from sessions order by started_at desc, session_id limit 20 offset 40")
def session_third_page(spark, sf_dir):
    """The third page."""
    return filters.page(filters.in_order(sessions(spark, sf_dir).select("session_id", "started_at")), 2)


@query(f"with {SESSIONS} select count(*) as total, 60 < count(*) as has_more from sessions where audio_kept")
def session_count(spark, sf_dir):
    """How many sessions pass, and whether there is more than three pages."""
    total = sessions(spark, sf_dir).where("audio_kept").agg(F.count("*").alias("total"))
    return total.withColumn("has_more", filters.has_more(F.col("total"), 2))


@query(f"with {SESSIONS} select session_id from sessions s where exists (select 1 from labels l where l.doc_id = s.session_id and l.toxic = 1)")
def with_highlights(spark, sf_dir):
    """Ids of sessions with a highlight."""
    marks = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("session_id"))
    return filters.faceted(sessions(spark, sf_dir), filters.SearchFilter(highlights_only=True), highlights=marks).select("session_id")


@query(f"with {SESSIONS} select session_id, folder from sessions s where language = 'en' and exists (select 1 from labels l where l.doc_id = s.session_id and l.quality = 0)")
def with_tag(spark, sf_dir):
    """Sessions that carry a tag."""
    tags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session_id"), F.when(F.col("quality") == 0, "low").otherwise("good").alias("tag"))
    return filters.faceted(sessions(spark, sf_dir), filters.SearchFilter(tag="low", language="en"), tags=tags).select("session_id", "folder")


@query(f"with {SESSIONS} select session_id from sessions where contains(strip_accents(lower(text)), 'lettre') or contains(lower(folder), 'rc1') and language = 'de'")
def any_source_matches(spark, sf_dir):
    """A phrase in the text, or in the folder's name with a language."""
    s = sessions(spark, sf_dir)
    return s.where(filters.contains_folded(F.col("text"), "lettre") | (F.contains(F.lower("folder"), F.lit("rc1")) & (F.col("language") == "de"))).select("session_id")


@query(f"with {SESSIONS} select session_id, size_bytes from sessions where audio_kept and started_at < timestamp '{NOW}' - interval 30 day")
def old_audio(spark, sf_dir):
    """Sessions whose audio is over 30 days old."""
    return filters.older_than(sessions(spark, sf_dir), NOW, 30).select("session_id", "size_bytes")


@query(f"with {CHUNKS} select session_id, idx, status from chunks where status in (1, 3)")
def chunks_to_retry(spark, sf_dir):
    """Failed or pending chunks."""
    return chunks(spark, sf_dir).where(F.col("status").isin(1, 3)).select("session_id", "idx", "status")


@query(f"with {SEGMENTS}, p as (select session_id, ordinal, text, row_number() over (partition by session_id order by start_ms, ordinal) r from segments where length(text) > 0) select session_id, nullif(substr(string_agg(text, ' ' order by r) filter (where r <= 3), 1, 200), '') as preview, count(*) as segments from p group by session_id")
def session_previews(spark, sf_dir):
    """The first three segments of each session, 200 characters at most."""
    w = Window.partitionBy("session_id").orderBy("start_ms", "ordinal")
    ranked = segments(spark, sf_dir).where("length(text) > 0").withColumn("r", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "text"))))
    text = F.substring(F.array_join(F.transform(first, lambda x: x["text"]), " "), 1, 200)
    return ranked.groupBy("session_id").agg(F.nullif(text, F.lit("")).alias("preview"), F.count("*").alias("segments"))


@query(f"with {SEGMENTS} select session_id, ordinal, case when speaker = 0 then 'Asker' when speaker >= 0 then 'Speaker ' || (speaker + 1) end as name from segments")
def speaker_names(spark, sf_dir):
    """Display names from a map, with a default by number."""
    names = F.create_map(F.lit(0), F.lit("Asker"))
    speaker = F.col("speaker")
    name = F.when(speaker >= 0, F.coalesce(F.try_element_at(names, speaker), F.concat(F.lit("Speaker "), speaker + 1)))
    return segments(spark, sf_dir).select("session_id", "ordinal", name.alias("name"))


@query(f"with {CHUNKS} select o_orderkey as session_id, coalesce(sum(size_bytes), 0)::bigint as bytes, count(idx) as n from orders left join chunks on session_id = o_orderkey group by 1")
def session_storage(spark, sf_dir):
    """Bytes and chunks of every session, the largest first; sessions without chunks stay."""
    own = chunks(spark, sf_dir).groupBy("session_id").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("n"))
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id")).join(own, "session_id", "left")
    return every.fillna(0, ["bytes", "n"]).orderBy(F.desc("bytes"), "session_id")


@query(f"with {CHUNKS}, b as (select status, sum(size_bytes) s from chunks group by status) select status, round(s / 1048576.0, 6) as mb, round(case when sum(s) over () > 0 then s / sum(s) over () else 0 end, 6) as share from b")
def storage_breakdown(spark, sf_dir):
    """Megabytes and share by kind."""
    b = chunks(spark, sf_dir).groupBy("status").agg(F.sum("size_bytes").alias("s"))
    total = F.sum("s").over(Window.partitionBy())
    return b.select("status", F.round(F.col("s") / 1048576.0, 6).alias("mb"), F.round(F.when(total > 0, F.col("s") / total).otherwise(0.0), 6).alias("share"))


@query(f"with {SEGMENTS}, c as (select session_id, speaker, sum(len(list_filter(string_split(text, ' '), lambda x: x <> '')))::bigint as words from segments where speaker >= 0 group by 1, 2) select session_id, speaker, words, round(words * 100.0 / sum(words) over (partition by session_id))::bigint as pct from c qualify sum(words) over (partition by session_id) > 0")
def participation(spark, sf_dir):
    """Words by speaker and their share in percent, halves away from zero."""
    n = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    c = segments(spark, sf_dir).where("speaker >= 0").groupBy("session_id", "speaker").agg(F.sum(n).alias("words"))
    total = F.sum("words").over(Window.partitionBy("session_id"))
    return c.withColumn("t", total).where("t > 0").select("session_id", "speaker", "words", F.round(F.col("words") * 100.0 / F.col("t")).cast("long").alias("pct"))


@query(f"with {SEGMENTS} select session_id, count(distinct speaker) filter (where speaker >= 0) as speakers, greatest(0, max(end_ms) - min(start_ms)) as span_ms from segments group by 1")
def speakers_and_span(spark, sf_dir):
    """Speakers and time span of each session."""
    s = segments(spark, sf_dir).groupBy("session_id")
    return s.agg(F.count_distinct(F.when(F.col("speaker") >= 0, F.col("speaker"))).alias("speakers"), F.greatest(F.lit(0), F.max("end_ms") - F.min("start_ms")).alias("span_ms"))


@query(f"with {SEGMENTS} select session_id, string_agg(text, chr(10) order by start_ms, ordinal) as transcript, string_agg(case when speaker >= 0 then '[Speaker ' || (speaker + 1) || '] ' || text else text end, chr(10) order by start_ms, ordinal) as attributed from segments group by 1")
def transcripts(spark, sf_dir):
    """Plain and attributed transcript in time order."""
    named = F.when(F.col("speaker") >= 0, F.concat(F.lit("[Speaker "), F.col("speaker") + 1, F.lit("] "), "text")).otherwise(F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("start_ms", "ordinal", "text", named.alias("named"))))
    joined = lambda f: F.array_join(F.transform("x", lambda s: s[f]), "\n")
    return segments(spark, sf_dir).groupBy("session_id").agg(listed.alias("x")).select("session_id", joined("text").alias("transcript"), joined("named").alias("attributed"))


@query(f"with {CHUNKS} select session_id, case when bool_and(status in (2, 3)) and bool_or(status = 3) then 'error' when bool_and(status in (2, 3)) then 'ready' else 'processing' end as state from chunks group by 1")
def session_state(spark, sf_dir):
    """State of a session from its chunks."""
    return lifecycle.final_status(chunks(spark, sf_dir), "session_id")


@query("select event_type, count(*) as n, round(case when count(value) > 0 then count(*) filter (where value > 50) / count(value)::double else 1 end, 6) as rate from events group by 1")
def success_rate(spark, sf_dir):
    """Share of successes, 1 without observations."""
    good, seen = F.count(F.when(F.col("value") > 50, 1)), F.count("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.when(seen > 0, good / seen).otherwise(1.0), 6).alias("rate"))


@query("with b as (select user_id, epoch_us(ts) // 3600000000 as bucket, count(distinct event_type) as kinds from events group by 1, 2) select user_id, round(avg(case when kinds > 1 then 1.0 else 0.0 end), 6) as conflict_rate from b group by 1")
def conflict_rate(spark, sf_dir):
    """Share of time buckets that hold more than one distinct value."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    b = table(spark, sf_dir, "events").groupBy("user_id", hour.alias("bucket")).agg(F.count_distinct("event_type").alias("kinds"))
    return b.groupBy("user_id").agg(F.round(F.avg((F.col("kinds") > 1).cast("int")), 6).alias("conflict_rate"))


@query("select user_id, epoch_us(ts) // 3600000000 as bucket, max_by(event_type, {'v': value, 'id': event_id}) as event_type, count(*) as n from events group by 1, 2")
def best_per_bucket(spark, sf_dir):
    """The most confident entry of each bucket, the later of equals."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return table(spark, sf_dir, "events").groupBy("user_id", hour.alias("bucket")).agg(F.max_by("event_type", F.struct("value", "event_id")).alias("event_type"), F.count("*").alias("n"))


@query("select event_type, round(avg(value) filter (where value >= 20), 6) as speech, round(avg(value) filter (where value < 20), 6) as noise, round(avg(case when value >= 98 then 1.0 else 0.0 end), 6) as clipped, round(20 * log10(greatest(avg(value) filter (where value >= 20), 1e-6) / greatest(avg(value) filter (where value < 20), 1e-6)), 6) as snr_db from events group by 1")
def take_quality(spark, sf_dir):
    """Masked means, clipping and signal-to-noise ratio."""
    v = F.col("value")
    speech, noise = F.avg(F.when(v >= 20, v)), F.avg(F.when(v < 20, v))
    snr = 20 * F.log10(F.greatest(speech, F.lit(1e-6)) / F.greatest(noise, F.lit(1e-6)))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(speech, 6).alias("speech"), F.round(noise, 6).alias("noise"), F.round(F.avg((v >= 98).cast("int")), 6).alias("clipped"), F.round(snr, 6).alias("snr_db"))


@query(f"with {CHUNKS} select session_id, idx, size_bytes, coalesce(sum(duration) over (partition by session_id order by idx, size_bytes, duration rows between unbounded preceding and 1 preceding), 0)::bigint as start_ms from chunks")
def chunk_time_line(spark, sf_dir):
    """S69, S96, S179: where each chunk starts on its session's time line."""
    from talkgrain.operators.turns import offsets

    start = offsets(["session_id"], "duration", ["idx", "size_bytes", "duration"])
    return chunks(spark, sf_dir).select("session_id", "idx", "size_bytes", start.cast("long").alias("start_ms"))


@query(f"with {SESSIONS} select session_id, strftime(started_at, '%Y%m%d_%H%M') || '_' || substr(regexp_replace(folder || ' é #' || session_id, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 50) as file_name, strftime(started_at, '%Y-%m-%d %H:%M') as shown, lpad((size_bytes // 60000)::varchar, 2, '0') || ':' || lpad((size_bytes // 1000 % 60)::varchar, 2, '0') as clock from sessions")
def export_names(spark, sf_dir):
    """File names, dates and mm:ss."""
    title = F.concat("folder", F.lit(" é #"), "session_id")
    return sessions(spark, sf_dir).select("session_id", T.file_name(title, F.col("started_at")).alias("file_name"), F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("shown"), T.clock(F.col("size_bytes")).alias("clock"))


@query(f"with {SESSIONS} select folder, sum(size_bytes)::bigint as bytes, count(*) as files, max(size_bytes) as largest from sessions group by 1")
def folder_sizes(spark, sf_dir):
    """Bytes and files below each folder."""
    return sessions(spark, sf_dir).groupBy("folder").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("files"), F.max("size_bytes").alias("largest"))


@query("select event_id, ts, event_type from events where ts >= (select max(ts) from events) - interval 24 hour and event_type = 'click'")
def recent_log(spark, sf_dir):
    """The last 24 hours of one kind of log entry, up to the latest entry."""
    e = table(spark, sf_dir, "events")
    end = e.agg(F.max("ts").alias("end"))
    return e.where("event_type = 'click'").join(F.broadcast(end), F.expr("ts >= end - interval 24 hours")).select("event_id", "ts", "event_type")


@query(f"with {SESSIONS} select session_id, folder from sessions where session_id not in (select doc_id from labels)")
def not_yet_restored(spark, sf_dir):
    """Sessions that are not there yet."""
    have = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session_id"))
    return lifecycle.missing(have, sessions(spark, sf_dir), ["session_id"]).select("session_id", "folder")


@query(f"with {CHUNKS} select session_id, idx, size_bytes from chunks where session_id in (select o_orderkey from orders where o_orderstatus = 'F')")
def referenced_audio(spark, sf_dir):
    """Chunks of the sessions that are wanted."""
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("session_id"))
    return chunks(spark, sf_dir).join(wanted, "session_id", "left_semi").select("session_id", "idx", "size_bytes")


@query("with h as (select doc_id, 0 as source, doc_id as place from documents where contains(strip_accents(lower(text)), 'ntion') union all select doc_id, 1, doc_id from labels where quality = 0), r as (select doc_id, source, place, row_number() over (partition by doc_id order by source, place) k from h) select doc_id, source::bigint as source, place from r where k = 1")
def ordered_union(spark, sf_dir):
    """Hits of two sources, each session at its first place."""
    a = table(spark, sf_dir, "documents").where(filters.contains_folded(F.col("text"), "ntion")).select("doc_id", F.col("doc_id").alias("place"))
    b = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.col("doc_id").alias("place"))
    return search.union_in_order(a, b, "doc_id")


@query(f"with {SEGMENTS}, k(ord, keyword) as (values (0, 'ation'), (1, 'onen'), (2, 'heit')), h as (select session_id, ordinal, min(ord)::bigint as ord from segments, k where contains(strip_accents(lower(text)), keyword) group by 1, 2) select * from h order by ord, session_id, ordinal limit 10")
def question_answers(spark, sf_dir):
    """S77, S80, S109, S110: ten segments that hold any keyword of a question."""
    return search.answers(segments(spark, sf_dir), ["ation", "onen", "heit"])


@query(f"with {SEGMENTS} select session_id, ordinal, speaker from segments where contains(strip_accents(lower(text)), 'tion')")
def segment_substring(spark, sf_dir):
    """S21, S109: segments that hold a phrase, in time order."""
    return search.substring_hits(segments(spark, sf_dir), "tion").select("session_id", "ordinal", "speaker").orderBy("session_id", "ordinal")


TOK = "list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_POSTINGS = f"tok as (select doc_id, {TOK.format('text')} as t from documents), stat as (select count(*) as n, avg(len(t)) as avgdl from tok), post as (select doc_id, len(t) as dl, unnest(t) as term from tok), tf as (select doc_id, dl, term, count(*) as tf from post group by all)"
_RANK = f"{_POSTINGS}, hit as (select * from tf where term in ('the', 'with')), d as (select term, count(*) as df from hit group by 1), ranked as (select doc_id, -sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as rank, count(*) as c from hit join d using (term) cross join stat group by 1 having count(*) = 2)"


@query(f"with {_POSTINGS} select doc_id, term, tf, dl::bigint as dl from tf")
def index_postings(spark, sf_dir):
    """S05, S105, S108: the posting table of the documents."""
    return search.postings(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@query(f"with {_RANK} select doc_id, round(rank, 6) as rank from ranked")
def ranked_search(spark, sf_dir):
    """S72, S104, S106: documents that hold all terms, by BM25."""
    hits = search.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], ["the", "with"])
    return hits.select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"with {_RANK}, top as (select doc_id, round(rank, 9) as rank from ranked order by 2, 1 limit 200) select top.doc_id, round(rank, 6) as rank, source from top join documents using (doc_id) where source = 'src0'")
def capped_then_filtered(spark, sf_dir):
    """The 200 best hits first, then the facet, then the session's columns."""
    docs = table(spark, sf_dir, "documents")
    hits = search.bm25(docs.select("doc_id", "text"), ["doc_id"], ["the", "with"]).withColumn("rank", F.round("rank", 9))
    return search.capped(hits, ["doc_id"]).join(docs.where("source = 'src0'").select("doc_id", "source"), "doc_id").select("doc_id", F.round("rank", 6).alias("rank"), "source")
