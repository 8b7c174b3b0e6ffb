"""Edits, deletions, budgets, exports and backups."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrain.functions import text as T
from talkgrain.operators import lifecycle
from talkgrain.plans.register import registered
from talkgrain.sources import exports
from talkgrain.sources.scratch import scratch_root
from talkgrain.sources.tables import SEGMENTS, SESSIONS, chunks, segments, sessions, table

QUERIES, ORACLE_SQL = {}, {}
query = registered(QUERIES, ORACLE_SQL)

#: events as edits of a user's text
_HISTORY = "h as (select user_id as segment_id, row_number() over (partition by user_id order by ts, event_id) as edit_index, event_type || '-' || event_id as new_text from events)"


def _history(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "segment_id").withColumn("o", F.struct("ts", "event_id"))
    return lifecycle.numbered(e, "segment_id", "o").select("segment_id", "edit_index", F.concat_ws("-", "event_type", "event_id").alias("new_text"))


def _segments(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("segment_id"), F.col("c_name").alias("text"))


@query(f"with {_HISTORY}, l as (select segment_id, max_by(new_text, edit_index) as t, count(*) as edits from h group by 1) select c_custkey as segment_id, coalesce(t, c_name) as text, case when t is not null then c_name end as original_text, t is not null as is_user_edited, coalesce(edits, 0) as edits from customer left join l on segment_id = c_custkey")
def edited_segments(spark, sf_dir):
    """S154, S166, S181: segments with their last edit and the number of edits."""
    return lifecycle.current_text(_segments(spark, sf_dir), _history(spark, sf_dir), "segment_id")


@query(f"with {_HISTORY}, l as (select segment_id, max_by(new_text, edit_index) as t from h where edit_index < 3 group by 1) select c_custkey as segment_id, coalesce(t, c_name) as text from customer left join l on segment_id = c_custkey")
def reverted_segments(spark, sf_dir):
    """S168: segments as they were before their third edit."""
    return lifecycle.current_text(_segments(spark, sf_dir), lifecycle.reverted(_history(spark, sf_dir), "segment_id", 3), "segment_id").select("segment_id", "text")


@query(f"with {_HISTORY} select segment_id, edit_index, new_text from h where segment_id not in (select c_custkey from customer where c_custkey % 2 = 0)")
def kept_history(spark, sf_dir):
    """S167, S169: history in order, without that of the segments that went back to their original."""
    gone = _segments(spark, sf_dir).where("segment_id % 2 = 0").select("segment_id")
    return lifecycle.cascade(_history(spark, sf_dir), gone, "segment_id").orderBy("segment_id", "edit_index")


@query("select l_orderkey as session_id, count(*) as left_chunks from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O') group by 1")
def after_cascade(spark, sf_dir):
    """S170: chunks that are left after sessions were deleted."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("session_id"))
    return lifecycle.cascade(chunks(spark, sf_dir), gone, "session_id").groupBy("session_id").agg(F.count("*").alias("left_chunks"))


@query(f"with {SESSIONS} select session_id, audio_kept and folder <> 'src0' as audio_kept, case when folder = 'src0' then null else folder end as path, folder = 'src0' and audio_kept as deleted from sessions")
def audio_deleted(spark, sf_dir):
    """S171, S176: audio goes, the transcript stays."""
    s = sessions(spark, sf_dir).select("session_id", "folder", "audio_kept", F.col("folder").alias("path"))
    here = F.col("folder") == "src0"
    s = s.withColumn("deleted", here & F.col("audio_kept"))
    s = lifecycle.set_where(s, "path", F.lit(None), here)
    return lifecycle.set_where(s, "audio_kept", F.lit(False), here).select("session_id", "audio_kept", "path", "deleted")


_BUDGET = f"{SESSIONS}, r as (select session_id, folder, size_bytes, sum(size_bytes) over (partition by folder) as t, coalesce(sum(size_bytes) over (partition by folder order by started_at, session_id rows between unbounded preceding and 1 preceding), 0) as b from sessions)"


@query(f"with {_BUDGET} select session_id, folder, size_bytes from r where t > 20000 and t - b > 0.85 * 20000")
def cleaned_up(spark, sf_dir):
    """S172: the oldest sessions of each folder, down to 85 % of its budget."""
    s = sessions(spark, sf_dir).select("session_id", "folder", "size_bytes", "started_at")
    return lifecycle.to_clean_up(s, ["folder"], "size_bytes", [F.col("started_at"), F.col("session_id")], F.lit(20000)).select("session_id", "folder", "size_bytes")


@query("select source as folder, sum(n_chars)::bigint as used, case when sum(n_chars) * 100.0 / 50000 >= 100 then 'exceeded' when sum(n_chars) * 100.0 / 50000 >= 90 then 'warning' else 'ok' end as state from documents group by 1")
def budget_states(spark, sf_dir):
    """S172: state of each folder's budget."""
    used = sessions(spark, sf_dir).groupBy("folder").agg(F.sum("size_bytes").alias("used"))
    return used.withColumn("state", lifecycle.storage(F.col("used"), F.lit(50000)))


@query("select o_orderkey as session_id, case when o_orderstatus in ('O', 'F') then 'processing' else o_orderstatus end as state from orders where o_orderkey in (select l_orderkey from lineitem)")
def reset_for_retry(spark, sf_dir):
    """S173: sessions with chunks are processed anew."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("state"))
    o = o.join(chunks(spark, sf_dir).select("session_id").distinct(), "session_id", "left_semi")
    return lifecycle.set_where(o, "state", F.lit("processing"), F.col("state").isin("O", "F"))


@query(
    "with r as (select l_orderkey as session_id, l_linenumber as idx, max(case when l_returnflag = 'R' then 1 else 0 end) as again from lineitem group by 1, 2), c as (select session_id, idx, again from r join orders on o_orderkey = session_id), "
    "s as (select session_id, bool_or(again = 1) as reset, any_value(o_orderstatus) as state from c join orders on o_orderkey = session_id group by 1) "
    "select session_id, case when reset and state in ('O', 'F') then 'processing' else state end as state, (select count(*) from c where c.session_id = s.session_id and again = 1) as pending_chunks, (select count(*) from c where c.session_id = s.session_id and again = 0) as segments_left from s"
)
def retried_chunks(spark, sf_dir):
    """S173: chunks are transcribed anew: their segments go, they are pending, their sessions are processed. A segment a chunk."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("idx")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("again"))
    states = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("state"))
    own = lines.join(states.select("session_id"), "session_id", "left_semi").select("session_id", "idx", "again", F.lit("done").alias("status"))
    state, chunk, seg = lifecycle.retry(states, own.drop("again"), own.select("session_id", "idx"), own.where("again = 1").select("session_id", "idx"), F.col("state").isin("O", "F"))
    counts = chunk.groupBy("session_id").agg(F.count_if(F.col("status") == "pending").alias("pending_chunks"))
    left = seg.groupBy("session_id").agg(F.count("*").alias("segments_left"))
    return state.join(counts, "session_id").join(left, "session_id", "left").withColumn("segments_left", F.coalesce("segments_left", F.lit(0).cast("long")))


@query(
    "select o_orderkey as session_id, l_linenumber as idx, greatest(0, epoch_ms(l_shipdate) - epoch_ms(o_orderdate))::bigint as start_offset_ms, (l_quantity * 1000)::bigint as duration_ms from lineitem join orders on o_orderkey = l_orderkey "
    "where o_orderstatus <> 'P' and l_returnflag <> 'A' and l_quantity * 1000 > 5000"
)
def playable_chunks(spark, sf_dir):
    """S96, S179: chunks that can be played, with their offsets from the session's start, never below 0; short ones stand for those without length."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("began"), (F.col("o_orderstatus") != "P").alias("audio_kept"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("idx"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("at"), ((F.col("l_quantity") * 1000).cast("long") - 5000).alias("spare"), (F.col("l_returnflag") == "A").alias("deleted"))
    play = lifecycle.playable(c.join(o, "session_id"), F.col("audio_kept"), F.col("deleted"), F.col("spare"))
    return play.select("session_id", "idx", F.greatest(F.lit(0).cast("long"), F.col("at") - F.col("began")).alias("start_offset_ms"), (F.col("spare") + 5000).alias("duration_ms"))


@query(
    f"with {SESSIONS} select session_id, case when session_id % 4 = 1 then 'error' else 'ready' end as state, case when session_id % 4 = 2 then 'Title ' || session_id end as title, case when session_id % 3 = 0 then 48.85 end as latitude, case when session_id % 3 = 0 then 'Paris' end as place, "
    "case when session_id % 4 = 1 then started_at + interval 1 hour end as ended_at, (select count(*) from events where user_id = session_id and event_type = 'click') as highlights from sessions"
)
def session_setters(spark, sf_dir):
    """S176, S177: single fields set: state, title, location, end; highlights added, one for each click."""
    s = sessions(spark, sf_dir).select("session_id", "started_at", F.lit("ready").alias("state"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("timestamp").alias("ended_at"))
    i = F.col("session_id")
    for column, value, test in (
        ("state", F.lit("error"), i % 4 == 1), ("title", F.concat_ws(" ", F.lit("Title"), "session_id"), i % 4 == 2), ("latitude", F.lit(48.85), i % 3 == 0), ("place", F.lit("Paris"), i % 3 == 0),
        ("ended_at", F.col("started_at") + F.expr("interval 1 hour"), i % 4 == 1),
    ):
        s = lifecycle.set_where(s, column, value, test)
    marks = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("highlight_id"))
    none = marks.limit(0)
    counts = lifecycle.upsert(none, marks, ["session_id", "highlight_id"]).groupBy("session_id").agg(F.count("*").alias("highlights"))
    return s.join(counts, "session_id", "left").withColumn("highlights", F.coalesce("highlights", F.lit(0).cast("long"))).drop("started_at")


@query("select doc_id, quality, toxic from labels where doc_id % 5 <> 0 union all select doc_id, 9, 9 from documents where doc_id % 5 = 0")
def upserted_rows(spark, sf_dir):
    """S108, S162: rows replaced by key, new ones added."""
    changes = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return lifecycle.upsert(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), changes, ["doc_id"])


def _names(spark, sf_dir):
    """Name maps as they may be stored: whole, with a key twice, with keys that are no numbers, broken, null."""
    c = F.col("c_custkey") % 5
    q = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    json = F.when(c == 0, q('{"0":"', name, '","1":"', segment, '"}')).when(c == 1, q('{"0":"first","0":"', name, '"}')).when(c == 2, q('{"a":"x","2":"', name, '","1.5":"y"}')).when(c == 3, q('{"0":"', name))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), name.alias("name"), json.alias("json"))


@query(
    "select c_custkey as session_id, case c_custkey % 5 when 0 then case c_custkey % 3 when 0 then '{\"0\":\"' || c_name || '\"}' when 1 then '{\"0\":\"' || c_name || '\",\"1\":\"Guest ' || c_custkey || '\"}' else '{\"0\":\"' || c_name || '\",\"1\":\"' || c_mktsegment || '\"}' end "
    "when 1 then case c_custkey % 3 when 1 then '{\"0\":\"' || c_name || '\",\"1\":\"Guest ' || c_custkey || '\"}' else '{\"0\":\"' || c_name || '\"}' end "
    "when 2 then case c_custkey % 3 when 1 then '{\"1\":\"Guest ' || c_custkey || '\",\"2\":\"' || c_name || '\"}' else '{\"2\":\"' || c_name || '\"}' end else case c_custkey % 3 when 1 then '{\"1\":\"Guest ' || c_custkey || '\"}' else '{}' end end as names from customer"
)
def renamed_speakers(spark, sf_dir):
    """S101, S164: stored name maps, broken ones among them, after speaker 1 was renamed, or its name taken away."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")  # stored objects may have a key twice
    third = F.col("session_id") % 3
    new = F.when(third == 0, "  ").when(third == 1, F.concat(F.lit(" Guest "), "session_id", F.lit(" ")))
    names = lifecycle.put(lifecycle.name_map(F.col("json")), F.when(third < 2, F.lit(1)), new)
    return _names(spark, sf_dir).select("session_id", lifecycle.as_json(names).alias("names"))


@query(
    "with p as (select user_id as session_id, event_type as chunk, count(*) as samples, floor(avg(value) * 1000000 + 0.5001) / 1000000 as pitch from events group by 1, 2), q as (select user_id as session_id, 'click' as chunk, count(*) as samples, floor(max(value) * 1000000 + 0.5001) / 1000000 as pitch from events group by 1), "
    "kept as (select * from p where chunk <> 'click' union all select * from q) select session_id, string_agg(chunk || ':' || samples || ':' || printf('%.6f', pitch), ',' order by chunk) as profiles from kept group by 1"
)
def put_profiles(spark, sf_dir):
    """S178: maps of profiles by chunk, with one chunk's replaced; a user's events for a session, their kinds for chunks."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    profile = lambda pitch: F.struct(F.count("*").alias("samples"), T.settled(pitch).alias("pitch")).alias("p")
    each = e.groupBy("session_id", F.col("event_type").alias("chunk")).agg(profile(F.avg("value")))
    maps = each.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "p"))).alias("m"))
    new = e.groupBy("session_id").agg(profile(F.max("value")))
    merged = maps.join(new, "session_id").withColumn("m", F.map_concat(F.map_filter("m", lambda k, v: k != "click"), F.create_map(F.lit("click"), F.col("p"))))
    shown = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat_ws(":", k, F.element_at("m", k)["samples"], F.format_string("%.6f", F.element_at("m", k)["pitch"])))
    return merged.select("session_id", F.array_join(shown, ",").alias("profiles"))


@query(
    f"with {SEGMENTS}, r as (select session_id, ordinal, trim(regexp_replace(text, '\\s+', ' ', 'g')) as full_text from segments), t as (select *, lag(full_text) over (partition by session_id order by ordinal) as d from r), "
    "m as (select *, 400 * len(string_split(full_text, ' ')) as words, 300 * len(string_split(d, ' ')) as spans from t where d is not null) "
    "select session_id, ordinal, case when length(full_text) = 0 then null when length(d) = 0 then 'diarized_text_empty' when length(full_text) >= 20 and length(full_text) - length(d) >= 12 and length(d) / length(full_text) < 0.55 then 'diarized_text_much_shorter_than_full_text' "
    "when words >= 10000 and spans / words < 0.55 then 'diarized_time_coverage_too_small' when 10000 * (ordinal + 1) >= 20000 and length(full_text) >= 20 and length(d) <= 8 then 'chunk_long_but_diarized_text_too_short' end as reason from m"
)
def completeness_reasons(spark, sf_dir):
    """S163: why a diarized text does not stand for the full one."""
    d = F.lag("text").over(Window.partitionBy("session_id").orderBy("ordinal"))
    t = segments(spark, sf_dir).withColumn("d", d).where("d is not null")
    words = lambda c: F.size(F.split(T.collapse(F.col(c)), " "))
    return t.select("session_id", "ordinal", lifecycle.completeness(F.col("text"), F.col("d"), 400 * words("text"), 300 * words("d"), 10_000 * (F.col("ordinal") + 1)).alias("reason"))


@query(f"with {SESSIONS} select session_id, '{{\"folder\":\"' || folder || '\",\"language\":\"' || language || '\",\"sizeBytes\":' || size_bytes || ',\"version\":1}}' as json from sessions")
def json_export(spark, sf_dir):
    """JSON with sorted keys."""
    fields = {"version": F.lit(exports.VERSION), "folder": F.col("folder"), "language": F.col("language"), "sizeBytes": F.col("size_bytes")}
    return sessions(spark, sf_dir).select("session_id", exports.as_json(fields).alias("json"))


@query(f"with {SESSIONS} select session_id, '# ' || folder || chr(10) || chr(10) || '- Date: ' || strftime(started_at, '%Y-%m-%d %H:%M') || chr(10) || '- Language: ' || language || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || text as markdown from sessions")
def markdown_export(spark, sf_dir):
    """Markdown with the parts that the options name."""
    body = exports.markdown(F.col("folder"), F.col("started_at"), F.col("language"), F.lit(""), F.col("text"), exports.MINIMAL)
    return sessions(spark, sf_dir).select("session_id", body.alias("markdown"))


_STAMP = "strftime({}, '%Y-%m-%d %H:%M')"
_CLOCK = "lpad(({0} // 60000)::varchar, 2, '0') || ':' || lpad(({0} // 1000 % 60)::varchar, 2, '0')"
#: sessions with all that an export shows
_MODELS = (
    f"{SESSIONS}, {SEGMENTS}, t as (select doc_id, list_sort(list_filter([case when quality = 1 then 'good' end, case when toxic = 1 then 'flagged' end], lambda x: x is not null)) as tags from labels), "
    f"seg as (select session_id, list(struct_pack(start_ms, speaker, name := case when speaker = 0 and session_id % 2 = 0 then 'Guest' end, text, at := {_CLOCK.format('start_ms')}) order by ordinal) filter (speaker >= 0) as segments, list(struct_pack(at := {_CLOCK.format('start_ms')}, label := case when session_id % 3 = 0 then role end) order by ordinal) filter (speaker < 0) as highlights from segments group by 1), "
    "m as (select session_id, folder || ' ' || session_id as title, started_at, case when session_id % 4 <> 0 then started_at + interval 1 hour end as ended_at, language, audio_kept, case when session_id % 5 <> 1 then folder end as folder, coalesce(tags, []) as tags, case when session_id % 6 = 0 then 'Paris' end as location, "
    "case when session_id % 5 = 0 then 'Note ' || session_id end as body, case when session_id % 2 = 0 then '# Summary' || chr(10) || '- ' || folder || chr(10) || '## End' end as summary, coalesce(highlights, []) as highlights, coalesce(segments, []) as segments, text as transcript "
    "from sessions left join t on doc_id = session_id left join seg using (session_id))"
)


def _facts_sql(lead: str, after: str) -> str:
    facts = [("Started", _STAMP.format("started_at"), "true"), ("Ended", _STAMP.format("ended_at"), "ended_at is not null"), ("Language", "language", "true"), ("Audio", "case when audio_kept then 'kept' else 'deleted' end", "true")]
    facts += [("Folder", "folder", "folder is not null"), ("Tags", "array_to_string(tags, ', ')", "len(tags) > 0"), ("Location", "location", "location is not null")]
    return "list_filter([" + ", ".join(f"case when {test} then '{lead}{name}{after}' || {value} end" for name, value, test in facts) + "], lambda x: x is not null)"


_NAME = "coalesce(x.name, 'Speaker ' || (x.speaker + 1))"
_N = "chr(10)"
_OPTIONS = {"full": exports.FULL, "minimal": exports.MINIMAL, "bare": exports.ExportOptions(metadata=False, summary=False, highlights=False), "outline": exports.ExportOptions(transcript=False)}


def _markdown_sql(o: exports.ExportOptions) -> str:
    parts = [f"'# ' || title || {_N} || {_N}"]
    if o.metadata:
        parts.append(f"array_to_string({_facts_sql('- **', '**: ')}, {_N}) || {_N} || {_N}")
    parts.append(f"case when body is not null then '## Notes' || {_N} || {_N} || body || {_N} || {_N} else '' end")
    if o.summary:
        parts.append(f"case when summary is not null then summary || {_N} || {_N} else '' end")
    if o.highlights:
        parts.append(f"case when len(highlights) > 0 then '## Highlights' || {_N} || {_N} || array_to_string(list_transform(highlights, lambda x: '- `' || x.at || '`' || case when x.label is not null then ' - ' || x.label else '' end || {_N}), '') || {_N} else '' end")
    if o.transcript:
        parts.append(f"'## Transcript' || {_N} || {_N} || case when len(segments) > 0 then array_to_string(list_transform(segments, lambda x: '**' || {_NAME} || '** [' || x.at || ']: ' || x.text || {_N} || {_N}), '') else transcript || {_N} end")
    return " || ".join(parts)


def _text_sql(o: exports.ExportOptions) -> str:
    parts = ["[title, repeat('=', length(title)), '']"]
    if o.metadata:
        parts.append(f"{_facts_sql('', ': ')} || ['']")
    parts.append("case when body is not null then ['--- Notes ---', body, ''] else [] end")
    if o.summary:
        parts.append(f"case when summary is not null then ['--- Summary ---', replace(replace(replace(summary, '## ', ''), '# ', ''), '- ', '  * '), ''] else [] end")
    if o.highlights:
        parts.append("case when len(highlights) > 0 then ['--- Highlights ---'] || list_transform(highlights, lambda x: '  [' || x.at || '] ' || coalesce(x.label, '')) || [''] else [] end")
    if o.transcript:
        parts.append(f"['--- Transcript ---'] || case when len(segments) > 0 then list_transform(segments, lambda x: '[' || {_NAME} || '] [' || x.at || '] ' || x.text) else [transcript] end")
    return f"array_to_string({' || '.join(f'({p})' for p in parts)}, {_N})"


def _models(spark, sf_dir):
    s, seg = sessions(spark, sf_dir), segments(spark, sf_dir)
    i = F.col("session_id")
    sort = lambda test, *cols: F.array_sort(F.collect_list(F.when(test, F.struct(*cols))))
    told = seg.groupBy("session_id").agg(
        sort(F.col("speaker") >= 0, "start_ms", "speaker", F.when((F.col("speaker") == 0) & (i % 2 == 0), "Guest").alias("name"), "text").alias("segments"),
        sort(F.col("speaker") < 0, F.col("start_ms").alias("at_ms"), F.when(i % 3 == 0, F.col("role")).alias("label")).alias("highlights"),
    )
    labels = table(spark, sf_dir, "labels")
    tags = labels.select(F.col("doc_id").alias("session_id"), F.array_compact(F.array(F.when(F.col("toxic") == 1, "flagged"), F.when(F.col("quality") == 1, "good"))).alias("tags"))
    whole = s.join(tags, "session_id", "left").join(told, "session_id", "left")
    return whole.select(
        "session_id", F.concat_ws(" ", "folder", "session_id").alias("title"), "started_at", F.when(i % 4 != 0, F.col("started_at") + F.expr("interval 1 hour")).alias("ended_at"), "language", "audio_kept", F.when(i % 5 != 1, F.col("folder")).alias("folder"),
        "tags", F.when(i % 6 == 0, "Paris").alias("location"), F.when(i % 5 == 0, F.concat_ws(" ", F.lit("Note"), "session_id")).alias("body"), F.when(i % 2 == 0, F.concat(F.lit("# Summary\n- "), "folder", F.lit("\n## End"))).alias("summary"), "highlights", "segments", F.col("text").alias("transcript"),
    )


def _documents(spark, sf_dir, render):
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("options"), render(o).alias("body")) for name, o in _OPTIONS.items()])).alias("x")
    return _models(spark, sf_dir).select("session_id", kinds).select("session_id", "x.*")


@query(f"with {_MODELS} " + " union all ".join(f"select session_id, '{name}' as options, {_markdown_sql(o)} as body from m" for name, o in _OPTIONS.items()))
def markdown_documents(spark, sf_dir):
    """Markdown of whole sessions, with four sets of options."""
    return _documents(spark, sf_dir, exports.markdown_document)


@query(f"with {_MODELS} " + " union all ".join(f"select session_id, '{name}' as options, {_text_sql(o)} as body from m" for name, o in _OPTIONS.items()))
def text_documents(spark, sf_dir):
    """Plain text of whole sessions, with four sets of options."""
    return _documents(spark, sf_dir, exports.text_document)


@query(f"with {_MODELS} select session_id, {_text_sql(exports.FULL)} as plain from m")
def text_export(spark, sf_dir):
    """Plain text of whole sessions, transcript and summary included."""
    return _models(spark, sf_dir).select("session_id", exports.text_document().alias("plain"))


@query(f"with {SEGMENTS} select session_id, ordinal, start_ms, end_ms, speaker, text from segments where session_id in (select doc_id from documents)")
def backup_round_trip(spark, sf_dir):
    """S09, S10, S175: segments as they come back from the backup's nested documents."""
    m = exports.manifest(sessions(spark, sf_dir), segments(spark, sf_dir))
    return exports.restored(m).select("session_id", "ordinal", "start_ms", "end_ms", "speaker", "text")


@query("select coalesce(source, 'none') as folder, (sum(strlen(lang || chr(10) || text) + 1))::bigint as bytes from documents group by 1")
def export_folder_bytes(spark, sf_dir):
    """Texts written to files by folder, and the bytes below each, from the files' metadata alone."""
    named = sessions(spark, sf_dir).select(F.coalesce("folder", F.lit("none")).alias("name"), F.concat_ws("\n", "language", "text").alias("body"))
    path = f"{scratch_root(spark)}/talkgrain/exports-{uuid.uuid4().hex}"
    exports.write_texts(named, path)
    return exports.folder_bytes(spark, path, "name").withColumnRenamed("name", "folder").select("folder", "bytes")


@query("select o_orderkey as session_id, greatest(0, epoch_ms(timestamp '1998-12-01') - epoch_ms(o_orderdate)) as elapsed_ms from orders")
def elapsed_times(spark, sf_dir):
    """Time since the start, never below 0."""
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    now = F.unix_millis(F.lit("1998-12-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.greatest(F.lit(0).cast("long"), now - start).alias("elapsed_ms"))


@query(f"with {SEGMENTS} select session_id, ordinal, 'Audio/' || session_id || '/' || lpad(ordinal::varchar, 4, '0') || '.m4a' as path from segments")
def audio_paths(spark, sf_dir):
    """S102: relative paths of chunks."""
    return segments(spark, sf_dir).select("session_id", "ordinal", F.format_string("Audio/%d/%04d.m4a", "session_id", "ordinal").alias("path"))
