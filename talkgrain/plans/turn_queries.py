"""Turns, masks, frames, interval and nearest joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrain.functions import vectors as V
from talkgrain.operators import joins, turns
from talkgrain.plans.register import registered
from talkgrain.sources.tables import chunks, table

QUERIES, ORACLE_SQL = {}, {}
query = registered(QUERIES, ORACLE_SQL)

#: events of a user as turns: each lasts until its own end or the next one's start, in milliseconds
_TURNS = (
    "e as (select user_id, event_id, epoch_us(ts) // 1000000 as start0, event_type as label, floor(value * 20000)::bigint as len from events), "
    "o as (select *, lead(start0) over (partition by user_id order by start0, event_id) as nxt from e), "
    "turns as (select user_id, start0 as start, case when nxt is null then start0 + len else least(start0 + len, nxt) end as \"end\", label from o where nxt is null or nxt > start0)"
)


def _turns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"), F.col("event_type").alias("label"), F.floor(F.col("value") * 20000).alias("len"))
    nxt = F.lead("start").over(Window.partitionBy("user_id").orderBy("start", "event_id"))
    o = e.withColumn("nxt", nxt).where("nxt is null or nxt > start")
    return o.select("user_id", "start", F.when(F.col("nxt").isNull(), F.col("start") + F.col("len")).otherwise(F.least(F.col("start") + F.col("len"), "nxt")).alias("end"), "label")


def _island(source: str, fresh: str, out: str) -> str:
    """SQL of a pass that joins rows up to the next fresh one."""
    return (
        f"{out}_f as (select *, lag(label) over w as pl, lead(label) over w as nl, lag(\"end\") over w as pe, row_number() over w as rn from {source} window w as (partition by user_id order by start)), "
        f"{out}_g as (select *, sum(case when {fresh} then 1 else 0 end) over (partition by user_id order by start) as g from {out}_f), "
        f"{out} as (select user_id, min(start) as start, max(\"end\") as \"end\", min_by(label, start) as label from {out}_g group by user_id, g)"
    )


_SAME = "coalesce(label <> pl, true)"
_COLLAR = "coalesce(label <> pl or start - pe > 100000, true)"
_SHORT = "rn = 1 or \"end\" - start >= 200000"
_ISOLATED = "not coalesce(\"end\" - start < 400000 and pl = nl and pl <> label, false)"


@query(f"with {_TURNS}, {_island('turns', _SAME, 'a')} select * from a")
def merged_turns(spark, sf_dir):
    """Consecutive turns of one label become one."""
    return turns.merge_same(_turns(spark, sf_dir), ["user_id"])


@query(f"with {_TURNS}, {_island('turns', _COLLAR, 'a')} select * from a")
def collared_turns(spark, sf_dir):
    """The same, if the gap is small."""
    return turns.collar_merge(_turns(spark, sf_dir), ["user_id"], 100_000)


@query(f"with {_TURNS}, {_island('turns', _ISOLATED, 'a')} select * from a")
def without_isolated_turns(spark, sf_dir):
    """Short turns between two of one other label go."""
    return turns.drop_isolated(_turns(spark, sf_dir), ["user_id"], 400_000)


@query(f"with {_TURNS}, {_island('turns', _SHORT, 'a')} select * from a")
def without_short_turns(spark, sf_dir):
    """Short turns are added to the one before."""
    return turns.absorb_short(_turns(spark, sf_dir), ["user_id"], 200_000)


@query(f"with {_TURNS}, {_island('turns', _SHORT, 'a')}, {_island('a', _COLLAR, 'b')}, {_island('b', _ISOLATED, 'c')}, {_island('c', _SAME, 'd')} select * from d")
def smoothed_turns(spark, sf_dir):
    """All four passes."""
    return turns.smooth(_turns(spark, sf_dir), ["user_id"], 200_000, 100_000, 400_000)


_FRAMES = "f as (select user_id, row_number() over (partition by user_id order by ts, event_id) as frame, value, value > 60 as \"on\" from events)"


def _frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).cast("long").alias("frame"), "value", (F.col("value") > 60).alias("on"))


@query(f"with {_FRAMES}, g as (select user_id, frame, frame - row_number() over (partition by user_id order by frame) as i from f where \"on\") select user_id, min(frame) as start, max(frame) + 1 as \"end\" from g group by user_id, i")
def speech_regions(spark, sf_dir):
    """Runs of frames with speech."""
    return turns.regions(_frames(spark, sf_dir), ["user_id"])


@query(
    f"with {_FRAMES}, a as (select user_id, frame, max(\"on\") over (partition by user_id order by frame rows between 15 preceding and 15 following) as \"on\" from f), "
    "b as (select user_id, frame, min(\"on\") over (partition by user_id order by frame rows between 15 preceding and 15 following) as \"on\" from a), "
    "c as (select user_id, frame, min(\"on\") over (partition by user_id order by frame rows between 10 preceding and 10 following) as \"on\" from b) "
    "select user_id, frame, max(\"on\") over (partition by user_id order by frame rows between 10 preceding and 10 following) as \"on\" from c"
)
def cleaned_mask(spark, sf_dir):
    """Closing, then opening, of the speech mask."""
    return turns.close_open(_frames(spark, sf_dir), ["user_id"]).select("user_id", "frame", "on")


@query(f"with {_FRAMES} select user_id, frame, max(\"on\") over (partition by user_id order by frame rows between 15 preceding and current row) as \"on\" from f")
def speech_hangover(spark, sf_dir):
    """S155: speech lasts 15 frames longer."""
    return _frames(spark, sf_dir).select("user_id", "frame", turns.hangover(F.col("on"), ["user_id"]).alias("on"))


@query(
    f"with {_FRAMES}, p as (select user_id, frame, value, first_value(value) over z as fv, last_value(value) over z as lv, lag(value, 1) over w as b1, lag(value, 2) over w as b2, lead(value, 1) over w as a1, lead(value, 2) over w as a2 from f window w as (partition by user_id order by frame), z as (partition by user_id order by frame rows between unbounded preceding and unbounded following)) "
    "select user_id, frame, round(((coalesce(a1, lv) - coalesce(b1, fv)) + 2 * (coalesce(a2, lv) - coalesce(b2, fv))) / 10, 6) as delta from p"
)
def frame_deltas(spark, sf_dir):
    """Slope over two frames on either side."""
    return _frames(spark, sf_dir).select("user_id", "frame", F.round(turns.delta("value", ["user_id"]), 6).alias("delta"))


@query(f"with {_FRAMES}, s as (select user_id, value, abs(value - lag(value) over (partition by user_id order by frame)) as d from f) select user_id, round(case when avg(value) > 0 then avg(d) / avg(value) else 0 end, 6) as instability from s group by 1")
def jitter(spark, sf_dir):
    """Mean step by mean value."""
    out = turns.instability(_frames(spark, sf_dir), ["user_id"], "value", "frame")
    return out.select("user_id", F.round("instability", 6).alias("instability"))


@query(f"with {_FRAMES}, r as (select user_id, value, row_number() over (partition by user_id order by value) - 1 as r, count(*) over (partition by user_id) as n from f), b as (select user_id, max(case when r = floor(n * 0.3) then value end) as base, max(value) as top from r group by 1) select user_id, round(base + 0.4 * (top - base), 6) as threshold from b")
def speech_thresholds(spark, sf_dir):
    """S134: adaptive threshold of each series."""
    return turns.vad_threshold(_frames(spark, sf_dir), ["user_id"], "value").select("user_id", F.round("threshold", 6).alias("threshold"))


@query(f"with {_FRAMES}, l as (select user_id, frame, list(value) over (partition by user_id order by frame rows between 29 preceding and current row) as v from f) select user_id, frame, round(list_sum(v) / 30, 6) as mean_level, 30 - len(v) as padded from l")
def meter_history(spark, sf_dir):
    """The last 30 levels, zeros before the first."""
    f = _frames(spark, sf_dir).select("user_id", "frame", turns.last_levels("value", ["user_id"], "frame").alias("v"), F.least(F.col("frame"), F.lit(30)).alias("have"))
    return f.select("user_id", "frame", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / 30, 6).alias("mean_level"), (30 - F.col("have")).alias("padded"))


@query("select event_id, round(case when value - 70 <= -60 then 0.0 when value - 70 >= 0 then 1.0 else pow(10, (value - 70) / 50) end, 6) as meter, round(greatest(0, least(1, (20 * log10(greatest(value / 1000, 1e-10)) + 60) / 60)), 6) as level, round(2595 * log10(1 + value / 700), 6) as mel from events")
def level_scales(spark, sf_dir):
    """S98, S99, S100: meter, level and mel scales."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(V.meter(v - 70), 6).alias("meter"), F.round(V.level(v / 1000), 6).alias("level"), F.round(V.mel(v), 6).alias("mel"))


_WORDS = (
    "words as (select user_id, event_id as word, epoch_us(ts) // 1000000 as s, epoch_us(ts) // 1000000 + floor(value * 1000)::bigint + 1 as e from events where event_type = 'click'), "
    "segs as (select user_id, event_id as seg, epoch_us(ts) // 1000000 as s, epoch_us(ts) // 1000000 + floor(value * 600)::bigint + 1 as e, event_id % 7 as label from events where event_type <> 'click')"
)


def _words(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("start", F.unix_seconds(F.col("ts").cast("timestamp")))
    words = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("word"), "start", (F.col("start") + F.floor(F.col("value") * 1000) + 1).alias("end"))
    segs = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("seg"), "start", (F.col("start") + F.floor(F.col("value") * 600) + 1).alias("end"), (F.col("event_id") % 7).alias("label"))
    return words, segs


@query(
    f"with {_WORDS}, p as (select w.user_id, word, seg, label, greatest(0, least(w.e, g.e) - greatest(w.s, g.s)) as o, abs((w.s + w.e) / 2.0 - (g.s + g.e) / 2.0) as d from words w join segs g using (user_id)), "
    "b as (select user_id, word, label, row_number() over (partition by user_id, word order by o desc, case when o = 0 then d end, seg) as r from p) "
    "select w.user_id, w.word, coalesce(b.label, 0) as label from words w left join b on b.user_id = w.user_id and b.word = w.word and b.r = 1"
)
def word_speakers(spark, sf_dir):
    """Each word's segment by overlap, else by distance."""
    words, segs = _words(spark, sf_dir)
    return joins.best_overlap(words, segs, ["user_id"], bucket=3_600_000)


@query(f"with {_WORDS} select w.user_id, w.word as point, min(g.seg) as seg from words w left join segs g on g.user_id = w.user_id and w.s >= g.s and w.s < g.e group by 1, 2")
def active_segments(spark, sf_dir):
    """The segment that plays at a point."""
    words, segs = _words(spark, sf_dir)
    points = words.select("user_id", F.col("word").alias("point"), F.col("start").alias("at"))
    return joins.active_segment(points, segs, ["user_id"], bucket=3_600_000).select("user_id", "point", "seg")


@query(
    "with c as (select l_orderkey as session_id, l_linenumber as idx, sum(l_quantity * 1000)::bigint as duration from lineitem group by 1, 2), t as (select *, sum(duration) over (partition by session_id order by idx) as e, lead(idx) over (partition by session_id order by idx) is null as last from c), "
    "p as (select o_orderkey as session_id, o_custkey as point, floor(o_totalprice)::bigint as moment from orders) "
    "select session_id, point, min(idx) as idx from p join t using (session_id) where (moment >= e - duration and moment < e) or (last and moment >= e) group by 1, 2"
)
def chunk_of_point(spark, sf_dir):
    """The chunk that holds a point, the last one beyond the end."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("idx")).agg(F.round(F.sum(F.col("l_quantity") * 1000)).cast("long").alias("duration"))
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("point"), F.floor("o_totalprice").alias("at"))
    return joins.chunk_at(points, c, ["session_id"])


@query("with c as (select l_orderkey as session_id, l_linenumber as idx from lineitem), b as (select distinct session_id, idx from c) select session_id, idx, lead(idx) over (partition by session_id order by idx) as until from b")
def split_points(spark, sf_dir):
    """Regions between successive boundaries."""
    b = chunks(spark, sf_dir).select("session_id", "idx").distinct()
    return b.withColumn("until", F.lead("idx").over(Window.partitionBy("session_id").orderBy("idx")))


@query("select user_id, epoch_us(ts) // 60000000000 * 60000 as start, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def minute_chunks(spark, sf_dir):
    """S147: tumbling windows of a minute of a thousandth's pace."""
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000_000) * 60_000
    return table(spark, sf_dir, "events").groupBy("user_id", minute.alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("select user_id, max(gap) as longest_gap, count(*) filter (where gap > 86400000000) as stalls from (select user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events) group by 1")
def stalls(spark, sf_dir):
    """S158: gaps in a series that are longer than a day."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g = table(spark, sf_dir, "events").select("user_id", gap.alias("gap"))
    return g.groupBy("user_id").agg(F.max("gap").alias("longest_gap"), F.count(F.when(F.col("gap") > 86_400_000_000, 1)).alias("stalls"))
