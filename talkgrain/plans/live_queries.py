"""Batch twins of the streaming jobs over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talkgrain.plans.register import registered
from talkgrain.plans.text_queries import _SCORES
from talkgrain.sources.scratch import scratch_root
from talkgrain.sources.tables import CHUNKS, chunk_columns, table
from talkgrain.streaming import live, recogniser, upkeep

QUERIES, ORACLE_SQL = {}, {}
query = registered(QUERIES, ORACLE_SQL)
#: hypotheses of a turn
STEPS = 16


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", "value")


@query("select user_id as session, time_bucket(interval 60 second, ts) as start, time_bucket(interval 60 second, ts) + interval 60 second as \"end\", count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def live_minutes(spark, sf_dir):
    """S147: event-time windows of a minute."""
    return live.minute_windows(_events(spark, sf_dir)).withColumn("total", F.round("total", 6))


@query(
    "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as i from g) "
    "select user_id as session, min(ts) as start, max(ts) + interval 6 hour as \"end\", count(*) as n from s group by user_id, i"
)
def live_sessions(spark, sf_dir):
    """S158: stretches without a stall of six hours."""
    return live.session_activity(_events(spark, sf_dir), "6 hours")


def _hypotheses(spark, sf_dir):
    """Partial hypotheses: each turn's text grows in STEPS parts at most, a second apart, a turn begins every 10,000 seconds."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", F.split("text", " ").alias("w"))
    step = F.ceil(F.size("w") / STEPS)
    grown = turns.select("session", "turn", "w", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(1).cast("long"), F.size("w").cast("long"), step), F.array(F.size("w").cast("long"))))).alias("k"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 10_000 + F.col("k"))
    return grown.select("session", at.alias("ts"), F.array_join(F.slice("w", F.lit(1), F.col("k").cast("int")), " ").alias("text"), F.lit(False).alias("final"))


@query()
def live_segments(spark, sf_dir):
    """S149, S150, S151: confirmed segments from partial hypotheses (tested on cases)."""
    return live.assemble_batch(_hypotheses(spark, sf_dir))


@query()
def live_cycles(spark, sf_dir):
    """S148 to S151: confirmed segments with recogniser cycles and timers, the batch twin of the stream (tested against a loop and the stream)."""
    return recogniser.transcribed(_hypotheses(spark, sf_dir))


@query(
    "with t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn desc) as back from conversations), "
    "done as (select conv_id, string_agg(text, ' ' order by turn) as said, string_split(string_agg(text, ' ' order by turn) filter (back <= 4), ' ') as w from t where back > 1 group by 1), open as (select conv_id, array_to_string(string_split(text, ' ')[1:5], ' ') as partial from t where back = 1) "
    "select conv_id as session, concat_ws(' ', said, partial) as text, array_to_string(w[greatest(len(w) - 99, 1):], ' ') as context from open left join done using (conv_id)"
)
def live_states(spark, sf_dir):
    """S152, S153: the text of sessions whose last turn is still open, and the context for the next recogniser."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text")
    last = turns.groupBy("session").agg(F.max("seq").alias("seq"))
    partial = turns.join(last, ["session", "seq"]).select("session", F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("text"))
    return recogniser.live_state(turns.join(last, ["session", "seq"], "left_anti"), partial)


@query(
    f"with {CHUNKS}, last as (select session_id, max(status) as status from chunks group by session_id, idx), states as (select session_id from last group by 1 having bool_and(status = 2)), {_SCORES}, r as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, i) as r from scores) "
    "select doc_id as session_id, string_agg(sentence, ' ' order by i) as summary from r where r <= 3 and doc_id in (select session_id from states) group by 1"
)
def automatic_summaries(spark, sf_dir):
    """S160, S162: a stream of chunk states; sessions that are finalised get a summary."""
    source = table(spark, sf_dir, "lineitem")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{sf_dir}/lineitem.parquet*")  # a pattern may be a file or a folder
    states = chunk_columns(stream).select("session_id", F.col("idx").cast("long").alias("idx"), F.col("status").cast("int").alias("status"), F.col("status").cast("long").alias("seq"))  # of the rows that the table has of a chunk, the furthest
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), "text")
    return upkeep.run(states, texts, f"{scratch_root(spark)}/talkgrain/upkeep-{uuid.uuid4().hex}")
