"""Embeddings: normalising, similarity, centroids, trimming, enrolment, clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrain.functions import vectors as V
from talkgrain.operators import clusters
from talkgrain.plans.register import registered
from talkgrain.sources.tables import recording, table

QUERIES, ORACLE_SQL = {}, {}
query = registered(QUERIES, ORACLE_SQL)

_E = "e as (select vec_id, label, embedding::double[] as v from embeddings)"
_C = f"{_E}, m as (select label, i, avg(x) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e) group by 1, 2), c0 as (select label, list(x order by i) as c from m group by 1), c as (select label, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) as c from c0)"


@query(f"with {_E} select vec_id, i, round(x / n, 5) as x from (select vec_id, sqrt(list_inner_product(v, v)) as n, unnest(v) as x, generate_subscripts(v, 1) as i from e)")
def unit_vectors(spark, sf_dir):
    """S118: vectors of unit length, all their numbers."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.normalised(F.col("embedding"))).alias("i", "x"))
    return e.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 5).alias("x"))


@query(f"with {_C} select label, i, round(x, 5) as x from (select label, unnest(c) as x, generate_subscripts(c, 1) as i from c)")
def label_centroids(spark, sf_dir):
    """S120, S122: centroid of each label."""
    c = V.centroid(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 5).alias("x"))


def _distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.normalised(F.col("embedding")).alias("v"))
    return e.join(V.centroid(e, ["label"], "v"), "label").withColumn("d", F.round(V.distance(F.col("v"), F.col("centroid")), 5))


_D = f"{_C}, d as (select vec_id, label, round(1 - list_inner_product(v, c) / sqrt(list_inner_product(v, v)), 5) as d from e join c using (label))"


@query(f"with {_D} select vec_id, label, d from d")
def centroid_distances(spark, sf_dir):
    """S119: cosine distance to the own centroid."""
    return _distances(spark, sf_dir).select("vec_id", "label", "d")


@query(f"with {_D}, r as (select *, row_number() over (partition by label order by d desc, vec_id) as r, count(*) over (partition by label) as n from d) select vec_id, label from r where n < 6 or r > greatest(1, floor(n * 0.1))")
def trimmed_members(spark, sf_dir):
    """S127: labels without their tenth of outliers."""
    return clusters.trimmed(_distances(spark, sf_dir).select("vec_id", "label", "d"), "label", "d", "vec_id").select("vec_id", "label")


@query(
    f"with {_C}, p as (select vec_id, c.label as nearest, round(1 - list_inner_product(v, c) / sqrt(list_inner_product(v, v)), 5) as d from e, c), b as (select vec_id, min_by(nearest, {{'d': d, 'l': nearest}}) as nearest, min(d) as d from p group by 1) "
    "select vec_id, nearest, d, case when d <= 0.30 then 'accepted' when d <= 0.40 then 'review' else 'rejected' end as verdict, round(greatest(0, least(1, 1 - d / 0.40)), 5) as confidence from b"
)
def nearest_identity(spark, sf_dir):
    """S125: the nearest enrolled centroid and what its distance means."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.normalised(F.col("embedding")).alias("v"))
    known = V.centroid(e, ["label"], "v").select(F.col("label").alias("nearest"), "centroid")
    return clusters.identified(e.select("vec_id", "v"), known)


ENROLLED = [50.0, 25.0, 1.0, 990.0, 0.025, 0.025]


def acoustic_profiles(spark, sf_dir):
    """user_id, n, d: number of events, distance of their six statistics from ENROLLED."""
    v = F.col("value")
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(v).alias("a"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("s"), F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), (F.avg(F.abs(v - 50)) / 1000).alias("j"))
    own = [F.col("a"), F.col("s"), F.col("lo"), 10 * F.col("hi"), F.col("j"), F.col("s") / 1000]
    return p.select("user_id", "n", V.acoustic_distance(own, [F.lit(x) for x in ENROLLED]).alias("d"))


@query("with f as (select user_id, event_type, value as v from events), p as (select user_id, avg(v) as a, coalesce(stddev_pop(v), 0) as s, count(*) as n, min(v) as lo, max(v) as hi, avg(abs(v - 50)) / 1000 as j from f group by 1) select user_id, n, round(sqrt(2 * pow((a - 50) / 150, 2) + 1 * pow((s - 25) / 50, 2) + 1.5 * pow((lo - 1) / 20, 2) + 1.5 * pow((10 * hi - 990) / 1500, 2) + 0.5 * pow((j - 0.025) / 0.05, 2) + 0.5 * pow((s / 1000 - 0.025) / 0.1, 2)), 6) as d from p")
def acoustic_distances(spark, sf_dir):
    """S121, S141: distance of acoustic profiles from an enrolled one; six statistics of a user's events for the features."""
    return acoustic_profiles(spark, sf_dir).select("user_id", "n", F.round("d", 6).alias("d"))


@query("with p as (select user_id, event_type, avg(value) as m, count(*) as n from events group by 1, 2) select user_id, sum(n)::bigint as n, round(sum(m * n) / sum(n), 6) as merged from p group by 1")
def merged_profiles(spark, sf_dir):
    """S123: profiles merged by their number of samples."""
    p = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return p.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("merged"))


@query(
    "with x as (select user_id, value / 100 as v, value > 40 as speech from events), t as (select user_id, count(*) * 0.5 as sec, avg(case when speech then 1.0 else 0.0 end) as ratio, avg(case when v >= 0.98 then 1.0 else 0.0 end) as clip, "
    "20 * log10(greatest(coalesce(avg(v) filter (speech), 0), 1e-6) / greatest(coalesce(avg(v) filter (not speech), 0), 1e-6)) as snr from x group by 1) "
    "select user_id, array_to_string(list_filter([case when sec < 4.5 then 'duration_short' end, case when sec > 15 then 'duration_long' end, case when snr < 8 then 'snr_low' end, case when ratio < 0.45 then 'speech_ratio_low' end, "
    "case when ratio > 0.98 then 'speech_ratio_high' end, case when clip > 0.02 then 'clipping_high' end], lambda x: x is not null), ',') as reasons from t"
)
def quality_gate(spark, sf_dir):
    """S128: why a take does not pass; a user's events as its samples, half a second each."""
    v, speech = F.col("value") / 100, F.col("value") > 40
    mean = lambda test: F.greatest(F.coalesce(F.avg(F.when(test, v)), F.lit(0.0)), F.lit(1e-6))
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(
        (F.count("*") * 0.5).alias("sec"), F.avg(F.when(speech, 1.0).otherwise(0.0)).alias("ratio"), F.avg(F.when(v >= 0.98, 1.0).otherwise(0.0)).alias("clip"), (20 * F.log10(mean(speech) / mean(~speech))).alias("snr")
    )
    return t.select("user_id", F.array_join(V.quality_reasons(*(F.col(c) for c in ("sec", "snr", "ratio", "clip"))), ",").alias("reasons"))


@query("with p as (select user_id, count(distinct event_type) as prompts, max(event_id) as version from events group by 1) select user_id, prompts, case when prompts = (select count(distinct event_type) from events) then version + 1 end as version from p")
def enrolments(spark, sf_dir):
    """S129: enrolment is complete when every prompt was taken."""
    e = table(spark, sf_dir, "events")
    need = e.agg(F.count_distinct("event_type").alias("need"))
    p = e.groupBy("user_id").agg(F.count_distinct("event_type").alias("prompts"), F.max("event_id").alias("v"))
    return p.join(F.broadcast(need)).select("user_id", "prompts", F.when(F.col("prompts") == F.col("need"), F.col("v") + 1).alias("version"))


@query()
def speaker_clusters(spark, sf_dir):
    """S124: average-linkage clusters of each recording's vectors (tested against merging by hand)."""
    e = table(spark, sf_dir, "embeddings").select(recording().alias("recording"), "vec_id", "embedding")
    return clusters.average_linkage(e, "recording", "vec_id", "embedding")


@query()
def aligned_speakers(spark, sf_dir):
    """S44, S122: speakers matched over the successive chunks of a recording, a third of them by acoustic features (tested against a plain fold)."""
    from talkgrain.operators.joins import align_speakers

    speaker = F.row_number().over(Window.partitionBy("session", "chunk").orderBy("vec_id")).cast("long") - 1  # of at most 50 successive ids
    e = table(spark, sf_dir, "embeddings").withColumn("session", recording()).withColumn("chunk", F.floor(F.col("vec_id") / 50)).withColumn("speaker", speaker)
    number = F.col("embedding").cast("array<double>")
    features = F.array(*[100 * F.element_at(number, i + 1) * scale / 50 for i, scale in enumerate(V.SCALES)])
    return align_speakers(e.select("session", "chunk", "speaker", F.when(F.col("vec_id") % 3 != 0, number).alias("embedding"), features.alias("features"), F.lit(1).alias("samples")))
