"""Audio signals: filters, gain, speech frames, spectra, change points, segment embeddings, diarization.

The driver's tables hold no audio: 32 embeddings in a row stand for a signal, and the first 13 numbers of the embeddings of a
label for frames of coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions import signals as S
from talkgrain.operators import signals
from talkgrain.plans.register import registered
from talkgrain.sources.scratch import materialize
from talkgrain.sources.tables import RECORDING, recording, table

QUERIES, ORACLE_SQL = {}, {}
query = registered(QUERIES, ORACLE_SQL)

_SIG = "sig as (select vec_id // 32 as signal, flatten(list(embedding::double[] order by vec_id)) as x from embeddings group by 1)"
_S = f"{_SIG}, s as (select signal, unnest(x) as x, (generate_subscripts(x, 1) - 1)::bigint as i from sig)"
_FRAMES = f"f as (select {RECORDING} as signal, (vec_id // 100)::bigint as segment, row_number() over (partition by {RECORDING} order by vec_id) - 1 as frame, (embedding::double[])[1:13] as mfcc from embeddings)"
_LONG = f"{_FRAMES}, l as (select signal, segment, frame, unnest(mfcc) as x, generate_subscripts(mfcc, 1) - 1 as i from f)"


def _signals(spark, sf_dir) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e"))))
    return table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 32).alias("signal")).agg(F.flatten(F.transform(parts, lambda p: p["e"])).alias("x"))


def _frames(spark, sf_dir) -> DataFrame:
    """Rows (signal, segment, frame, mfcc): a recording of bounded length is a signal; segments are hundreds of ids."""
    frame = F.row_number().over(Window.partitionBy("signal").orderBy("vec_id")).cast("long") - 1
    return table(spark, sf_dir, "embeddings").withColumn("signal", recording()).select("signal", F.floor(F.col("vec_id") / 100).alias("segment"), frame.alias("frame"), F.slice(F.col("embedding").cast("array<double>"), 1, 13).alias("mfcc"))


def _samples(df: DataFrame, x) -> DataFrame:
    return df.select("signal", F.posexplode(x).alias("i", "y")).select("signal", F.col("i").cast("long").alias("i"), F.round("y", 6).alias("y"))


@query(f"with {_S} select signal, i, round(x - 0.97 * coalesce(lag(x) over (partition by signal order by i), 0), 6) as y from s")
def pre_emphasis(spark, sf_dir):
    """S135: each sample less .97 of the one before."""
    return _samples(_signals(spark, sf_dir), S.pre_emphasised(F.col("x")))


@query(f"with {_SIG}, o as (select signal, x, unnest(range(round(len(x) / 1.5)::bigint)) as i from sig) select signal, i, round(x[floor(i * 1.5)::bigint + 1] + (x[least(floor(i * 1.5)::bigint + 2, len(x))] - x[floor(i * 1.5)::bigint + 1]) * (i * 1.5 - floor(i * 1.5)), 6) as y from o")
def resampled(spark, sf_dir):
    """S142: from 24 to 16 kHz by linear interpolation."""
    return _samples(_signals(spark, sf_dir), S.resampled(F.col("x"), 24_000, 16_000))


@query(f"with {_S}, c as (select (1 / (2 * pi() * 80)) / (1 / (2 * pi() * 80) + 1 / 16000.0::double) as a), d as (select signal, i, a, case when i = 0 then x else (x - lag(x) over (partition by signal order by i)) * a end as d from s, c) select signal, i, round(pow(a, i) * sum(d * pow(a, -i)) over (partition by signal order by i rows between unbounded preceding and current row), 6) as y from d")
def high_passed(spark, sf_dir):
    """S143: high-pass filter at 80 Hz."""
    return _samples(_signals(spark, sf_dir), S.high_passed(F.col("x")))


@query(f"with {_S}, r as (select signal, sqrt(avg(x * x)) as rms from s group by 1) select signal, i, round(case when rms > 1e-5 then least(greatest(x * least(greatest(0.08 / rms, 1), 40), -1), 1) else x end, 6) as y from s join r using (signal)")
def gained(spark, sf_dir):
    """S144: automatic gain and clipping."""
    return _samples(_signals(spark, sf_dir), S.gained(F.col("x")))


@query(
    f"with {_S}, b as (select signal, i // 512 as frame, x, lag(x) over (partition by signal, i // 512 order by i) as p from s), "
    "g as (select signal, frame, sqrt(avg(x * x)) as rms, case when count(*) > 1 then count(*) filter (where p is not null and (x >= 0) <> (p >= 0)) / (count(*) - 1) else 0 end as z from b group by 1, 2) "
    "select signal, frame, round(rms, 6) as rms, round(z, 6) as crossings, rms > 0.002 and z > 0.02 and z < 0.5 as speech from g"
)
def speech_frames(spark, sf_dir):
    """S145: frames that look like speech."""
    f = _signals(spark, sf_dir).select("signal", F.posexplode(S.frames(F.col("x"), 512, 512, partial=True)).alias("frame", "f"))
    f = f.select("signal", F.col("frame").cast("long").alias("frame"), S.rms(F.col("f")).alias("rms"), S.crossings(F.col("f")).alias("crossings"))
    return f.select("signal", "frame", F.round("rms", 6).alias("rms"), F.round("crossings", 6).alias("crossings"), S.is_speech(F.col("rms"), F.col("crossings")).alias("speech"))


_SPECTRA = (
    f"with {_S}, e as (select signal, i, x - 0.97 * coalesce(lag(x) over (partition by signal order by i), 0) as x from s), n as (select signal, count(*) as n from s group by 1), "
    "k as (select signal, unnest(range((n - 400) // 160 + 1)) as frame from n where n >= 400), w as (select k.signal, frame, i - frame * 160 as t, x * (0.54 - 0.46 * cos(2 * pi() * (i - frame * 160) / 400)) as x from k join e on e.signal = k.signal and i >= frame * 160 and i < frame * 160 + 400), "
    "p as (select signal, frame, bin, sum(x * cos(2 * pi() * t * bin / 512)) as re, sum(x * sin(2 * pi() * t * bin / 512)) as im from w, (select unnest(range(0, 257)) as bin) group by 1, 2, 3) "
    "select signal, frame, bin, round(re * re + im * im, 4) as power from p"
)


@query(_SPECTRA)
def power_spectra(spark, sf_dir):
    """S136: power of each frame in all 257 bins, the Nyquist bin included."""
    p = signals.spectra(_signals(spark, sf_dir)).select("signal", F.col("frame").cast("long").alias("frame"), F.posexplode("power").alias("bin", "power"))
    return p.select("signal", "frame", F.col("bin").cast("long").alias("bin"), F.round("power", 4).alias("power"))


@query(_SPECTRA)
def full_power_spectra(spark, sf_dir):
    """S136: the same under its earlier name."""
    return power_spectra(spark, sf_dir)


@query()
def cepstral_frames(spark, sf_dir):
    """S137, S138: 13 coefficients a frame."""
    return signals.mfcc(_signals(spark, sf_dir))


@query()
def signal_features(spark, sf_dir):
    """S139, S140, S141: pitch, energy, spectral centroid, jitter and shimmer."""
    return signals.window_features(_signals(spark, sf_dir))


@query(f"with {_FRAMES}, a as (select signal, mfcc, unnest(mfcc) as x, generate_subscripts(mfcc, 1) - 1 as i from f), p as (select signal, i, x, unnest(mfcc) as y, generate_subscripts(mfcc, 1) - 1 as j from a) select signal, p.i::bigint as i, p.j::bigint as j, round(coalesce(covar_samp(x, y), 0) + case when p.i = p.j then 1e-6 else 0 end, 8) as cov from p where j >= i group by signal, p.i, p.j")
def frame_covariances(spark, sf_dir):
    """S130: covariances of the coefficients."""
    c = signals.covariances(_frames(spark, sf_dir), ["signal"])
    return c.select("signal", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("cov", 8).alias("cov"))


def _slope(source: str, x: str, out: str) -> str:
    """SQL of a slope over two frames on either side."""
    near = [f"(coalesce(lead({x}, {n}) over w, last_value({x}) over z) - coalesce(lag({x}, {n}) over w, first_value({x}) over z)) * {n}" for n in (1, 2)]
    return f"select *, ({near[0]} + {near[1]}) / 10 as {out} from {source} window w as (partition by signal, i order by frame), z as (partition by signal, i order by frame rows between unbounded preceding and unbounded following)"


@query(
    f"with {_LONG}, d1 as ({_slope('l', 'x', 'd')}), d2 as ({_slope('d1', 'd', 'dd')}), g as (select signal, segment, i, avg(x) as m, coalesce(stddev_samp(x), 0) as s, avg(d) as d, avg(dd) as dd from d2 group by 1, 2, 3), "
    "c as (select a.signal, a.segment, a.i, b.i as j, covar_samp(a.x, b.x) as cov from l a join l b on a.signal = b.signal and a.frame = b.frame and a.i < b.i group by 1, 2, 3, 4), "
    "r as (select c.signal, c.segment, row_number() over (partition by c.signal, c.segment order by c.i, c.j) - 1 as i, case when a.s * b.s > 1e-10 then cov / (a.s * b.s) else 0 end as v from c join g a on a.signal = c.signal and a.segment = c.segment and a.i = c.i join g b on b.signal = c.signal and b.segment = c.segment and b.i = c.j) "
    "select signal, segment, part, i::bigint as i, round(v, 5) as value from (select signal, segment, 0 as part, i, m as v from g union all select signal, segment, 1, i, s from g union all select signal, segment, 2, i, d from g union all select signal, segment, 3, i, dd from g union all select signal, segment, 4, i, v from r)"
)
def segment_embeddings(spark, sf_dir):
    """S133: the 130 numbers that stand for a segment."""
    s = signals.segment_statistics(_frames(spark, sf_dir), ["signal"])
    return s.select("signal", "segment", "part", F.col("i").cast("long").alias("i"), F.round("value", 5).alias("value"))


#: a recording of talk is TALK documents in a row, a frame of it SLICE characters of a text; it is followed by a pause of PAUSE times its length
TALK, SLICE, PAUSE = 20, 32, 0.6
#: frames of a minute: longer recordings are cut, as they are when they are made
MINUTE = 6000
#: letters whose share is a coefficient; the 13th is that of characters beyond ASCII
LETTERS = "aeiountsrdlh"

_COUNTS = ", ".join(f"(length(x) - length(replace(x, '{c}', ''))) / {SLICE}" for c in LETTERS)
_TALK = (
    f"d as (select doc_id // {TALK} as rec, doc_id, lower(coalesce(text, '')) as t, ceil(length(lower(coalesce(text, ''))) / {SLICE})::bigint as n from documents where doc_id is not null), "
    "o as (select *, coalesce(sum(n) over (partition by rec order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as o from d), "
    f"said as (select rec, o + i as frame, substring(t, (i * {SLICE} + 1)::int, {SLICE}) as x from (select rec, o, t, unnest(range(n)) as i from o)), "
    f"quiet as (select rec, unnest(range(n, round(n * {1 + PAUSE})::bigint)) as frame, '' as x from (select rec, sum(n)::bigint as n from d group by 1)), "
    f"talk as (select rec * 1000000 + frame // {MINUTE} as signal, frame % {MINUTE} as frame, length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) / {SLICE} as energy, "
    f"[{_COUNTS}, length(regexp_replace(x, '[\\x00-\\x7f]', '', 'g')) / {SLICE}] as mfcc from (from said union all from quiet))"
)


def _talk(spark, sf_dir) -> DataFrame:
    """Rows (signal, frame, energy, mfcc): documents as talk, in pieces of a minute; a language is a voice."""
    text = F.lower(F.coalesce("text", F.lit("")))
    # a byte a character: beyond ASCII a letter is one sign and anything else another, and that is all that frames tell of them
    plain = F.regexp_replace(F.regexp_replace(text, "[\\p{L}&&[^\\x00-\\x7f]]", "é"), "[^\\x00-\\x7fé]", "·")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.floor(F.col("doc_id") / TALK).alias("rec"), "doc_id", plain.alias("t"))
    docs = docs.withColumn("n", F.ceil(F.length("t") / SLICE))
    own = Window.partitionBy("rec").orderBy("doc_id")  # of at most TALK documents
    o = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("rec").over(own).isNull()
    end = o + F.col("n")  # that of the recording, in its last document
    docs = docs.select("rec", "t", o.alias("o"), F.when(last, F.round(end * (1 + PAUSE)).cast("long") - end).otherwise(0).alias("pause"))
    return docs.mapInArrow(_framed_talk, "signal long, frame long, energy double, mfcc array<double>")


def _framed_talk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of documents (rec, t, o, pause), o their first frame's place in the recording and pause the silent ones that follow them."""
    signs = [ord(c) for c in LETTERS]
    for b in batches:
        recs, starts, pauses = (b.column(c).to_pylist() for c in ("rec", "o", "pause"))
        for rec, t, o, pause in zip(recs, b.column("t"), starts, pauses, strict=True):
            x = np.frombuffer(t.as_py().encode("latin-1"), np.uint8)
            x = np.concatenate([x, np.zeros(-len(x) % SLICE, np.uint8)]).reshape(-1, SLICE)
            for first in range(0, len(x) + pause, 100_000):  # a long text's frames come in parts
                y = x[first : first + 100_000]
                n = min(100_000, len(x) + pause - first)
                counts = np.zeros((n, len(signs) + 1))
                counts[: len(y)] = np.stack([*((y == c).sum(axis=1) for c in signs), (y > 127).sum(axis=1)], axis=1)
                energy = np.zeros(n)
                energy[: len(y)] = (((y >= 97) & (y <= 122)) | (y == 0xE9)).sum(axis=1) / SLICE
                frame = o + first + np.arange(n)
                values = pa.array((counts / SLICE).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * counts.shape[1], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array(rec * 1_000_000 + frame // MINUTE), pa.array(frame % MINUTE), pa.array(energy), lists], names=["signal", "frame", "energy", "mfcc"])


@query(f"with {_TALK} select signal, frame, round(energy, 6) as energy, array_to_string(list_transform(mfcc, lambda c: (c * {SLICE})::int), ',') as counts from talk")
def talk_frames(spark, sf_dir):
    """The frames that change detection and diarization listen to."""
    counts = F.array_join(F.transform("mfcc", lambda c: (c * SLICE).cast("int").cast("string")), ",")
    return _talk(spark, sf_dir).select("signal", "frame", F.round("energy", 6).alias("energy"), counts.alias("counts"))


@query(
    f"with {_TALK}, x as (select signal, mfcc[1] as a, mfcc[2] as b, mfcc[3] as c from talk where energy > 0), k as (select signal, coalesce(var_samp(a), 0) + 1e-6 as aa, coalesce(var_samp(b), 0) + 1e-6 as bb, coalesce(var_samp(c), 0) + 1e-6 as cc, coalesce(covar_samp(a, b), 0) as ab, coalesce(covar_samp(a, c), 0) as ac, coalesce(covar_samp(b, c), 0) as bc from x group by 1) "
    "select signal, round(ln(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac)), 5) as log_det from k"
)
def frame_log_dets(spark, sf_dir):
    """S131: log-determinants of the covariances of a recording's first three coefficients."""
    few = _talk(spark, sf_dir).where("energy > 0").withColumn("mfcc", F.slice("mfcc", 1, 3))
    return signals.log_dets(signals.covariances(few, ["signal"]), ["signal"]).select("signal", F.round("log_det", 5).alias("log_det"))


@query()
def speaker_changes(spark, sf_dir):
    """S131, S132: change points by the Bayesian information criterion, in the parts of a minute that are not silent."""
    return signals.change_points(_talk(spark, sf_dir).where("energy > 0").withColumn("region", F.lit(0).cast("long")))


@query()
def diarization(spark, sf_dir):
    """S146: who speaks when, minute by minute."""
    return signals.diarized(materialize(_talk(spark, sf_dir), "talk"))  # read several times


@query()
def signal_diarization(spark, sf_dir):
    """S146 from samples: the signals are short, so each is one turn."""
    return signals.diarized(signals.mfcc(_signals(spark, sf_dir)))
