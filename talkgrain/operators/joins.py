"""Interval, nearest and similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions import vectors as V
from talkgrain.sources.scratch import discard, materialize

#: intervals are joined by the buckets of so many milliseconds that they touch
BUCKET = 60_000


def _touched(start: str, end: str, bucket: int):
    return F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.greatest(F.col(start), F.col(end) - 1) / bucket)))


def best_overlap(words: DataFrame, segments: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """Each word with the label of the segment that it overlaps most (the first of equals), else of the nearest by midpoint, else 0.

    words: keys, word, start, end; segments: keys, seg, start, end, label. Overlaps are found by an equi-join on the buckets
    that both touch; words without one look for the last midpoint before theirs and the first one after it, in one sorted pass.
    """
    seg = segments.select(*keys, "seg", F.col("start").alias("s"), F.col("end").alias("e"), "label")
    met = words.withColumn("_b", _touched("start", "end", bucket)).join(seg.withColumn("_b", _touched("s", "e", bucket)), [*keys, "_b"])
    overlap = F.least("end", "e") - F.greatest("start", "s")
    met = met.withColumn("overlap", overlap).where("overlap > 0")
    best = met.groupBy(*keys, "word").agg(F.max_by("label", F.struct("overlap", -F.col("seg"))).alias("label"))
    rest = words.join(best, [*keys, "word"], "left_anti")
    mids = seg.groupBy(*keys, ((F.col("s") + F.col("e")) / 2).alias("mid")).agg(F.min(F.struct("seg", "label")).alias("own"))
    asked = rest.select(*keys, ((F.col("start") + F.col("end")) / 2).alias("mid"), F.struct("word").alias("asked"))
    line = asked.unionByName(mids.withColumn("own", F.struct(F.col("mid").alias("at"), "own.*")), allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    before = F.last("own", ignorenulls=True).over(w.orderBy("mid", F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("own", ignorenulls=True).over(w.orderBy(F.desc("mid"), F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    ways = line.withColumn("b", before).withColumn("a", after).where("asked is not null").withColumn("x", F.explode(F.array_compact(F.array("b", "a"))))
    near = ways.groupBy(*keys, "asked.word").agg(F.min_by("x.label", F.struct(F.abs(F.col("mid") - F.col("x.at")), "x.seg")).alias("label"))
    return words.select(*keys, "word").join(best.unionByName(near), [*keys, "word"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def active_segment(points: DataFrame, segments: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """Each point (keys, point, at) with the first segment [start, end) that holds it, or null."""
    seg = segments.select(*keys, "seg", F.col("start").alias("s"), F.col("end").alias("e")).withColumn("_b", _touched("s", "e", bucket))
    met = points.withColumn("_b", F.floor(F.col("at") / bucket)).join(seg, [*keys, "_b"]).where("at >= s and at < e")
    return points.join(met.groupBy(*keys, "point").agg(F.min("seg").alias("seg")), [*keys, "point"], "left")


def chunk_at(points: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Each point with the chunk (keys, idx, duration) that holds it on the common time line; clamped to its ends.

    The last chunk that begins no later than the point, in one sorted pass over both.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    line = chunks.withColumn("e", F.sum("duration").over(w)).withColumn("s", F.col("e") - F.col("duration"))
    line = line.withColumn("last", F.lead("idx").over(w).isNull())
    begins = line.where("duration > 0 or last").select(*keys, F.col("s").alias("t"), "idx")
    both = begins.unionByName(points.select(*keys, F.greatest(F.lit(0), "at").alias("t"), F.struct("point").alias("asked")), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("t", F.col("asked").isNotNull(), "idx").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("held", F.last("idx", ignorenulls=True).over(order))
    return held.where("asked is not null and held is not null").select(*keys, "asked.point", F.col("held").alias("idx"))


def similar_texts(left: DataFrame, right: DataFrame, least: float = 0.3) -> DataFrame:
    """(l, r, similarity) of texts whose word sets have a Jaccard similarity of `least` or more.

    left: l, set; right: r, set. Candidates share one of the rarest words that a similar pair must share (prefix filter; the smaller side is best as left), so no
    pair without a common rare word is made. Of these, only pairs are compared whose sizes, and the words left after the
    common one in the order of rarity, still allow that similarity (size and position filters).
    """
    # any one order of words will do: by their number in `left`, so that words it hasn't come first and need not be looked at
    df = left.select(F.explode("set").alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def prefix(side, key):
        each = side.select(key, F.size("set").alias("n"), F.explode("set").alias("w")).join(df, "w")
        own = Window.partitionBy(key)
        place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "w"))
        near = each.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
        return near.select(key, "w", F.col("n").alias(f"n_{key}"), (F.col("n") - F.col("place") + 1).alias(f"left_{key}"))

    # shared / (n_l + n_r - shared) >= least; the first common word and those after it are all that two texts can share
    enough = F.expr(f"least(left_l, left_r) * {1 + least} >= {least} * (n_l + n_r) - 1e-9")
    pairs = prefix(left, "l").join(prefix(right, "r"), "w").where(enough).select("l", "r").distinct()
    full = pairs.join(left.withColumnRenamed("set", "a"), "l").join(right.withColumnRenamed("set", "b"), "r")
    shared = F.size(F.array_intersect("a", "b"))
    return full.withColumn("similarity", shared / (F.size("a") + F.size("b") - shared)).where(F.col("similarity") >= least).select("l", "r", "similarity")


def greedy_in_order(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Records take, in their order, the most similar segment that no earlier record took. pairs: keys, l, r, similarity.

    Rounds of deferred acceptance: every record proposes its best segment (the least r of equals), a segment holds on to its
    least proposer, and the pairs of all later records with that segment go. A segment's holder only ever gives way to an
    earlier record, so a pair that went can't be in the result, and when no two records propose the same segment, the
    proposals are the result. Nothing is final before: a record that is refused may still displace a later one elsewhere.
    No session goes through one task; there are at most as many rounds as records that compete for each other's segments.
    """
    left = materialize(pairs.where("l is not null"), "pairs")
    best = F.min_by(F.struct(*pairs.columns), F.struct(-F.col("similarity"), "r"))
    while True:
        proposed = left.groupBy(*keys, "l").agg(best.alias("best")).select("best.*")
        held = proposed.groupBy(*keys, "r").agg(F.min("l").alias("_held"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        held = materialize(held, "held")
        if not held.limit(1).count():
            return proposed
        rest = left.join(held, [*keys, "r"], "left").where("_held is null or l <= _held").select(pairs.columns)
        before, left = left, materialize(rest, "pairs")
        discard(before)
        discard(held)


def align_speakers(profiles: DataFrame, threshold: float = 0.4, acoustic: float = 2.0) -> DataFrame:
    """session, chunk, speaker, global_speaker: local speakers of successive chunks matched one to one with global ones.

    profiles: session, chunk, speaker, embedding, samples, and features (six acoustic ones) if there are any. Pairs are taken by ascending
    distance: cosine distance up to `threshold` where both have an embedding, else the distance of the features up to
    `acoustic`; against the profiles as they were before the chunk. A speaker without a match is new; the first chunk's keep their
    numbers. A matched profile takes in the new samples, twice where they have an embedding, as the feature does. A session's chunks are a fold in order.
    """
    import numpy as np
    import pandas as pd

    scales, weights = np.array(V.SCALES), np.array(V.WEIGHTS)

    def unit(v):
        if v is None:
            return None
        v = np.asarray(v, float)
        return v / n if (n := np.linalg.norm(v)) > 1e-10 else v

    def distance(own, known) -> tuple[float, float]:
        if own["v"] is not None and known["v"] is not None:
            return 1 - float(own["v"] @ known["v"]) if len(own["v"]) == len(known["v"]) else 1.0, threshold
        if own["f"] is None or known["f"] is None:
            return np.inf, acoustic
        return float(np.sqrt((weights * ((own["f"] - known["f"]) / scales) ** 2).sum())), acoustic

    def merged(known: dict, own: dict) -> dict:
        n, m = known["n"], own["n"]
        f, v, n = (known["f"] * n + own["f"] * m) / max(n + m, 1) if own["f"] is not None and known["f"] is not None else known["f"], known["v"], n + m
        if own["v"] is not None and (v is None or len(v) == len(own["v"])):
            v, n = (own["v"] if v is None else unit((v * n + own["v"] * m) / max(n + m, 1))), n + m
        return known | {"f": f, "v": v, "n": n}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        known: list[dict] = []
        out = []
        for place, (chunk, rows) in enumerate(pdf.sort_values(["chunk", "speaker"]).groupby("chunk", sort=True)):
            features = rows["features"] if "features" in rows else [None] * len(rows)
            local = [{"s": s, "v": unit(v), "f": None if f is None else np.asarray(f, float), "n": int(n)} for s, v, f, n in zip(rows["speaker"], rows["embedding"], features, rows["samples"], strict=True)]
            pairs = sorted((*distance(x, g), i, k) for i, x in enumerate(local) for k, g in enumerate(known))
            to: dict[int, int] = {}
            for d, most, i, k in sorted(pairs, key=lambda p: (p[0], p[2], p[3])):
                if d <= most and i not in to and k not in to.values():
                    to[i] = k
            for i, k in to.items():
                known[k] = merged(known[k], local[i])
            for i, x in enumerate(local):
                if i not in to:
                    to[i] = len(known)
                    known.append(x | {"s": len(known)})
                out.append((pdf["session"].iloc[0], chunk, x["s"], x["s"] if not place else known[to[i]]["s"]))
        return pd.DataFrame(out, columns=["session", "chunk", "speaker", "global_speaker"])

    return profiles.groupBy("session").applyInPandas(fold, "session long, chunk long, speaker long, global_speaker long")
