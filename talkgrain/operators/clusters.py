"""Identities and clusters of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.functions import vectors as V
from talkgrain.operators.ranks import running
from talkgrain.sources.scratch import materialize

#: fixed values: distances of embeddings, and of six acoustic features, up to which an identity is accepted, left open, adapted
ACCEPT, REVIEW, ADAPT = 0.30, 0.40, 0.22
ACOUSTIC = (1.30, 2.00, 0.90)
MOST, APART = 10, 0.6
#: identities that are broadcast; centres of blocks where there are more
ENROLLED, CENTRES = 10_000, 1_000


def identified(vectors: DataFrame, known: DataFrame) -> DataFrame:
    """vec_id, nearest, d, verdict, confidence: the nearest of the enrolled identities (nearest, centroid).

    The identities are a query set. Up to ENROLLED of them are broadcast; more are put in blocks around some of them, and a
    vector is compared with the blocks only that may hold a nearer one than the best of its nearest block.
    """
    few = known.limit(ENROLLED + 1).count() <= ENROLLED
    pairs = vectors.crossJoin(F.broadcast(known)) if few else _near_pairs(vectors, known)
    d = F.round(V.distance(F.col("v"), F.col("centroid")), 5)
    best = pairs.groupBy("vec_id").agg(F.min(F.struct(d.alias("d"), "nearest")).alias("b")).select("vec_id", "b.nearest", "b.d")
    verdict = F.when(F.col("d") <= ACCEPT, "accepted").when(F.col("d") <= REVIEW, "review").otherwise("rejected")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("d") / max(ACCEPT + 0.01, REVIEW)))
    return best.select("vec_id", "nearest", "d", verdict.alias("verdict"), F.round(sure, 5).alias("confidence"))


def _near_pairs(vectors: DataFrame, known: DataFrame) -> DataFrame:
    """vec_id, v, nearest, centroid: pairs among which each vector's nearest identities are, by the triangle inequality of angles.

    Vectors and identities have unit length. Centres are the CENTRES identities of the least hashes, so what is broadcast is
    bounded. An identity belongs to its nearest centre, and a block's radius is the largest angle in it. A block can't hold
    an identity that is nearer than the angle to its centre less its radius; the distances are compared with a margin for their rounding.
    """
    angle = lambda a, b: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col(a), F.col(b)))))
    centres = materialize(known.orderBy(F.xxhash64("nearest")).limit(CENTRES).select(F.col("centroid").alias("c")).withColumn("block", F.monotonically_increasing_id()), "centres")
    placed = known.crossJoin(F.broadcast(centres)).withColumn("t", angle("centroid", "c")).groupBy("nearest", "centroid").agg(F.min(F.struct("t", "block")).alias("x"))
    placed = materialize(placed.select("nearest", "centroid", "x.*"), "placed")
    blocks = centres.join(placed.groupBy("block").agg(F.max("t").alias("r")), "block")  # CENTRES rows
    ways = F.array_sort(F.collect_list(F.struct("t", "block", "r")))
    seen = vectors.crossJoin(F.broadcast(blocks)).withColumn("t", angle("v", "c")).groupBy("vec_id", "v").agg(ways.alias("ways"))
    seen = materialize(seen.withColumn("first", F.get("ways", 0)["block"]), "seen")
    bound = seen.join(placed.select(F.col("block").alias("first"), "centroid"), "first").groupBy("vec_id").agg(F.min(V.distance(F.col("v"), F.col("centroid"))).alias("most"))
    bent = V.dot(F.col("v"), F.col("v")) < 0.99  # no direction, so all distances are alike
    near = F.filter("ways", lambda w: bent | (1 - F.cos(F.greatest(w["t"] - w["r"], F.lit(0.0))) <= F.col("most") + 2e-5))
    asked = seen.join(bound, "vec_id").select("vec_id", "v", F.explode(near).alias("w")).select("vec_id", "v", F.col("w.block").alias("block"))
    return asked.join(placed.select("block", "nearest", "centroid"), "block")


def verdict(d: Column, accept: float = ACCEPT, review: float = REVIEW) -> tuple[Column, Column]:
    """(reason, confidence) of the distance to the nearest identity; the reasons are fixed values."""
    reason = F.when(d <= accept, "accepted_within_threshold").when(d <= review, "uncertain_between_accept_and_review").otherwise("distance_too_far")
    return reason, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d / max(accept + 0.01, review)))


def adapted(centroid, vector, alpha: float = 0.2):
    """Moving average of a centroid towards a vector, unit length again; alpha within 0.01 and 0.8."""
    a = min(max(alpha, 0.01), 0.8)
    return V.normalised(F.zip_with(centroid, vector, lambda x, y: (1 - a) * x + a * y))


def trimmed(members: DataFrame, group: str, d: str, item: str, least: int = 6, share: float = 0.1) -> DataFrame:
    """Members of groups without the `share` (one at least) that is farthest off; groups of fewer than `least` stay whole.

    Places are counted in two levels, so a group that holds most members is not one task's.
    """
    placed = running(members, [group], [F.desc(d), F.col(item)], place="_place")
    sizes = members.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("_n"))
    kept = (F.col("_n") < least) | (F.col("_place") > F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    return placed.join(sizes, F.col(group).eqNullSafe(F.col("_of"))).where(kept).select(*members.columns)


def merges(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Average-linkage merges (distance, a member of each side) in the order of their distances, by chains of nearest neighbours.

    A chain goes from a cluster to its nearest one until two are each other's nearest; merging those leaves the rest of the chain
    as it is. Every step looks at one row, so n items take time and memory in proportion to n squared.
    """
    n = len(d)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    size, live = np.ones(n), np.ones(n, bool)
    found, chain = [], []
    while len(found) < n - 1:
        if not chain:
            chain.append(int(live.argmax()))
        while True:
            a = chain[-1]
            row = d[a]
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:  # of equally near ones the one that it came from, else the chain may go round
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        a, b = sorted((a, b))
        found.append((float(d[a, b]), a, b))
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
        size[a] += size[b]
        live[b] = False
    return sorted(found, key=lambda m: m[0])


def labelled(n: int, found: list[tuple[float, int, int]], most: int, apart: float) -> np.ndarray:
    """Clusters, numbered by their least members, after the merges up to `apart`, or more while there are over `most` clusters."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for done, (distance, a, b) in enumerate(found):
        if n - done <= most and distance > apart:
            break
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return np.unique([top(i) for i in range(n)], return_inverse=True)[1]


def average_linkage(df: DataFrame, group: str, item: str, vector: str, most: int = MOST, apart: float = APART) -> DataFrame:
    """group, item, cluster: the nearest clusters merge while there are over `most` or the least mean distance is at most `apart`.

    Merging is sequential within a group, here a recording of bounded length; groups run in parallel.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item)
        v = np.array(pdf[vector].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
        return pd.DataFrame({group: pdf[group], item: pdf[item], "cluster": labelled(len(v), merges(1 - v @ v.T), most, apart)})

    kind = dict(df.dtypes)
    return df.groupBy(group).applyInPandas(merge, f"{group} {kind[group]}, {item} {kind[item]}, cluster long")
