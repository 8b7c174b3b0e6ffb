"""Vectors as array columns; sums in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; as it is if its norm is 1e-10 or less."""
    n = norm(a)
    return F.when(n > 1e-10, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def similarity(a: Column, b: Column) -> Column:
    """Cosine of unit vectors; 0 if sizes differ or there is nothing."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b)).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    return 1 - similarity(a, b)


#: fixed values: what the six acoustic features are divided by and weighted with
SCALES = [150.0, 50.0, 20.0, 1500.0, 0.05, 0.10]
WEIGHTS = [2.0, 1.0, 1.5, 1.5, 0.5, 0.5]


def acoustic_distance(a: list[Column], b: list[Column]) -> Column:
    """Weighted distance of two six-dimensional acoustic vectors."""
    parts = [w * ((x - y) / s) ** 2 for x, y, s, w in zip(a, b, SCALES, WEIGHTS, strict=True)]
    return F.sqrt(sum(parts[1:], parts[0]))


def centroid(df, keys: list[str], column: str):
    """Mean vector of each group, then unit length: element-wise partial averages, no group is gathered."""
    each = df.select(*keys, F.posexplode(column).alias("i", "x"))
    mean = each.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    put = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return mean.groupBy(*keys).agg(put.alias("m")).select(*keys, normalised(F.col("m")).alias("centroid"))


def level(rms: Column) -> Column:
    """Root mean square to 0..1 over 60 dB."""
    db = 20 * F.log10(F.greatest(rms, F.lit(1e-10)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (db + 60) / 60))


def meter(db: Column) -> Column:
    return F.when(db <= -60, 0.0).when(db >= 0, 1.0).otherwise(F.pow(F.lit(10.0), db / 50))


def mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def hertz(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)


def quality_reasons(seconds: Column, snr_db: Column, speech: Column, clipped: Column) -> Column:
    """Why a take is no good, as an array of reasons; bounds and reasons are fixed values."""
    rules = [
        (seconds < 4.5, "duration_short"),
        (seconds > 15.0, "duration_long"),
        (snr_db < 8.0, "snr_low"),
        (speech < 0.45, "speech_ratio_low"),
        (speech > 0.98, "speech_ratio_high"),
        (clipped > 0.02, "clipping_high"),
    ]
    return F.array_compact(F.array(*[F.when(test, reason) for test, reason in rules]))
