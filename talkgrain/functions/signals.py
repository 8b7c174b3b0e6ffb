"""Samples of a signal as an array column; all but the recursive filter and the spectra are built-in functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: gain control, speech thresholds, pre-emphasis
TARGET, SILENCE, LEAST_GAIN, MOST_GAIN = 0.08, 1e-5, 1.0, 40.0
ENERGY, FEW_CROSSINGS, MANY_CROSSINGS = 0.002, 0.02, 0.5
EMPHASIS = 0.97


def rms(x: Column) -> Column:
    """Root mean square; 0 without samples."""
    return F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))).otherwise(0.0)


def pre_emphasised(x: Column) -> Column:
    return F.transform(x, lambda v, i: F.when(i == 0, v).otherwise(v - EMPHASIS * F.get(x, i - 1)))


def crossings(x: Column) -> Column:
    """Changes of sign by steps; 0 for under two samples."""
    n = F.size(F.filter(F.transform(x, lambda v, i: (i > 0) & ((v >= 0) != (F.get(x, i - 1) >= 0))), lambda c: c))
    return F.when(F.size(x) > 1, n / (F.size(x) - 1)).otherwise(0.0)


def is_speech(level: Column, crossing: Column) -> Column:
    return (level > ENERGY) & (crossing > FEW_CROSSINGS) & (crossing < MANY_CROSSINGS)


def gained(x: Column) -> Column:
    """Scaled towards the target level and clipped to -1..1; near silence stays as it is."""
    level = rms(x)
    gain = F.least(F.greatest(TARGET / level, F.lit(LEAST_GAIN)), F.lit(MOST_GAIN))
    return F.when(level > SILENCE, F.transform(x, lambda v: F.least(F.greatest(v * gain, F.lit(-1.0)), F.lit(1.0)))).otherwise(x)


def resampled(x: Column, source: float, target: float) -> Column:
    """Linear interpolation to another rate; unchanged for rates at most 1 Hz apart or under two samples."""
    if source <= 0 or target <= 0 or abs(source - target) <= 1:
        return x
    ratio = source / target
    last = F.greatest(F.lit(1), F.round(F.size(x) / ratio).cast("int")) - 1

    def at(i: Column) -> Column:
        place = i * F.lit(ratio)
        left = F.least(F.floor(place).cast("int"), F.size(x) - 1)
        right = F.least(F.floor(place).cast("int") + 1, F.size(x) - 1)
        return F.get(x, left) + (F.get(x, right) - F.get(x, left)) * (place - F.floor(place))

    return F.when(F.size(x) > 1, F.transform(F.sequence(F.lit(0), last), at)).otherwise(x)


def frames(x: Column, size: int, hop: int, partial: bool = False) -> Column:
    """Array of frames, whole ones only unless `partial`; empty for a signal that is too short."""
    last = F.floor((F.size(x) - (1 if partial else size)) / hop).cast("int")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(x, k * hop + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def high_passed(x: Column, rate: float = 16_000.0, cutoff: float = 80.0) -> Column:
    """First-order recursive high-pass filter."""
    a = (rc := 1 / (2 * math.pi * cutoff)) / (rc + 1 / rate)
    up = a ** np.arange(1, 257)

    def one(v) -> np.ndarray:
        v = np.asarray(v, float)
        out, steps = v[:1].copy(), np.diff(v)
        parts = [out]
        for i in range(0, len(steps), len(up)):  # within a block the recursion is a scaled running sum
            d = steps[i : i + len(up)]
            k = up[: len(d)]
            parts.append(k * (parts[-1][-1] + np.cumsum(d * a / k)))
        return np.concatenate(parts)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else one(v))

    return run(x)
