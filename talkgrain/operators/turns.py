"""Order-sensitive operators on time-sorted turns, masks and frames, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list[str], at: str = "start"):
    return Window.partitionBy(*keys).orderBy(at)


def _islands(turns: DataFrame, keys: list[str], fresh: Column) -> DataFrame:
    """Rows up to the next `fresh` one become one, with the first label, least start and largest end."""
    w = _order(keys)
    marked = turns.withColumn("_f", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_i", F.sum("_f").over(w))
    return marked.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", "start").alias("label")).drop("_i")


def merge_same(turns: DataFrame, keys: list[str]) -> DataFrame:
    return _islands(turns, keys, F.col("label") != F.lag("label").over(_order(keys)))


def collar_merge(turns: DataFrame, keys: list[str], collar: int = 300) -> DataFrame:
    """Same label and a gap of at most `collar` become one turn."""
    w = _order(keys)
    return _islands(turns, keys, (F.col("label") != F.lag("label").over(w)) | (F.col("start") - F.lag("end").over(w) > collar))


def absorb_short(turns: DataFrame, keys: list[str], least: int = 500) -> DataFrame:
    """Turns under `least`, but the first, are added to the turn before them."""
    w = _order(keys)
    first = F.row_number().over(w) == 1
    return _islands(turns, keys, first | (F.col("end") - F.col("start") >= least))


def drop_isolated(turns: DataFrame, keys: list[str], under: int = 1000) -> DataFrame:
    """Turns under `under` between two of one other label are added to the turn before them."""
    w = _order(keys)
    before, after = F.lag("label").over(w), F.lead("label").over(w)
    isolated = (F.col("end") - F.col("start") < under) & (before == after) & (before != F.col("label"))
    return _islands(turns, keys, ~F.coalesce(isolated, F.lit(False)))


def smooth(turns: DataFrame, keys: list[str], least: int = 500, collar: int = 300, isolated: int = 1000) -> DataFrame:
    """The four passes in their order."""
    return merge_same(drop_isolated(collar_merge(absorb_short(turns, keys, least), keys, collar), keys, isolated), keys)


def regions(mask: DataFrame, keys: list[str], at: str = "frame", flag: str = "on") -> DataFrame:
    """Half-open [start, end) of consecutive frames whose flag is set."""
    w = Window.partitionBy(*keys).orderBy(at)
    on = mask.where(F.col(flag)).withColumn("_g", F.col(at) - F.row_number().over(w))
    return on.groupBy(*keys, "_g").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end")).drop("_g")


def dilate(flag: Column, keys: list[str], half: int, at: str = "frame") -> Column:
    return F.max(flag).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(-half, half))


def erode(flag: Column, keys: list[str], half: int, at: str = "frame") -> Column:
    return F.min(flag).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(-half, half))


def close_open(mask: DataFrame, keys: list[str], close: int = 15, opened: int = 10) -> DataFrame:
    """Closing, then opening, of the flag `on`; frames beyond the edges do not count."""
    out = mask
    for step, half in ((dilate, close), (erode, close), (erode, opened), (dilate, opened)):
        out = out.withColumn("on", step(F.col("on"), keys, half))
    return out


def hangover(flag: Column, keys: list[str], frames: int = 15, at: str = "frame") -> Column:
    """Speech lasts `frames` frames longer than its last frame."""
    return F.max(flag).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(-frames, 0))


def delta(x: str, keys: list[str], at: str = "frame") -> Column:
    """Regression slope over two frames on either side, clamped at the edges."""
    w = Window.partitionBy(*keys).orderBy(at)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(x).over(whole), F.last(x).over(whole)
    near = [(F.coalesce(F.lead(x, n).over(w), last) - F.coalesce(F.lag(x, n).over(w), first)) * n for n in (1, 2)]
    return (near[0] + near[1]) / 10


def instability(df: DataFrame, keys: list[str], x: str, at: str) -> DataFrame:
    """Mean absolute difference of successive values by their mean (jitter, shimmer)."""
    w = Window.partitionBy(*keys).orderBy(at)
    stepped = df.withColumn("_d", F.abs(F.col(x) - F.lag(x).over(w)))
    return stepped.groupBy(*keys).agg(F.when(F.avg(x) > 0, F.avg("_d") / F.avg(x)).otherwise(0.0).alias("instability"))


def offsets(keys: list[str], duration: str, at: list[str]) -> Column:
    """Where each chunk starts on the common time line."""
    w = Window.partitionBy(*keys).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(duration).over(w), F.lit(0))


def last_levels(x: str, keys: list[str], at: str, n: int = 30) -> Column:
    """The last n values up to here, zeros before the first."""
    have = F.collect_list(x).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(-(n - 1), 0))
    return F.concat(F.array_repeat(F.lit(0.0), n - F.size(have)), have)


def vad_threshold(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, threshold: the value at zero-based place floor(.3 n) in order, plus .4 of the way to the largest."""
    w = Window.partitionBy(*keys).orderBy(x)
    placed = df.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    base = F.max(F.when(F.col("_r") == F.floor(F.col("_n") * 0.3), F.col(x)))
    return placed.groupBy(*keys).agg((base + 0.4 * (F.max(x) - base)).alias("threshold"))
