"""Places and running sums within keys of any size, in two levels: within range partitions, then over partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.sources.scratch import materialize

_LOCAL = (1 << 33) - 1


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str] | None = None, place: str = "place") -> DataFrame:
    """`df` with its 1-based `place` within its key by `order` and, for each name: column of `sums`, the sum of that column over the rows up to it.

    The rows are sorted by range over keys and order together, so one key may take many partitions and none of its rows
    pass through one task; rows that are equal in all of these are the only ones kept together, in any order. They are written once, as
    the second level must see the same partitions. Nulls are a key like any other; a null to be summed counts as 0. The keys' names may not begin with an underscore.
    """
    sums = sums or {}
    by = [F.col(k).asc_nulls_first() for k in keys]
    laid = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # the number holds the partition in its upper bits and the place in it in the lower 33
    laid = materialize(laid.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    own = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumns({f"_s{i}": F.sum(F.coalesce(c, F.lit(0))).over(own) for i, c in enumerate(sums.values())}) if sums else laid
    totals = {f"_t{i}": F.sum(c) for i, c in enumerate(sums.values())}
    parts = laid.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *[v.alias(k) for k, v in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_n", *totals)}
    parts = parts.withColumns(known).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_first", "_n", *totals)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p"))
    found = local.join(parts, same).withColumn(place, F.col("_at") - F.col("_first") + F.col("_n") + 1)
    found = found.withColumns({name: F.col(f"_s{i}") + F.col(f"_t{i}") for i, name in enumerate(sums)})
    return found.select(*df.columns, place, *sums)
