"""Places and running sums against plain loops."""

import random

from pyspark.sql import functions as F

from talkgrain.operators.ranks import running


def plain(rows):
    out, n, s = [], {}, {}
    for key, at, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        n[key], s[key] = n.get(key, 0) + 1, s.get(key, 0) + (x or 0)
        out.append((key, at, x, n[key], s[key]))
    return sorted(out, key=str)


def test_running_equals_a_loop(spark):
    r = random.Random(4)
    at = list(range(3_000))
    r.shuffle(at)
    rows = [(None if a % 7 == 0 else 1 if a % 3 == 0 else r.randrange(40), a, None if a % 11 == 0 else r.randrange(100)) for a in at]
    df = spark.createDataFrame(rows, "k long, at long, x long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = running(df, ["k"], [F.col("at")], {"total": "x"}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, found), key=str) == plain(rows)


def test_equal_rows_and_empty_tables(spark):
    same = spark.createDataFrame([(1, 1, 5)] * 4, "k long, at long, x long")
    assert sorted((x.place, x.total) for x in running(same, ["k"], [F.col("at")], {"total": "x"}).collect()) == [(1, 5), (2, 10), (3, 15), (4, 20)]
    assert running(same.limit(0), ["k"], [F.col("at")], {"total": "x"}).collect() == []
