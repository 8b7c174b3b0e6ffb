"""Document fingerprints: bottom-k sketches of 5-word shingle hashes.

DataFrame functions only. A sketch is the sorted array of the K smallest distinct 48-bit shingle hashes. Sketches merge by
`merge`; `resemblance`, `containment` and `distinct` estimate from sketches alone, and are exact for sets of under K shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.common import keyed

K, WORDS = 128, 5
SPACE = 2.0**48
#: documents of one range, about, up to so many ranges (beyond, ranges are longer: their order is sorted with spilling); keys that
#: a task sorts to part them
PER_RANGE, RANGES, PER_TASK = 4_000, 1_000_000, 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def sketch(w: Column, k: int = K) -> Column:
    """Bottom-k sketch of an array of words; all of them as one shingle if there are fewer than five."""
    n = F.size(w)
    at = lambda i, j: F.element_at(w, i + j)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - WORDS + 1, F.lit(1))), lambda i: F.shiftrightunsigned(F.xxhash64(*[at(i, j) for j in range(WORDS)]), 16))
    own = F.when(n >= WORDS, each).when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(w), 16))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.slice(F.sort_array(F.array_distinct(own)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(sketches: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """(key, sketch) of the union of each key's sketches. No key's values are gathered: the k smallest distinct hashes are
    ranked within salts first, so what a key brings together is a few times k hashes."""
    hashes = sketches.select(F.col(key), F.explode(column).alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(64)))
    near = hashes.withColumn("r", F.row_number().over(Window.partitionBy(key, "salt").orderBy("h"))).where(F.col("r") <= k)
    return near.groupBy(key).agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity; 1 for two empty sets."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both))


def distinct(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * SPACE / (F.element_at(a, k) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has too; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct(a, k)))


def text_form(a: Column) -> Column:
    """A sketch as a string: base64 of its 6-byte hashes."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 12, "0")), ""))), "\r\n", "")


def starts(keys: DataFrame, key: str) -> list[int]:
    """In ascending order, the least of `keys` and further ones that part them into ranges of about equal numbers.

    Keys alone are sorted, in tasks of at most about PER_TASK; the driver gets one key a range.
    """
    count = keys.count()
    each = max(PER_RANGE, -(-count // RANGES))
    placed = keys.repartitionByRange(-(-count // PER_TASK) or 1, key).sortWithinPartitions(key).select(key, F.monotonically_increasing_id().alias("place"))
    in_task = F.col("place").bitwiseAND((1 << 33) - 1)
    return sorted(r[0] for r in placed.where(in_task % each == 0).select(key).collect())


def with_ranges(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with `range` and `extra`: every row in the range of its key, and the first row of each range once more, as the
    extra last row of the range before (of the last one, for the first range). So each row's next one is in its range.

    A row finds its range by binary search among the ranges' first keys.
    """
    firsts = starts(docs.select(key), key)
    if not firsts:
        return docs.select("*", F.lit(0).alias("range"), F.lit(False).alias("extra"))
    n, known = len(firsts), F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>")
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    further = lambda at, step: (at + step <= n) & (F.element_at(known, F.least(at + step, F.lit(n))) <= F.col(key))
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))
    ranged = docs.withColumn("range", place)
    is_first = F.element_at(known, F.col("range")) == F.col(key)
    before = F.when(F.col("range") == 1, n).otherwise(F.col("range") - 1)
    own = F.struct(F.col("range"), F.lit(False).alias("extra"))
    both = F.when(is_first, F.array(own, F.struct(before.alias("range"), F.lit(True).alias("extra")))).otherwise(F.array(own))
    return ranged.select(*docs.columns, F.inline(both))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // 2 code points replaced by the first as many (or all) of the next document.
    `docs` needs doc_id and text; other columns are not looked at. Null texts are empty; empty texts have an empty
    fingerprint, which is like another empty one (1) and unlike any other (0). Null doc_ids come first in the order, repeated
    ones in the order of their texts, a row each. A single document is its own next one. An empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranged = with_ranges(keyed(own, "key", [F.col("doc_id").asc_nulls_first(), F.col("text")]), "key")
    following = Window.partitionBy("range").orderBy("extra", "key")
    place = ["range", "extra", "key", "doc_id"]
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.lead("text").over(following), F.lit(1), half))
    texts = ranged.select(*place, "text", edited.alias("edited"))
    split = texts.select(*place, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), words(F.col("text")).alias("w"), words(F.col("edited")).alias("e"))
    sketched = split.select(*place, "n_chars", "edited_sha256", sketch(F.col("w"), k).alias("a"), sketch(F.col("e"), k).alias("b"))
    last = sketched.withColumn("c", F.lead("a").over(following)).where(~F.col("extra"))
    return last.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("a")).alias("fingerprint"), text_form(F.col("b")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), resemblance(F.col("a"), F.col("c"), k).alias("near_next"))
