"""Where a pattern matches, in code points, by column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: matches whose lengths are summed one by one; the sums of so many are summed apart
BLOCK = 64


def given(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def find(text: Column, pattern: str, group: int = 0, near: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; value is the given group.

    With `near`, each struct has `before`, up to so many characters between the match before and this one, and `after`, the
    next character unless another match begins there.
    The text around the matches and the matches alternate, so their running lengths are the positions. `pattern` must not
    match an empty string. A null text has no matches. Lengths are summed by blocks of BLOCK matches, so that the work
    grows with the number of matches and its square only by 1 / BLOCK**2.
    """
    p = F.lit(pattern)

    def located(x: Column) -> Column:
        steps = F.zip_with(x["before"], x["m"], lambda b, m: (F.length(b) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
        return given(steps, lambda s: placed(x, s))

    def placed(x: Column, steps: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: _sum(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
        # sums of all blocks before each block
        before = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
        return given(before, lambda own: F.transform(x["m"], lambda m, i: span(x, steps, own, m, i)))

    def span(x: Column, steps: Column, before: Column, m: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        end = F.element_at(before, block + 1) + _sum(F.slice(steps, block * BLOCK + 1, i % BLOCK + 1))
        value = m if group == 0 else F.element_at(x["v"], i + 1)
        around = [F.right(F.element_at(x["before"], i + 1), F.lit(near)).alias("before"), F.left(F.element_at(x["before"], i + 2), F.lit(1)).alias("after")] if near else []
        return given(end, lambda e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), value.alias("value"), *around))

    parts = F.struct(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, p, F.lit(0)).alias("m"), *([F.regexp_extract_all(text, p, F.lit(group)).alias("v")] if group else []))
    none = F.expr(f"cast(array() as array<struct<start:bigint,end:bigint,value:string{',before:string,after:string' if near else ''}>>)")
    return F.when(text.rlike(pattern), given(parts, located)).otherwise(none)


def listing(spans: Column) -> Column:
    """kind:start:end of spans in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
