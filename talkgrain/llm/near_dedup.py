"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and verification on full sets.

A document is the set of its distinct 5-word shingles. Its sketch holds M registers; register i is the minimum over the
set of an exponential variable, truncated to the exponentially spaced levels base**-k (Ertl, "SetSketch", 2021). Equal
registers at J >= 0.75 are frequent, so documents that agree in all ROWS registers of one of BANDS bands are candidates:
a pair at J = 0.75 is missed with probability (1 - 0.75**4)**48 = 1e-8. Candidates whose joint maximum-likelihood
estimate is far below the threshold are dropped; the rest are verified on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrain.llm.common import materialize
from talkgrain.llm.components import connected_components

WORDS = 5
BANDS, ROWS = 48, 4
M = BANDS * ROWS
BASE, RATE, TOP = 1.02, 20.0, 4094
#: an estimate this far below the threshold (over six standard deviations) ends a candidate
MARGIN = 0.2
#: documents a side that a task compares at once, and shingles at a time
BLOCK, COLUMNS = 512, 4096
SALTS = 16

_rng = np.random.default_rng(20210101)
_MUL = _rng.integers(0, 2**32, M, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, M, dtype=np.uint32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; of the whole sequence if it has fewer words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(h)])
    return np.unique(h)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set: M registers of 16 bits. Sketches of two sets merge by the maximum."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(M, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 512):
        h = np.multiply.outer(_MUL, x[i : i + 512])
        h += _ADD[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    level = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    return np.clip(level, 0, TOP).astype(np.uint16)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = _WordHashes()
    for pdf in batches:
        n, c1, c2, bands = [], [], [], []
        for text in pdf["text"]:
            s = shingle_set(text, words)
            n.append(len(s))
            digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
            c1.append(digest[0])
            c2.append(digest[1])
            bands.append(registers(s).view(np.int64) if len(s) else None)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": n, "c1": c1, "c2": c2, "bands": bands})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = _WordHashes()
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "s": [shingle_set(t, words).view(np.int64) for t in pdf["text"]]})


def joint_estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how many registers of a are above, below and equal to b's."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def loss(j):
        up, down = p(u - v * j), p(v - u * j)
        return -(more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1)))

    lo, hi, g = np.zeros_like(u), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(40):
        left, right = hi - g * (hi - lo), lo + g * (hi - lo)
        down = loss(left) < loss(right)
        hi, lo = np.where(down, right, hi), np.where(down, lo, left)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.stack(s.to_numpy()).astype(np.int64).view(np.uint16).astype(np.int32) for s in (a, b))
    return pd.Series(joint_estimate((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), n_a.to_numpy(float), n_b.to_numpy(float)))


def _links(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of x's sets are linked with which of y's, from all intersection sizes at once."""
    sizes = np.array([len(s) for s in x + y])
    hashes, column, count = np.unique(np.concatenate(x + y), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        m = np.zeros((len(sizes), min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        m[row[part], column[part] - lo] = 1
        both += m[: len(x)] @ m[len(x) :].T
    either = sizes[: len(x), None] + sizes[None, len(x) :] - both
    return 100 * both.astype(np.float64) >= percent * either


def spanning(a: list[int], b: list[int]) -> list[int]:
    """Numbers of the links (a[i], b[i]) that a spanning forest needs: each joins two trees of those before it."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(i)
    return out


def _block_links(percent: int):
    """Links that join different components within each (p, i, j), as a spanning forest; rows must come sorted by these."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        i, j = rows[0][1:3]
        x = [r for r in rows if r[3] == i]
        y = x if i == j else [r for r in rows if r[3] == j]
        if len({r[5] for r in x + y}) < 2 or not x or not y:
            return []
        hit = _links([r[6] for r in x], [r[6] for r in y], percent)
        hit &= np.array([r[5] for r in x])[:, None] != np.array([r[5] for r in y])[None, :]
        a, b = (z.tolist() for z in np.nonzero(hit))
        return [(x[a[k]][4], y[b[k]][4]) for k in spanning([x[k][5] for k in a], [y[k][5] for k in b])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple[int, int]] = []
            for r in pdf.itertuples(index=False, name=None):
                if held and held[0][:3] != r[:3]:
                    out += links(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if held:
            yield pd.DataFrame(links(held), columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for documents linked at 100 * intersection >= percent * union.

    `docs` needs doc_id and text; other columns are not looked at. A null, empty or blank text has no shingles and no
    links. Equal shingle sets are one class and are compared once, by the class's least doc_id. A null doc_id gets a
    row of its own with null component_id, kept. Rows that repeat a doc_id give one row; if their texts differ, the least
    text counts. An empty table gives an empty result.

    No bucket is expanded into its pairs. Each bucket's members are compared with its pivot, the least doc_id; members
    of different buckets with one pivot form one group. In a group, members linked with the pivot are in one component,
    so only members outside it can add anything: these outliers are compared with the group's other components in
    blocks of at most about BLOCK documents a side, on their full sets, and only the links that join two components leave the
    task, at most one a component.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")).unionByName(docs.where("doc_id is null"))
    table = materialize(docs.mapInPandas(_sketches, "doc_id long, n long, c1 long, c2 long, bands array<long>"), "sketches")
    full = table.where("doc_id is not null and n > 0")
    classes = materialize(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "classes")
    sketches = table.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", "bands")

    banded = sketches.select("doc_id", F.posexplode("bands")).select("doc_id", F.xxhash64("pos", "col").alias("k"))
    pivots = banded.groupBy("k").agg(F.min("doc_id").alias("a"), F.count("*").alias("c")).where("c > 1").select("k", "a")
    star = materialize(banded.join(pivots, "k").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "star")

    wanted = star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct()
    texts = docs.where("doc_id is not null").join(wanted.hint("merge"), "doc_id", "left_semi")
    sets = materialize(texts.mapInPandas(_sets, "doc_id long, s array<long>"), "sets")

    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"r_{x}"))
    near = star.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    likely = near.where(_estimate("r_a", "r_b", "n_a", "n_b") >= percent / 100 - MARGIN).select("a", "b")
    both = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("s_b")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("i"), (F.size("s_a") + F.size("s_b")).cast("long").alias("t"))
    edges = materialize(shared.where(f"100 * i >= {percent} * (t - i)").select("a", "b"), "edges")
    component = materialize(connected_components(edges), "components")

    of = lambda x: component.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    group = star.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("c_a", "a").alias("own"), F.coalesce("c_b", "b").alias("component"))
    out = (F.col("component") != F.col("own")).cast("int")
    group = materialize(group.withColumn("out", out), "groups")
    sizes = group.groupBy("a").agg(F.sum("out").alias("outs"), F.sum(1 - F.col("out")).alias("ins"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    blocks = sizes.where("outs > 0 and lo < hi").select("a", F.ceil(F.col("outs") / BLOCK).alias("no"), F.ceil(F.col("ins") / BLOCK).alias("ni"))
    # a pivot of very many documents is joined by SALTS parts
    dealt = group.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["a", "salt"]).withColumn("block", F.expr("if(out = 1, pmod(xxhash64(b), no), no + pmod(xxhash64(b), ni))"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, if(out = 1, no + ni, no) - 1)")))
    keyed = dealt.select("a", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "b", "component")
    rows = keyed.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "i", "j", "block", "b", "component", "s")
    found = rows.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j").mapInPandas(_block_links(percent), "a long, b long")
    more = materialize(found, "edges")
    if more.limit(1).count():
        component = materialize(connected_components(edges.unionByName(more)), "components")

    by_class = classes.join(component, classes.rep == component.node, "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    linked = full.join(by_class, ["c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = table.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
