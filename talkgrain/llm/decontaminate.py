"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as letters and digits in lower case with one space between runs of them. An item of n characters may
differ by k = n // 10 edits from the passage that leaks it. Such a passage shares at least n + 1 - q (k + 1) q-grams with the item,
on diagonals that differ by k at most, so they all lie in one of the overlapping bands of 2 (k + 1) diagonals: bands with
fewer hits are dropped without loss, the others are verified by alignment within the band. q is Q, or less for an item so
short that the bound would fall below one. Texts that are searched together are apart by a character that no alignment
may cross, so it does not matter which ones they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import discard, materialize

Q = 8
#: one edit per so many characters
PER_EDIT = 10
#: characters of benchmark items that one pass over the documents searches for
BLOCK_CHARS = 4_000_000
#: characters of documents that are looked at together
AT_ONCE = 2_000_000
#: shared q-grams that are listed together, and cells of an alignment; what exceeds them is done in parts
HITS, CELLS = 4_000_000, 2_000_000
_BITS = 22
#: the character between texts, and what it costs to align it: more than any budget
_SEP, _NEVER = 1, 1 << 30
#: a key of item and diagonal is item * _SHIFT + diagonal + _ZERO
_SHIFT, _ZERO = np.int64(1) << 40, np.int64(1) << 24
_P = 0x9E3779B97F4A7C15
_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _TABLE:
        lowered = [c.lower() if c.isalnum() else " " for c in map(chr, range(0x10000))]
        _TABLE.append(np.array([ord(c) if len(c) == 1 else i for i, c in enumerate(lowered)], np.uint32))
    return _TABLE[0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalise(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of all parts, each part followed by _SEP; where each part ends."""
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    one = np.full(1, _SEP, np.uint32)
    raw = np.concatenate([x for p in parts for x in (p, one)])
    out = np.where(raw < 0x10000, _table()[np.minimum(raw, 0xFFFF)], raw)
    out[ends] = _SEP
    blank = out == 32
    keep = ~blank
    keep[1:] |= ~(blank[:-1] | (out[:-1] == _SEP))
    return out[keep], np.cumsum(keep)[ends] - 1


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each position on."""
    h = codes[: max(len(codes) - q + 1, 0)].astype(np.uint64)
    for i in range(1, q):
        h = h * np.uint64(_P) + codes[i : i + len(h)]
    return h


class Grams:
    """The q-grams of the items numbered `own`, for one q."""

    def __init__(self, codes: list[np.ndarray], own: list[int], q: int):
        self.q = q
        keys = np.concatenate([grams(codes[i], q) for i in own])
        sizes = [len(codes[i]) - q + 1 for i in own]
        order = np.argsort(keys, kind="stable")
        self.item = np.repeat(np.array(own), sizes)[order].astype(np.int32)
        self.place = np.concatenate([np.arange(n) for n in sizes])[order].astype(np.int32)
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << _BITS, bool)
        self.sieve[self._slot(self.keys)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)

    def met(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the q-gram) wherever the text has a q-gram of an item."""
        h = grams(codes, self.q)
        at = np.flatnonzero(self.sieve[self._slot(h)])
        g = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[g] == h[at]
        return at[same], g[same]

    def listed(self, at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal) of every shared q-gram of these positions."""
        n = self.count[g]
        entry = np.repeat(self.first[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.item[entry].astype(np.int64), np.repeat(at, n) - self.place[entry]

    def groups(self, g: np.ndarray) -> Iterator[np.ndarray]:
        """Items in groups that share at most HITS q-grams with the text, or alone if one shares more."""
        times = np.bincount(g, minlength=len(self.keys))
        hits = np.bincount(self.item, np.repeat(times, self.count))
        items = np.flatnonzero(hits)
        so_far, lo = np.cumsum(hits[items]), 0
        while lo < len(items):
            hi = max(lo + 1, int(np.searchsorted(so_far, (so_far[lo - 1] if lo else 0) + HITS, side="right")))
            yield items[lo:hi]
            lo = hi

    def only(self, items: np.ndarray) -> Grams:
        """The q-grams of some of the items; their numbers stay."""
        part = object.__new__(Grams)
        kept = np.isin(self.item, items)
        part.q, part.keys, part.item, part.place = self.q, self.keys, self.item[kept], self.place[kept]
        part.count = np.bincount(np.repeat(np.arange(len(self.keys)), self.count)[kept], minlength=len(self.keys))
        part.first = np.cumsum(part.count) - part.count
        return part

    def diagonals(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, diagonal, shared q-grams on it) in parts; an item is in one part. No part lists more than about HITS q-grams at once."""
        at, g = self.met(codes)
        if self.count[g].sum() <= HITS:
            yield self._summed(*self.listed(at, g))
            return
        for items in self.groups(g):
            part = self.only(items)
            here = part.count[g] > 0
            own_at, own_g = at[here], g[here]
            so_far = np.cumsum(part.count[own_g])
            if len(items) > 1 or so_far[-1] <= HITS:
                yield part._summed(*part.listed(own_at, own_g))
                continue
            low = int(own_at[0]) - int(part.place.max())
            sums = np.zeros(int(own_at[-1]) - low + 1, np.int64)
            lo = 0
            while lo < len(own_at):
                hi = max(lo + 1, int(np.searchsorted(so_far, (so_far[lo - 1] if lo else 0) + HITS, side="right")))
                diagonal = part.listed(own_at[lo:hi], own_g[lo:hi])[1] - low
                first = diagonal.min()
                counted = np.bincount(diagonal - first)
                sums[first : first + len(counted)] += counted
                lo = hi
            full = np.flatnonzero(sums)
            yield np.full(len(full), items[0], np.int64), full + low, sums[full]

    @staticmethod
    def _summed(item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n = np.unique(item * _SHIFT + diagonal + _ZERO, return_counts=True)
        return key // _SHIFT, key % _SHIFT - _ZERO, n


class Index:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.codes = [], []
        for item_id, text in items:
            codes, _ = normalise([_codes(text)])
            codes = codes[:-1]
            codes = codes[:-1] if len(codes) and codes[-1] == 32 else codes
            if len(codes):
                self.ids.append(item_id)
                self.codes.append(codes)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = self.length // PER_EDIT
        self.q = np.minimum(Q, self.length // (self.edits + 1))
        self.least = self.length + 1 - self.q * (self.edits + 1)
        self.parts = [Grams(self.codes, np.flatnonzero(self.q == q).tolist(), q) for q in sorted(set(self.q.tolist()))]

    def search(self, codes: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], int]:
        """Least edits by (text, item) for the regions of `codes` within an item's budget; `ends` is where each text ends."""
        best: dict[tuple[int, int], int] = {}

        def keep(item: np.ndarray, end: np.ndarray, edits: np.ndarray) -> None:
            own = np.unique(np.stack([np.searchsorted(ends, end - 1), item, edits]), axis=1)[:, ::-1]
            best.update({(d, k): min(x, best.get((d, k), x)) for d, k, x in own.T.tolist()})

        for part in self.parts:
            for item, diagonal, n in part.diagonals(codes):
                if len(item):
                    self._verified(codes, item, diagonal, n, keep)
        return best

    def _verified(self, codes: np.ndarray, item: np.ndarray, diagonal: np.ndarray, hits: np.ndarray, keep: Callable) -> None:
        """Keep the regions, of all diagonals of some items, whose bands have enough hits and that align within the budget."""
        whole = hits == (self.length - self.q + 1)[item]
        k = item[whole]
        exact = np.sort(k * _SHIFT + diagonal[whole] + _ZERO)
        keep(k, diagonal[whole] + self.length[k], np.zeros(len(k), np.int64))
        band = diagonal // (self.edits[item] + 1)
        bands, back = np.unique(np.concatenate([item * _SHIFT + band + _ZERO, item * _SHIFT + band - 1 + _ZERO]), return_inverse=True)
        n = np.bincount(back, np.concatenate([hits, hits]))
        i = bands // _SHIFT
        dense = n >= self.least[i]
        i, start = i[dense], (bands[dense] % _SHIFT - _ZERO) * (self.edits[i[dense]] + 1)
        # a band around an exact passage has nothing to add
        lo = np.searchsorted(exact, i * _SHIFT + start + _ZERO)
        hi = np.searchsorted(exact, i * _SHIFT + start + 2 * (self.edits[i] + 1) + _ZERO)
        i, start = i[lo == hi], start[lo == hi]
        for k in np.unique(i):
            own = start[i == k]
            step = max(1, CELLS // int(self.length[k] + 4 * self.edits[k] + 2))
            for at in range(0, len(own), step):
                edits, end = self.align(codes, int(k), own[at : at + step])
                near = edits <= self.edits[k]
                keep(np.full(near.sum(), k), end[near], edits[near])

    def align(self, codes: np.ndarray, k: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits that turn item k into a part of the text on the bands that begin at diagonals `starts`, and where it ends."""
        pattern, slack = self.codes[k], int(self.edits[k])
        width = 2 * (slack + 1) + 2 * slack
        at = starts[:, None] - slack + np.arange(width + len(pattern))[None, :]
        text = np.where((at >= 0) & (at < len(codes)), codes[np.clip(at, 0, len(codes) - 1)], _SEP)
        cost = np.where(text == _SEP, np.int64(_NEVER), np.int64(1))
        skipped = np.cumsum(cost, axis=1)
        row = np.zeros((len(starts), width), np.int64)
        for r, c in enumerate(pattern):
            here = slice(r, r + width)
            down = np.full_like(row, _NEVER)
            down[:, :-1] = row[:, 1:] + 1
            now = np.minimum(row + np.where(text[:, here] == c, 0, cost[:, here]), down)
            row = np.minimum.accumulate(now - skipped[:, here], axis=1) + skipped[:, here]
        best = row.argmin(axis=1)
        return row[np.arange(len(starts)), best], starts - slack + best + len(pattern)


def _finder(index):
    """A pandas UDF: array of (item_id, item_chars, edits) for each text."""

    @F.pandas_udf("array<struct<item_id:bigint,item_chars:bigint,edits:bigint>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = index.value
        for texts in batches:
            parts = [_codes(t) if t else np.empty(0, np.uint32) for t in texts]
            sizes, lo = np.cumsum([len(p) + 1 for p in parts]), 0
            found: list[list[dict]] = [[] for _ in parts]
            while lo < len(parts):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + AT_ONCE)))
                codes, ends = normalise(parts[lo:hi])
                for (d, k), edits in own.search(codes, ends).items():
                    found[lo + d].append({"item_id": own.ids[k], "item_chars": int(own.length[k]), "edits": edits})
                lo = hi
            yield pd.Series(found, dtype=object)

    return find


def _blocks(benchmark: DataFrame) -> Iterator[tuple[Column, bool]]:
    """For each block of the benchmark, what is found in `text` as a column, and whether it is the last block.

    A block is collected, indexed and broadcast when it is asked for, and dropped when the next one is: the driver never
    holds more than one, of about BLOCK_CHARS characters.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    blocks = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS + 1
    for b in range(blocks):
        block = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        index = spark.sparkContext.broadcast(Index(block))
        yield _finder(index)(F.col("text").cast("string")), b == blocks - 1
        index.unpersist()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_chars, edits, contaminated): a row for each document and each benchmark item that it holds, with the least edits.

    `docs` needs doc_id and text, `benchmark` item_id and text; other columns are not looked at. Null and empty texts hold
    nothing; null item ids and items without a letter or digit are not searched for. Items of under 10 normalised characters
    must occur as they are, within words too. Repeated documents give repeated rows, repeated items one; an item_id with
    several texts is found by any of them. Documents that hold no item have no row. Empty tables give an empty result.
    The benchmark is a stated query set: it is searched in blocks, one pass over the documents each.
    """
    out = None
    for found, last in _blocks(benchmark):
        own = docs.select(F.col("doc_id").cast("long"), F.inline(found))
        own = own if last and out is None else materialize(own, "leaks")
        out = own if out is None else out.unionByName(own)
    return out.withColumn("contaminated", F.lit(True))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text holds no benchmark item; decided row by row in the pass that reads them."""
    written = False
    for found, last in _blocks(benchmark):
        clean = docs.where(F.size(found) == 0)
        clean = clean if last else materialize(clean, "clean")
        if written and not last:
            discard(docs)
        docs, written = clean, True
    return docs
