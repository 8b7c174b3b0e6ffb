"""Best-fit packing of tokenised documents by a linear grouping scheme.

Only the histogram of piece lengths, at most `size` rows whatever the corpus, reaches the driver. There the large lengths
are split into groups of equal cardinality and rounded up to the largest of their group; the few rounded sizes are packed
by column generation over cutting patterns (Gilmore and Gomory), rounded down; actual lengths take the places of the
rounded ones; everything left, small ones above all, goes by best fit into the gaps. The plan is run-length coded (so many
sequences with such contents), so its size too depends on the number of distinct lengths only. Spark then ranks the
pieces of each length and joins them to their places.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.common import materialize

SIZE, END = 1024, 2
#: lengths over this share of a sequence are grouped, in so many groups; the share that needs the fewest sequences is taken
SHARES, GROUPS = (0.5, 0.45, 0.34), 64
#: pieces of one length that one task ranks, about
RANKED = 500_000
SPECIAL = "<|endoftext|>"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of the vocabulary in `json_path`; texts without special tokens go through the same ranks in tiktoken, which is several times faster."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.slow = json_path, None

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            from tokenizers import Tokenizer

            self.slow = self.slow or Tokenizer.from_file(self.json_path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def cut(length: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of `size` tokens but the first, which may be shorter."""
    first = length % size or size
    return [(0, first)] + [(s, size) for s in range(first, length, size)]


def _pieces(paths: tuple[str, str, str], size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(*paths)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.append(encode(text or ""), END).astype("<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), size))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": pdf["doc_id"].dtype})

    return run


def _patterns(sizes: list[int], demand: list[int], size: int) -> list[tuple[np.ndarray, float]]:
    """Cutting patterns and how often each is used, from the linear relaxation by column generation."""
    k = len(sizes)
    columns = np.diag([size // s for s in sizes]).astype(float)
    inverse, b = np.linalg.inv(columns), np.array(demand, float)
    x, w = inverse @ b, np.array(sizes)
    for _ in range(30 * k):
        dual = inverse.sum(axis=0)
        best, pick = np.zeros(size + 1), np.full(size + 1, -1)
        for c in range(1, size + 1):
            fits = np.searchsorted(-w, -c)  # sizes fall
            best[c] = best[c - 1]
            if fits < k:
                value = best[c - w[fits:]] + dual[fits:]
                j = int(value.argmax())
                if value[j] > best[c] + 1e-12:
                    best[c], pick[c] = value[j], fits + j
        if best[size] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), size
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= int(w[pick[c]])
        turn = inverse @ column
        ratio = np.where(turn > 1e-9, x / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * turn
        x[out], columns[:, out] = step, column
        row = inverse[out] / turn[out]
        inverse = inverse - np.outer(turn, row)
        inverse[out] = row
    return [(columns[:, j].astype(int), float(max(x[j], 0))) for j in range(k)]


def plan(histogram: dict[int, int], size: int = SIZE, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """(contents, count): so many sequences hold pieces of just these lengths, in this order."""
    return min((_plan(histogram, size, groups, share) for share in SHARES), key=lambda p: sum(c for _, c in p))


def _plan(histogram: dict[int, int], size: int, groups: int, share: float) -> list[tuple[tuple[int, ...], int]]:
    left = {n: c for n, c in histogram.items() if c > 0}
    done: list[tuple[tuple[int, ...], int]] = []
    large = sorted((n for n in left if n > share * size), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        quota, runs, at = -(-total // groups), [[]], 0
        for n in large:  # equal-cardinality groups; a length may lie in two
            c = left[n]
            while c:
                take = min(c, quota - at)
                runs[-1].append([n, take])
                c, at = c - take, at + take
                if at == quota:
                    runs.append([])
                    at = 0
        runs = [r for r in runs if r]
        merged: list[list] = []
        for r in runs:  # groups that round to one size are one
            if merged and merged[-1][0][0] == r[0][0]:
                merged[-1] += r
            else:
                merged.append(r)
        for pattern, times in _patterns([r[0][0] for r in merged], [sum(c for _, c in r) for r in merged], size):
            slots = [g for g in range(len(merged)) for _ in range(pattern[g])]
            need = {g: slots.count(g) for g in set(slots)}
            count = min([int(times + 1e-9), *(sum(c for _, c in merged[g]) // m for g, m in need.items())]) if slots else 0
            taken = []
            for g in slots:  # actual lengths replace the rounded ones
                todo, own = count, []
                while todo:
                    n, c = merged[g][0]
                    m = min(c, todo)
                    own.append((n, m))
                    todo -= m
                    if m == c:
                        merged[g].pop(0)
                    else:
                        merged[g][0][1] -= m
                taken.append(own)
            while count:
                m = min(own[0][1] for own in taken)
                done.append((tuple(own[0][0] for own in taken), m))
                taken = [own[1:] if own[0][1] == m else [(own[0][0], own[0][1] - m), *own[1:]] for own in taken]
                count -= m
        for n in large:
            left[n] = 0
        for r in merged:
            for n, c in r:
                left[n] += c
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for contents, count in done:
        gaps[size - sum(contents)].append((contents, count))
    for n in sorted(left, reverse=True):  # best fit, the largest first
        c = left[n]
        while c:
            room = next((r for r in range(n, size) if gaps.get(r)), size)
            contents, have = gaps[room].pop() if room < size else ((), c)
            each = room // n
            m = min(have, c // each)
            if m:
                gaps[room - each * n].append((contents + (n,) * each, m))
                c -= m * each
                have -= m
            if c and have and c < each:
                gaps[room - c * n].append((contents + (n,) * c, 1))
                c, have = 0, have - 1
            if have and room < size:
                gaps[room].append((contents, have))
    return [x for r in sorted(gaps) for x in gaps[r]]


def pack(docs: DataFrame, paths: tuple[str, str, str] | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `docs` needs doc_id and text; other columns are not looked at. A null or empty text is the end token alone. A null
    doc_id is packed like any other. Repeated rows are packed as often as they occur. An empty table gives an empty
    result. `paths`: the vocabulary for tokenizers, the same as ranks, the split pattern; by default byte_bpe_50k.
    """
    if paths is None:
        import public_tokenizers

        paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = materialize(docs.mapInPandas(_pieces(paths, size), _PIECES), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, used, base = [], defaultdict(int), 0
    for contents, count in [((size,), histogram.pop(size, 0)), *plan(histogram, size)]:
        at = 0
        for n in contents:
            places.append((n, used[n], used[n] + count, base - used[n], at))
            used[n] += count
            at += n
        base += count
    places = spark.createDataFrame(places, "length long, lo long, hi long, shift long, offset long")

    salts = max(16, sum(used.values()) // RANKED)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    within = Window.partitionBy("length", "salt").orderBy(*order)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = salted.withColumn("own", F.row_number().over(within) - 1).join(shifts, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("first"))
    # the places are bounded by the number of distinct lengths, not by the corpus
    placed = ranked.join(F.broadcast(places), "length").where("rank >= lo and rank < hi")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")
