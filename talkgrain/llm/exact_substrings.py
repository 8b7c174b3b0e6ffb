"""Removal of long repeated strings with a run-length index.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier (smaller doc_id, or same document, earlier).
Every window of LENGTH bytes has an anchor, its least K-gram by hash (the leftmost of equals), which depends on the window's
bytes alone; consecutive windows with one anchor form a piece, whose bytes are its context. Equal windows have equal anchors, so
pieces are sorted out by anchor:

1. Anchors that occur once are dropped.
2. Equal contexts of an anchor are one before they are shuffled any further: they have the same windows, so all pieces but
   the first are repeats as a whole, and the first stands for them.
3. The distinct contexts of an anchor are indexed together, with those of other anchors up to INDEX_BYTES: `RunIndex` is their
   run-compressed Burrows-Wheeler transform, and keeps for each run its start, where it is mapped to, and the sampled
   length of the match across its end. The contexts are streamed backwards through the index, run by run, which gives the
   rank of every suffix; its match length is the sampled one at a run's end and falls by one from each position to the
   next elsewhere. Windows of which all but one match LENGTH bytes or more are equal: the first of them stays.
4. An anchor whose distinct contexts exceed INDEX_BYTES is split, without loss, by longer anchors: a window holds either the
   bytes before the anchor or the bytes after it up to half of what it still lacks, so its piece falls into a part left
   and a part right, each with an anchor of its own; steps 2 and 3 are done for these, and again, until none is too large. An
   anchor of LENGTH bytes has one context, so this ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import discard, materialize

LENGTH, K = 100, 32
#: bytes of contexts in one index, at most
INDEX_BYTES = 500_000
#: parts of an anchor's contexts that are counted apart, so that a frequent anchor's are not gathered
SALTS = 16
#: rows or bytes of contexts that a task returns at once, about
AT_ONCE, AT_ONCE_BYTES = 200_000, 4_000_000
#: bits of the filter that spares shuffling texts without repeats, at most (16 MB)
FILTER_BITS = 1 << 27
_SEP = 0xFF  # in no UTF-8 text
#: h: hash of the anchor, c: of the context; at: first window << 8 | windows
_RUNS = "doc_id long, h long, c long, at long"
_PIECES = "doc_id long, h long, c long, at long, p int, ctx binary"


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _signed(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def _gram_hashes(data: bytes) -> np.ndarray:
    h, p, width = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while width < K:
        h = h[:-width] * np.uint64(p) + h[width:]
        p, width = p * p % 2**64, 2 * width
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchor_runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows) for each run of windows with one anchor."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none
    h = _gram_hashes(data)
    span = LENGTH - K + 1
    least, place, covered = h, np.arange(len(h), dtype=np.int32), 1
    while covered < span:  # least hash of `span` K-grams from each window's start on, and its leftmost place
        step = min(covered, span - covered)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.minimum(least[:-step], least[step:])
        covered += step
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return least[first].view(np.int64), first, np.diff(np.append(first, len(place)))


def anchor_place(context: bytes) -> int:
    """Where the anchor of a context begins."""
    return int(_gram_hashes(context[:LENGTH]).argmin())


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, count = [], 0

    def out():
        d, h, c, at = (np.concatenate(x) for x in zip(*held, strict=True))
        return pd.DataFrame({"doc_id": d, "h": h, "c": c, "at": at})

    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            data = _bytes(text)
            h, first, n = anchor_runs(data)
            if len(h):
                c = _signed([xxhash.xxh3_64_intdigest(data[s : s + m + LENGTH - 1]) for s, m in zip(first.tolist(), n.tolist(), strict=True)])
                held.append((np.full(len(h), doc_id, np.int64), h, c, first.astype(np.int64) << 8 | n))
                count += len(h)
            if count >= AT_ONCE:
                yield out()
                held, count = [], 0
    if held:
        yield out()


def _sized(rows: Iterator[tuple], size: int, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of `rows` with about AT_ONCE_BYTES in the column numbered `size`."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += len(r[size]) + 100
        if total >= AT_ONCE_BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, total = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the pieces listed with each text."""

    def rows():
        for pdf in batches:
            for doc_id, text, hs, ats in zip(pdf["doc_id"], pdf["text"], pdf["hs"], pdf["ats"], strict=True):
                data = _bytes(text)
                for h, at in zip(hs.tolist(), ats.tolist(), strict=True):
                    first, n, hot = at >> 9, at >> 1 & 0xFF, bool(at & 1)
                    ctx = data[first : first + n + LENGTH - 1]
                    yield doc_id, h, 0, first << 8 | n, anchor_place(ctx) if hot else 0, ctx, hot

    return _sized(rows(), 5, ["doc_id", "h", "c", "at", "p", "ctx", "hot"])


def halves(first: int, n: int, p: int, width: int) -> list[tuple[int, int, int, int]]:
    """(side, first window, windows, anchor) of the parts left and right of n windows that hold an anchor of `width` bytes at p.

    Windows and p are counted from the piece's first byte. The new anchors have width + ceil((LENGTH - width) / 2) bytes.
    """
    more = (LENGTH - width + 1) // 2
    turn = min(max(p - more + 1, 0), n)  # windows before it hold `more` bytes before the anchor, the others as many after it
    return [(side, first + lo, hi - lo, at - lo) for side, lo, hi, at in ((0, 0, turn, p - more), (1, turn, n, p)) if hi > lo]


def _split(width: int):
    """Pieces with anchors of `width` bytes to pieces with longer ones."""
    longer = width + (LENGTH - width + 1) // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for pdf in batches:
                for doc_id, at, p, ctx in zip(pdf["doc_id"], pdf["at"], pdf["p"], pdf["ctx"], strict=True):
                    whole, first = bytes(ctx), int(at) >> 8
                    for side, lo, n, anchor in halves(0, int(at) & 0xFF, int(p), width):
                        own = whole[lo : lo + n + LENGTH - 1]
                        h = xxhash.xxh3_64_intdigest(own[anchor : anchor + longer], seed=2 * width + side)
                        h, c = _signed([h, xxhash.xxh3_64_intdigest(own)]).tolist()
                        yield doc_id, h, c, (first + lo) << 8 | n, anchor, own

        return _sized(rows(), 5, ["doc_id", "h", "c", "at", "p", "ctx"])

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of contexts that each end with _SEP; a suffix ends there, and of equal ones the earlier is less."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    ends = np.flatnonzero(text == _SEP)
    left = (np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)).astype(np.int32)  # characters before the end
    key, width = np.zeros(n, np.uint64), 8
    for i in range(width):
        key = (key << np.uint64(8)) | np.where(left < i, 0, padded[i : i + n]).astype(np.uint64)
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], (ranked[1:] != ranked[:-1]).astype(np.int64)))).astype(np.uint64)
        if rank[order[-1]] == n - 1:
            return order.astype(np.int32)
        later = np.zeros(n, np.uint64)
        later[:-width] = rank[width:]
        key = (rank << np.uint64(32)) | np.where(left < width, np.arange(n, dtype=np.uint64), later)
        width *= 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, up to the first _SEP."""
    out, live = np.zeros(len(a), np.int32), np.arange(len(a))
    while len(live):
        x = text[a[live] + out[live]]
        live = live[(x == text[b[live] + out[live]]) & (x != _SEP)]
        out[live] += 1
    return out


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of contexts, with the match lengths sampled where its runs end.

    For the run numbered j: starts[j] is its first rank, maps[j] the rank of that suffix made longer by one character to the
    left, match[j] the prefix that the suffixes on either side of the end before it share. The order of all suffixes is
    needed to build it, and not kept.
    """

    def __init__(self, contexts: list[bytes]):
        sep = bytes([_SEP])
        text = np.frombuffer(sep.join(contexts) + sep, np.uint8)
        order = suffix_array(text)
        bwt = text[order - 1]
        # the ends of contexts are no character that is mapped on: each is a run of its own
        starts = np.flatnonzero(np.concatenate(([True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == _SEP))))
        sizes = np.diff(np.append(starts, len(bwt)))
        by_character = np.argsort(bwt[starts], kind="stable")
        maps = np.empty(len(starts), np.int64)
        maps[by_character] = np.cumsum(sizes[by_character]) - sizes[by_character]
        self.starts, self.maps, self.size = starts.astype(np.int32), maps.astype(np.int32), len(text)
        self.match = np.concatenate(([0], common_prefix(text, order[starts[1:]], order[starts[1:] - 1]))).astype(np.int32)

    def stream(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, match length) of each suffix of the contexts, which have these lengths, as arrays (context, position).

        All contexts are read backwards at once, a character a step. The match is the one with the suffix before in rank.
        """
        most, m = int(lengths.max()), len(lengths)
        rank = np.zeros((m, most), np.int32)
        match = np.full((m, most), -1, np.int32)
        now, live = (self.size - m + np.arange(m)).astype(np.int32), np.arange(m)
        for step in range(1, most + 2):
            run = np.searchsorted(self.starts, now[live], "right") - 1
            if step > 1:
                own = lengths[live] - step + 1
                rank[live, own] = now[live]
                match[live, own] = np.where(self.starts[run] == now[live], self.match[run], -1)
            more = lengths[live] >= step
            live, run = live[more], run[more]
            now[live] = self.maps[run] + now[live] - self.starts[run]
        place = np.arange(most, dtype=np.int32)
        return rank, np.maximum.accumulate(np.where(match >= 0, match + place, 0), axis=1) - place


def repeats(contexts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each of the distinct contexts, in the order of the corpus, the ranges of its windows that occur earlier in the list."""
    lengths = np.array([len(c) for c in contexts])
    rank, match = RunIndex(contexts).stream(lengths)
    place = np.arange(rank.shape[1])
    k, o = np.nonzero(place[None, :] <= (lengths - LENGTH)[:, None])  # the windows, in the order of the corpus
    rank, match = rank[k, o], match[k, o]
    heads = np.sort(rank[match < LENGTH])
    same = np.searchsorted(heads, rank, "right") - 1
    first = np.empty(len(heads), np.int64)
    first[same[::-1]] = np.arange(len(same))[::-1]  # of equal windows the first is written last
    again = np.arange(len(same)) > first[same]
    # ranges of consecutive repeated windows of one context
    follows = np.concatenate(([False], again[:-1] & (k[1:] == k[:-1])))
    leads = np.concatenate((again[1:] & (k[1:] == k[:-1]), [False]))
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for c, s, e in zip(k[again & ~follows].tolist(), o[again & ~follows].tolist(), o[again & ~leads].tolist(), strict=True):
        out[c].append((s, e + 1))
    return out


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of repeated windows; rows come sorted by anchor, doc_id and place, and the contexts of whole anchors are
    indexed together up to INDEX_BYTES. Equal windows have equal anchors, so it does not matter which."""

    def spans(rows: list[tuple]) -> pd.DataFrame:
        rows.sort()
        found = repeats([r[2] for r in rows])
        out = [(r[0], ((r[1] >> 8) + s) << 32 | (r[1] >> 8) + e - 1 + LENGTH) for r, own in zip(rows, found, strict=True) for s, e in own]
        return pd.DataFrame(out, columns=["doc_id", "span"], dtype="int64")

    held: list[tuple] = []
    group: list[tuple] = []
    anchor, size, own = None, 0, 0
    for pdf in batches:
        for doc_id, h, at, ctx in zip(pdf["doc_id"].tolist(), pdf["h"].tolist(), pdf["at"].tolist(), pdf["ctx"], strict=True):
            if h != anchor:
                if size + own > INDEX_BYTES and held:
                    yield spans(held)
                    held, size = [], 0
                held, size, group, own, anchor = held + group, size + own, [], 0, h
            group.append((doc_id, at, bytes(ctx)))
            own += len(ctx) + 1
    if size + own > INDEX_BYTES and held:
        yield spans(held)
        held = []
    if held or group:
        yield spans(held + group)


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    x = (ids.astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)


def _id_filter(ids: DataFrame):
    """A bitmap of at most FILTER_BITS bits in which every given doc_id is set; it may let others pass, never the reverse."""
    bits = int(min(FILTER_BITS, max(1 << 16, 1 << (16 * ids.count()).bit_length())))

    def mark(batches):
        own = np.zeros(bits // 64, np.int64)
        for pdf in batches:
            slot = _slots(pdf["doc_id"].to_numpy(), bits)
            np.bitwise_or.at(own, slot >> 6, np.int64(1) << (slot & 63))
        word = np.flatnonzero(own)
        yield pd.DataFrame({"word": word, "bit": own[word]})

    rows = ids.mapInPandas(mark, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(bitmap), bits


def _passing(docs: DataFrame, bitmap, bits: int, wanted: bool) -> DataFrame:
    def keep(batches):
        for pdf in batches:
            slot = _slots(pdf["doc_id"].fillna(0).to_numpy(np.int64), bits)
            hit = ((bitmap.value[slot >> 6] >> (slot & 63)) & 1).astype(bool) & pdf["doc_id"].notna().to_numpy()
            yield pdf[hit == wanted]

    return docs.mapInPandas(keep, "doc_id long, text string")


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
            data, at, kept, runs = _bytes(text), 0, [], 0
            if spans is not None:
                own = np.sort(spans)
                s, e = own >> 32, np.maximum.accumulate(own & 0xFFFFFFFF)
                new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                runs = len(new)
                for lo, hi in zip(s[new].tolist(), e[np.append(new[1:], len(s)) - 1].tolist(), strict=True):
                    kept.append(data[at:lo])
                    at = hi
            kept.append(data[at:])
            left = b"".join(kept)
            out.append((doc_id, len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": pdf["doc_id"].dtype})


def _span(first, windows):
    """A range of windows as one number: its first byte << 32 | the byte after its last."""
    return F.shiftleft(first, 32).bitwiseOR(first + windows - 1 + LENGTH)


def _firsts(pieces: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """The first piece of each anchor and context, and the spans of all others; a written table and one that reads `pieces`."""
    firsts = materialize(pieces.groupBy("h", "c").agg(F.min(F.struct("doc_id", "at", *more)).alias("f")).select("h", "c", "f.*"), "firsts")
    known = firsts.select("h", "c", F.col("doc_id").alias("d"), F.col("at").alias("a"))
    again = pieces.select("doc_id", "h", "c", "at").join(known, ["h", "c"]).where("doc_id <> d or at <> a")
    return firsts, again.select("doc_id", _span(F.shiftright("at", 8), F.col("at").bitwiseAND(0xFF)).alias("span"))


def _unsure(firsts: DataFrame) -> DataFrame:
    """`firsts` of anchors with several contexts, with `hot`: whether these exceed INDEX_BYTES. A frequent anchor's contexts
    are counted and joined by SALTS parts."""
    firsts = firsts.withColumn("salt", F.pmod("c", F.lit(SALTS)).cast("int"))
    parts = firsts.groupBy("h", "salt").agg(F.count("*").alias("m"), F.sum(F.col("at").bitwiseAND(0xFF) + LENGTH).alias("size"))
    whole = parts.groupBy("h").agg(F.sum("m").alias("m"), F.sum("size").alias("size")).where("m > 1").select("h", (F.col("size") > INDEX_BYTES).alias("hot"))
    return firsts.join(parts.select("h", "salt").join(whole, "h"), ["h", "salt"]).drop("salt")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes that stay.

    `docs` needs doc_id and text; other columns are not looked at. Null texts are empty; texts of under LENGTH bytes keep
    all. A null doc_id has no place in the order: it keeps all and repeats of it count for nothing. Rows that repeat a doc_id give one
    row; if their texts differ, the least text counts. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")).unionByName(docs.where("doc_id is null"))
    runs = materialize(docs.where("doc_id is not null and text is not null").mapInPandas(_anchors, _RUNS), "runs")
    often = materialize(runs.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "often")
    repeated = materialize(runs.join(often, "h", "left_semi"), "repeated")  # a join of two tables, so that a frequent anchor is dealt anew
    discard(runs)
    discard(often)
    firsts, again = _firsts(repeated)
    unsure = materialize(_unsure(firsts).select("doc_id", "h", F.shiftleft("at", 1).bitwiseOR(F.col("hot").cast("long")).alias("at")), "unsure")
    spans = [materialize(again, "spans")]
    discard(repeated)
    discard(firsts)

    bitmap, bits = _id_filter(unsure.select("doc_id"))
    listed = unsure.groupBy("doc_id").agg(F.collect_list(F.struct("h", "at")).alias("x")).select("doc_id", F.col("x.h").alias("hs"), F.col("x.at").alias("ats"))
    texts = _passing(docs, bitmap, bits, True).join(listed.hint("merge"), "doc_id")
    contexts = materialize(texts.mapInPandas(_contexts, _PIECES + ", hot boolean"), "contexts")
    discard(unsure)
    width = K
    while True:
        cold = contexts.where("not hot").select("doc_id", "h", "at", "ctx")
        spans.append(materialize(cold.repartition(F.col("h")).sortWithinPartitions("h", "doc_id", "at").mapInPandas(_indexed, "doc_id long, span long"), "spans"))
        hot = contexts.where("hot")
        if not hot.limit(1).count():
            break
        pieces = materialize(hot.mapInPandas(_split(width), _PIECES), "pieces")
        discard(contexts)
        width += (LENGTH - width + 1) // 2
        firsts, again = _firsts(pieces, "p", "ctx")
        spans.append(materialize(again, "spans"))
        contexts = materialize(_unsure(firsts).select("doc_id", "h", "c", "at", "p", "ctx", "hot"), "contexts")
        discard(pieces)
        discard(firsts)
    discard(contexts)

    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    found = materialize(found.groupBy("doc_id").agg(F.collect_list("span").alias("spans")), "by-document")
    for own in spans:
        discard(own)
    bitmap, bits = _id_filter(found.select("doc_id"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    touched = _passing(docs, bitmap, bits, True).join(found.hint("merge"), "doc_id", "left").mapInPandas(_cut, result)
    untouched = _passing(docs, bitmap, bits, False).withColumn("spans", F.expr("cast(null as array<bigint>)")).mapInPandas(_cut, result)
    return touched.unionByName(untouched)
