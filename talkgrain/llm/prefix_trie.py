"""Prefix trie of conversations, by z-fast tries in tasks that are merged by the nodes' fingerprints.

A conversation is its sequence of turns; a prefix is known by 128 bits, the exclusive or of hashes of (turn, depth). A task
keeps a compacted trie of the conversations it has read: a node that branches or ends one stands for the edge above it, and
is found in a hash table by its handle, the prefix whose depth is the two-fattest number on the edge. A conversation's exit
node is located by fat binary search, in as many look-ups as its length has bits, and inserted there. Batch by batch the
edges are expanded to nodes with their members and least member, and added up over all tasks.

A node's owner is its least member. What a conversation owns is the end of its path, below its exit depth from the trie of
all smaller ones, so sums over a subtree are sums along the owner's path plus the whole sums of all its other members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.common import materialize
from talkgrain.operators.ranks import running


class Sizes(NamedTuple):
    """What is handled together; results do not depend on it."""

    #: turns of a conversation in one row; longer ones go on in further rows, each a trie below the prefix before it
    segment: int = 256
    #: segments whose prefixes are added up in one task
    segments: int = 4096
    #: turns that a task's tries hold before their edges are expanded and passed on, and nodes that are passed on together
    held: int = 500_000
    at_once: int = 20_000
    #: ids of conversations that end at the same node are joined to strings by ranges of so many
    ends: int = 4096


_NODE = "a long, b long, depth long, up_a long, up_b long, n long, conv long, points long"


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the largest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Trie:
    """Compacted trie of sequences, given by the prefix hashes `a` at depths start..start + length.

    A node is [top, extent, row, ends, least, parent]: its edge covers depths (top, extent] of the sequence `row`.
    """

    def __init__(self, start: int):
        self.start = start
        self.rows: list[np.ndarray] = []
        self.nodes: list[list] = []
        self.handles: dict[tuple[int, int], int] = {}
        self.firsts: dict[tuple[int, int], int] = {}

    def hash(self, row: int, depth: int) -> int:
        return int(self.rows[row][depth - self.start])

    def _place(self, k: int, top: int) -> None:
        """Node k's edge begins below `top` from now on."""
        node = self.nodes[k]
        node[0] = top
        f = fattest(top, node[1])
        self.handles[f, self.hash(node[2], f)] = k
        self.firsts[top + 1, self.hash(node[2], top + 1)] = k

    def _new(self, top: int, extent: int, row: int, ends: int, least: int, parent: int) -> int:
        self.nodes.append([top, extent, row, ends, least, parent])
        return len(self.nodes) - 1

    def locate(self, row: int, end: int) -> tuple[int, int]:
        """Exit node of a sequence that ends at depth `end`, and the depth up to which it shares that node's path."""
        node, low, high = 0, self.start, end
        while low < high:
            f = fattest(low, high)
            k = self.handles.get((f, self.hash(row, f)))
            if k is None:
                high = f - 1
                continue
            extent, other = self.nodes[k][1], self.nodes[k][2]
            if extent > end or self.hash(other, extent) != self.hash(row, extent):
                return k, self._shared(row, other, f, min(extent, end))
            node, low = k, extent
        extent = self.nodes[node][1]
        if extent < end:
            k = self.firsts.get((extent + 1, self.hash(row, extent + 1)))
            if k is not None:  # it leaves the edge above the handle
                return k, self._shared(row, self.nodes[k][2], extent + 1, min(self.nodes[k][1], end))
        return node, extent

    def _shared(self, x: int, y: int, low: int, high: int) -> int:
        """The largest depth from low to high at which both prefixes are the same; they are at low."""
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.hash(x, mid) == self.hash(y, mid) else (low, mid - 1)
        return low

    def insert(self, hashes: np.ndarray, conv: int) -> None:
        """Add a sequence of which `hashes` has the prefix hashes from depth `start` on."""
        row, end = len(self.rows), self.start + len(hashes) - 1
        self.rows.append(hashes)
        if not self.nodes:
            self._new(self.start, self.start, row, 0, conv, -1)
        k, depth = self.locate(row, end)
        node = self.nodes[k]
        if depth < node[1]:  # split the edge
            upper = self._new(node[0], depth, node[2], 0, node[4], node[5])
            old = fattest(node[0], node[1])
            del self.handles[old, self.hash(node[2], old)]
            self._place(upper, node[0])
            node[5] = upper
            self._place(k, depth)
            k = upper
        if depth < end:
            k = self._new(depth, end, row, 0, conv, k)
            self._place(k, depth)
        self.nodes[k][3] += 1
        self.nodes[k][4] = min(self.nodes[k][4], conv)

    def totals(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(top, extent, row, members, least member) of every node."""
        order = sorted(range(len(self.nodes)), key=lambda k: -self.nodes[k][1])
        n = [node[3] for node in self.nodes]
        least = [node[4] for node in self.nodes]
        for k in order:
            up = self.nodes[k][5]
            if up >= 0:
                n[up] += n[k]
                least[up] = min(least[up], least[k])
        return ((*node[:3], n[k], least[k]) for k, node in enumerate(self.nodes))


def _expand(tries: dict, own: dict, at_once: int) -> Iterator[pd.DataFrame]:
    """The nodes on the edges of all tries."""
    parts, held = [], 0
    for (start, _, _), trie in tries.items():
        rows = own[id(trie)]
        for top, extent, row, n, least in trie.totals():
            if top == extent and start:
                continue  # the prefix before this row is a node of the row before
            at = np.arange(top + 1, extent + 1) if top < extent else np.zeros(1, np.int64)
            a, b, points = rows[row]
            i, up = at - start, np.maximum(at - start - 1, 0)
            parts.append((a[i], b[i], at, a[up], b[up], np.full(len(at), n), np.full(len(at), least), points[i]))
            held += len(at)
            if held > at_once:
                yield _table(parts)
                parts, held = [], 0
    if parts:
        yield _table(parts)


def _table(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("a", "b", "depth", "up_a", "up_b", "n", "conv", "points"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def _tries(sizes: Sizes) -> Callable:
    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries: dict = {}
        own: dict = {}
        held = 0
        for pdf in batches:
            for conv, segment, a0, b0, turns_a, turns_b, points in zip(pdf["conv"], pdf["segment"], pdf["a0"], pdf["b0"], pdf["ta"], pdf["tb"], pdf["points"], strict=True):
                a, b = _prefix_hashes(a0, turns_a), _prefix_hashes(b0, turns_b)
                start = int(segment) * sizes.segment
                trie = tries.get((start, a0, b0)) or tries.setdefault((start, a0, b0), Trie(start))
                trie.insert(a, int(conv))
                own.setdefault(id(trie), []).append((a, b, np.concatenate([[0], points]).astype(np.int64)))
                held += len(a)
            if held > sizes.held:
                yield from _expand(tries, own, sizes.at_once)
                tries, own, held = {}, {}, 0
        yield from _expand(tries, own, sizes.at_once)

    return grow


def _prefix_hashes(before: int, turns: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.accumulate(np.concatenate([[before], turns]).astype(np.int64))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, depth, k, points, size): the turns of the rebuilt conversations, with a hash of role and text, at depth 0 where none is left.

    The first h turns, h being crc32 of the id as text modulo 6, are those of the conversation id - id % 100.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("k"), F.length(text).cast("long").alias("points"),
    )
    turns = running(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("k")], place="place").drop("role", "turn")
    turns = materialize(turns, "turns")
    convs = turns.groupBy("conv").agg(F.count("*").alias("own")).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 6)
    heads = turns.where("conv % 100 = 0 and place <= 5").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "k", "points"))).alias("head"))
    none = F.expr("cast(array() as array<struct<place:bigint,k:string,points:bigint>>)")
    heads = convs.withColumn("base", F.col("conv") - F.col("conv") % 100).join(heads.withColumnRenamed("conv", "base"), "base", "left")
    heads = heads.select("conv", "h", "own", F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int")).alias("head")).withColumn("n_head", F.size("head").cast("long")).withColumn("size", F.col("n_head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    first = heads.select("conv", "size", F.explode("head").alias("x")).select("conv", F.col("x.place").alias("depth"), "x.k", "x.points", "size")
    rest = turns.join(heads.select("conv", "h", "n_head", "size"), "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("n_head")).alias("depth"), "k", "points", "size")
    bare = heads.where("size = 0").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("k"), F.lit(0).cast("long").alias("points"), "size")
    return first.unionByName(rest).unionByName(bare)


def _segments(turns: DataFrame, sizes: Sizes) -> DataFrame:
    """(conv, segment, a0, b0, ta, tb, points, last): turn hashes of each part of a conversation, and those of the prefix before it."""
    hashed = turns.withColumns({"ta": F.xxhash64(F.lit(1), "k", "depth"), "tb": F.xxhash64(F.lit(2), "depth", "k"), "segment": F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / sizes.segment)})
    real = F.col("depth") > 0
    own = F.sort_array(F.collect_list(F.when(real, F.struct("depth", "ta", "tb", "points"))))
    zero = F.lit(0).cast("long")
    lanes = {f"x{x}": F.coalesce(F.bit_xor(F.when(real, F.col(f"t{x}"))), zero) for x in "ab"}
    found = hashed.groupBy("conv", "segment").agg(own.alias("t"), F.max("size").alias("size"), *(v.alias(k) for k, v in lanes.items()))
    found = found.withColumn("block", F.floor(F.col("segment") / sizes.segments))
    within = Window.partitionBy("conv", "block").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("conv", "block").agg(F.bit_xor("xa").alias("ya"), F.bit_xor("xb").alias("yb"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each segments * segment turns
    blocks = blocks.select("conv", "block", F.bit_xor("ya").over(before).alias("ya"), F.bit_xor("yb").over(before).alias("yb")).where("block > 0")
    prior = {f"{x}0": F.coalesce(F.bit_xor(f"x{x}").over(within), zero) for x in "ab"}
    found = found.withColumns(prior).join(blocks, ["conv", "block"], "left").withColumns({f"{x}0": F.col(f"{x}0").bitwiseXOR(F.coalesce(f"y{x}", zero)) for x in "ab"})
    last = F.col("segment") == F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / sizes.segment)
    return found.select("conv", "segment", "a0", "b0", F.col("t.ta").alias("ta"), F.col("t.tb").alias("tb"), F.col("t.points").alias("points"), last.alias("last"), "xa", "xb")


def _ends(segments: DataFrame, size: int) -> DataFrame:
    """(a, b, ends): lowercase SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas."""
    at = lambda lane: F.col(f"{lane}0").bitwiseXOR(F.col(f"x{lane}")).alias(lane)
    ended = segments.where("last").select("conv", at("a"), at("b"))
    parts = ended.groupBy("a", "b", F.floor(F.col("conv") / size).alias("range")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    counted = parts.groupBy("a", "b").agg(F.count("*").alias("parts"), F.min("ids").alias("ids"))
    single = counted.where("parts = 1").select("a", "b", F.sha2("ids", 256).alias("ends"))
    many = parts.join(counted.where("parts > 1").select("a", "b"), ["a", "b"], "left_semi").repartition("a", "b").sortWithinPartitions("a", "b", "range")
    return single.unionByName(many.mapInPandas(_digests, "a long, b long, ends string"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of the parts of each node, which come one after another; only the digest's state is held."""
    import hashlib

    key, state = None, None
    for pdf in batches:
        done = []
        for a, b, ids in zip(pdf["a"], pdf["b"], pdf["ids"], strict=True):
            if key != (a, b):
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["a", "b", "ends"])
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["a", "b", "ends"])


def prefix_trie(conversations: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations.

    `conversations` needs conv_id, turn, role and text; other columns are not looked at. Rows without a conv_id are left out;
    null roles and texts are empty ones, turns are ordered null first and equal turns by role and then by the hash of role and text;
    repeated rows are turns of their own. Long texts count only by their hash and length. An empty table gives an empty result, without a root.

    Columns: conv_id, the smallest member; depth; parent_conv_id, that of the parent (null for the root); n_convs, members; n_children;
    n_leaves, childless nodes in the subtree; saved_tokens, over the subtree (members - 1) times the code points of a node's
    last text; ends_sha256, of the members that end there.
    """
    segments = materialize(_segments(rebuilt(conversations), sizes), "segments")
    found = segments.select("conv", "segment", "a0", "b0", "ta", "tb", "points").mapInPandas(_tries(sizes), _NODE)
    nodes = found.groupBy("a", "b").agg(*(F.min(c).alias(c) for c in ("depth", "up_a", "up_b", "conv", "points")), F.sum("n").alias("n"))
    nodes = materialize(nodes.withColumn("saved", (F.col("n") - 1) * F.col("points")), "nodes")
    own = nodes.groupBy("conv").agg(
        F.min("depth").alias("first"), F.min_by(F.struct("up_a", "up_b"), "depth").alias("up"), F.max_by(F.struct("a", "b"), "depth").alias("end"), F.sum("saved").alias("w_saved"),
    )
    own = own.select("conv", "first", "up.*", F.col("end.a").alias("end_a"), F.col("end.b").alias("end_b"), "w_saved")
    kids = own.where("first > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("kids"))
    leaf = own.join(kids.select(F.col("a").alias("end_a"), F.col("b").alias("end_b"), "kids"), ["end_a", "end_b"], "left")
    own = materialize(leaf.withColumn("w_leaves", F.when(F.col("kids").isNull(), 1).otherwise(0)).drop("kids"), "owners")
    # what members that do not own a node add to it, below their exit depth
    shared = segments.join(own.where("first > 0 and (w_saved > 0 or w_leaves > 0)").select("conv", "first", "w_saved", "w_leaves"), "conv").where(F.col("segment") * sizes.segment < F.col("first"))
    prefixes = shared.select("segment", "a0", "b0", "ta", "tb", "first", "w_saved", "w_leaves").mapInPandas(_prefixes(sizes.segment), "a long, b long, w_saved long, w_leaves long")
    more = prefixes.groupBy("a", "b").agg(F.sum("w_saved").alias("more_saved"), F.sum("w_leaves").alias("more_leaves"))
    above = own.where("first > 0").select("conv", F.col("up_a").alias("a"), F.col("up_b").alias("b")).join(nodes.select("a", "b", F.col("conv").alias("above")), ["a", "b"]).select("conv", "above")
    paths = own.select("conv", "first", F.col("end_a"), F.col("end_b"), "w_saved", "w_leaves").join(above, "conv", "left")
    line = running(nodes.select("a", "b", "depth", "conv", "n", "saved"), ["conv"], [F.col("depth")], {"so_far": "saved"}).drop("place")
    line = line.join(paths, "conv").join(kids, ["a", "b"], "left").join(more, ["a", "b"], "left").join(_ends(segments, sizes.ends), ["a", "b"], "left")
    zero = F.lit(0).cast("long")
    on = F.when((F.col("a") == F.col("end_a")) & (F.col("b") == F.col("end_b")), 0).otherwise(1)
    return line.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("first"), F.col("above")).otherwise(F.col("conv")).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (F.coalesce("kids", zero) + on).cast("long").alias("n_children"),
        (F.col("w_leaves") + F.coalesce("more_leaves", zero)).cast("long").alias("n_leaves"),
        (F.col("w_saved") - F.col("so_far") + F.col("saved") + F.coalesce("more_saved", zero)).cast("long").alias("saved_tokens"),
        F.coalesce("ends", F.lit("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")).alias("ends_sha256"),
    )


def _prefixes(size: int) -> Callable:
    """The prefixes above each conversation's first own node with its sums, added up by batch."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[tuple[int, int], list[int]] = {}
            for segment, a0, b0, ta, tb, first, saved, leaves in zip(*(pdf[c] for c in pdf.columns), strict=True):
                start = int(segment) * size
                most = min(int(first) - start, len(ta) + 1)  # depths start..first - 1; the prefix before a later row is the row before's
                a, b = _prefix_hashes(a0, ta[: most - 1]), _prefix_hashes(b0, tb[: most - 1])
                for key in zip(a[bool(start) :].tolist(), b[bool(start) :].tolist(), strict=True):
                    s = sums.setdefault(key, [0, 0])
                    s[0] += saved
                    s[1] += leaves
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["a", "b", "w_saved", "w_leaves"])

    return added
