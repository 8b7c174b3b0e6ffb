"""The prefix trie against a trie of plain prefixes, its searches against linear ones."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.llm import prefix_trie
from talkgrain.llm.prefix_trie import Trie, fattest

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    tie = lambda x: (*x[:3], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest())
    turns = {c: [(r, t) for _, _, r, t in sorted(v, key=tie)] for c, v in own.items()}
    built = {c: turns.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:] for c, v in turns.items()}
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed):
    r = random.Random(seed)
    texts = [None, "", "a", "b", "é😀", "long " * 50]
    rows = []
    for c in r.sample(range(420), 130) + [100, 200]:
        for t in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, None if r.random() < 0.1 else t, r.choice(["user", "assistant", None]), r.choice(texts)))
    rows += [(c, t, "user", "hot") for c in range(300, 360) for t in range(4)]
    return [*rows, (None, 0, "user", "no conversation"), *rows[:3]]


@pytest.mark.parametrize("sizes", [prefix_trie.Sizes(), prefix_trie.Sizes(2, 2, 20, 3, 7)])
def test_trie_equals_plain_prefixes(spark, sizes):
    rows = conversations(sizes.segment)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("a", "b", "k", "depth", "n", "conv", "place", "size")})
    assert found(prefix_trie.prefix_trie(df, sizes)) == plain(rows)


def test_one_long_conversation_and_an_empty_table(spark):
    rows = [(7, t, "user", str(t % 3)) for t in range(700)] + [(8, t, "user", str(t % 3)) for t in range(300)] + [(0, 0, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.prefix_trie(df)) == plain(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []


def test_exit_nodes():
    """Fat binary search finds the longest shared prefix, in about as many look-ups as the length has bits."""
    r = random.Random(3)
    assert [fattest(0, 5), fattest(4, 7), fattest(5, 6), fattest(0, 8), fattest(8, 13)] == [4, 6, 6, 8, 12]
    for _ in range(60):
        trie, seen = Trie(0), []
        for conv in range(40):
            x = [r.randrange(2) for _ in range(r.randrange(60))]
            base = r.choice(seen)[: r.randrange(60)] if seen and r.random() < 0.8 else []
            x = base + x
            hashes = np.array([hash(tuple(x[:d])) for d in range(len(x) + 1)])
            if seen:
                trie.rows.append(hashes)
                want = max(next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))) for y in seen)
                assert trie.locate(len(trie.rows) - 1, len(x))[1] == want
                trie.rows.pop()
            trie.insert(hashes, conv)
            seen.append(x)
        for _, _, row, n, least in trie.totals():
            assert n >= 1 and least <= row
