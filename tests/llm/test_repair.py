"""Conversation repair against a search over all cheapest edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from talkgrain.llm.repair import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = {}
    for c, turn, role, text in rows:
        own = out.setdefault(c, [])
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def plain(conversations):
    result = []
    for c, rows in conversations.items():
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
        rows = sorted(rows, key=key)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, kinds = set(), []
        for _, role, text in rows:
            last = BLANK.findall(text)[-1:]
            kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]

        @cache
        def best(i, roles, inserted, rows=rows, kinds=kinds):
            """Least (cost, audit) from row i on; `roles` is start, s, u or a."""
            ways = []
            to = "a" if roles == "u" else "u"
            if inserted < 2:
                cost, audit = best(i, to, inserted + 1)
                ways.append((cost + 3, "I" + audit))
            if i == len(rows):
                return min([*ways, (0, "")] if roles in ("", "a") else ways, default=(10**9, ""))
            cost, audit = best(i + 1, roles, 0)
            ways.append((cost + 4, "D" + audit))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 if kinds[i] == "truncated" else 0
                own = rows[i][1][:1]
                if own == to or (own == "s" and roles == ""):
                    cost, audit = best(i + 1, own, 0)
                    ways.append((cost + more, "K" + audit))
                cost, audit = best(i + 1, to, 0)
                ways.append((cost + more + 3, "R" + audit))
            return min(ways)

        cost, audit = best(0, "", 0)
        lines, i, state = [], 0, ""
        for e in audit:
            to = "a" if state == "u" else "u"
            name = "user" if to == "u" else "assistant"
            if e == "I":
                lines.append(f"{name}:")
                state = to
                continue
            if e == "K":
                lines.append(f"{rows[i][1]}:{rows[i][2]}")
                state = rows[i][1][:1]
            elif e == "R":
                lines.append(f"{name}:{rows[i][2]}")
                state = to
            i += 1
        counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        result.append((-1 if c is None else c, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result)


def found(df):
    return sorted((-1 if r.conv_id is None else r.conv_id, *list(r)[1:]) for r in df.collect())


def conversations(seed, n=150):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        length = r.choice([1, 1, 2, 4, 6, 9])
        for t in range(length):
            role = ("user" if t % 2 == 0 else "assistant") if r.random() < 0.7 else r.choice(["system", "user", "assistant", "tool", None, ""])
            text = r.choice(["Well.", "Yes!", "no end", " \n", "", None, "Wait?\n\x0b ", "é😀", f"text {t}.", f"{c} {t}"])
            rows.append((c, None if r.random() < 0.1 else t + r.choice([0, 0, 0, 1]), role, text))
    return rows


@pytest.mark.parametrize("chunk", [2, 65_536])
def test_repair_equals_search(spark, chunk):
    rows = conversations(chunk)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("conv", "chunk", "k", "place", "fault", "audit", "last", "how")})
    assert found(repair(df, chunk)) == plain(damage(rows))


def test_long_conversations_in_chunks(spark):
    """Rows that keep information alive over many chunks: deleted ones, and roles that fit either turn."""
    r = random.Random(8)
    rows = [(1, t, "tool", f"{t}.") for t in range(101)] + [(2, t, "user", "same.") for t in range(90)] + [(3, t, "user", "") for t in range(70)]
    rows += [(4, t, r.choice(["user", "assistant", "tool"]), r.choice([f"{t}", f"{t}.", "", "again."])) for t in range(150)] + [(5, None, "user", f"{t}!") for t in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(repair(df, 7)) == plain(damage(rows))
    assert repair(df.limit(0)).collect() == []
