"""Repair of conversations by the cheapest edits that make their roles a system turn at most, then user and assistant in turn.

Rows are faulty in one way at most: blank, duplicate (role and text seen before in the conversation), or truncated. The
cheapest edits are a shortest path over rows and four states (start, after system, after user, after assistant), found by Viterbi from the end. Long
conversations are cut in chunks that run at once: each starts from a speculative cost vector, and fix-up passes run a chunk again with
the vector that the chunk after it really gave, until no vector differs from the one used by more than a constant. The stitched
vectors then drive the tracing of the least audit, in which a chunk's edits follow from the state in which it is entered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.common import discard, materialize
from talkgrain.operators.ranks import running

#: rows of a conversation in a chunk
CHUNK = 65_536
BLANKS = " \t\n\x0b\x0c\r"
#: states, and the state that a user or assistant turn of the repair's choice leads to
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: states that a kept row leads to, by its role's initial: 0 none of the others, 1 s, 2 u, 3 a
KEPT = {(START, 1): SYSTEM, (START, 2): USER, (SYSTEM, 2): USER, (USER, 3): ASSISTANT, (ASSISTANT, 2): USER}
DELETE, INSERT, REROLE, TRUNCATED, NEVER = 4, 3, 3, 3, 1 << 40
#: costs of the end of a conversation by state: the turns that are still to be inserted
END = (0, 2 * INSERT, INSERT, 0)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
Costs = tuple[int, int, int, int]


def _ways(kind: int, after: Costs, q: int) -> list[tuple[int, str, int]]:
    """(cost to the end, edit, next state) of a row in state q, in the order of the edits' initials."""
    initial, fault = kind % 4, kind // 4
    found = [(DELETE + after[q], "D", q)]
    if fault != 1:
        more = TRUNCATED if fault == 2 else 0
        if (to := KEPT.get((q, initial))) is not None:
            found.append((more + after[to], "K", to))
        found.append((more + REROLE + after[NEXT[q]], "R", NEXT[q]))
    return found


class Viterbi:
    """Backward costs and tracing, remembered by kind of row and by costs less their least, of which there are few."""

    def __init__(self):
        self.backs: dict[tuple[int, Costs], Costs] = {}
        self.steps: dict[tuple[int, Costs, int], tuple[str, int, int]] = {}

    def back(self, kind: int, after: Costs) -> Costs:
        """Costs before a row, less their least, from those after it."""
        if (kind, after) not in self.backs:
            row = [min(_ways(kind, after, q))[0] for q in range(4)]
            user, assistant = min(row[USER], INSERT + row[ASSISTANT]), min(row[ASSISTANT], INSERT + row[USER])
            costs = (min(row[START], INSERT + user), min(row[SYSTEM], INSERT + user), user, assistant)
            self.backs[kind, after] = tuple(c - min(costs) for c in costs)
        return self.backs[kind, after]

    def costs(self, codes: str, after: Costs) -> Costs:
        for kind in map(_KIND.__getitem__, reversed(codes)):
            after = self.back(kind, after)
        return after

    def step(self, kind: int, after: Costs, q: int) -> tuple[str, int, int]:
        """The least of the cheapest edits of a row in state q: their initials, what they cost, the state they lead to."""
        if (kind, after, q) not in self.steps:
            edits, cost, at = "", 0, q
            while True:
                own = _ways(kind, after, at)
                inserted = min(INSERT + min(_ways(kind, after, NEXT[at]))[0], 2 * INSERT + min(own)[0])
                best = min(min(own)[0], inserted)
                found = [("D", own[0][0], at), ("I", inserted, NEXT[at]), *((e, c, to) for c, e, to in own[1:])]
                edit, _, to = next(x for x in found if x[1] == best)
                edits += edit
                if edit == "I":
                    cost, at = cost + INSERT, to
                    continue
                cost += best - after[to]
                self.steps[kind, after, q] = (edits, cost, to)
                break
        return self.steps[kind, after, q]

    def trace(self, codes: str, after: Costs, q: int, last: bool) -> tuple[str, int, int]:
        """Edits of a chunk that is entered in state q, with what they cost and the state they lead to."""
        vectors = [after]
        for kind in map(_KIND.__getitem__, reversed(codes)):
            vectors.append(self.back(kind, vectors[-1]))
        vectors.pop()
        edits, cost = [], 0
        for kind in map(_KIND.__getitem__, codes):
            e, c, q = self.step(kind, vectors.pop(), q)
            edits.append(e)
            cost += c
        if last:
            edits.append("I" * (END[q] // INSERT))
            cost += END[q]
        return "".join(edits), cost, q


_CODES = "abcdefghijkl"
_KIND = {c: i for i, c in enumerate(_CODES)}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of the rows as the damage leaves them; conv is the id as text, empty for null."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), times.alias("_")).drop("_")


def _key() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, k, place, fault, initial) of damaged rows: fault 0 none, 1 blank, 2 duplicate, 3 truncated."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("s", 1, "u", 2, "a", 3))), F.left("role", F.lit(1))), F.lit(0))
    own = rows.select("conv", "turn", "role", _key().alias("k"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), initial.alias("initial"))
    placed = materialize(running(own, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("k")]), "placed")
    firsts = placed.groupBy("conv", "k").agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    return placed.join(firsts, ["conv", "place"], "left").select("conv", "turn", "role", "k", "place", fault.alias("fault"), "initial")


def _chunks(found: DataFrame, size: int) -> DataFrame:
    """(conv, chunk, codes, turn, role, k, last, illegal): a character for each row, and the first row's order."""
    kind = F.col("initial") + F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 8).otherwise(4)
    code = F.element_at(F.array(*map(F.lit, _CODES)), kind + 1)
    rows = found.select("conv", F.floor((F.col("place") - 1) / size).alias("chunk"), "place", code.alias("code"), "turn", "role", "k")
    own = rows.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("x"), F.min_by(F.struct("turn", "role", "k"), "place").alias("first"))
    w = Window.partitionBy("conv").orderBy("chunk")  # a row for `size` rows
    codes = own.select("conv", "chunk", F.array_join("x.code", "").alias("codes"), "first.*")
    return codes.withColumn("last", F.lead("chunk").over(w).isNull()).withColumn("prior", F.lag(F.right("codes", F.lit(1))).over(w))


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The costs before each chunk, from those after it."""
    viterbi = Viterbi()
    for pdf in batches:
        pdf["before"] = [list(viterbi.costs(codes, tuple(map(int, after)))) for codes, after in zip(pdf["codes"], pdf["after"], strict=True)]
        yield pdf


_CHUNK = "conv string, chunk long, codes string, turn long, role string, k string, last boolean, prior string, after array<long>"


def stitched(chunks: DataFrame) -> DataFrame:
    """`chunks` with the costs after each, less their least: speculative ones, mended until all fit those of the next chunk."""
    guess = F.when(F.col("last"), F.array(*map(F.lit, END))).otherwise(F.array(*[F.lit(0)] * 4)).cast("array<long>")
    now = materialize(chunks.withColumn("after", guess), "chunks")
    if not now.where("not last").limit(1).count():
        return now
    ran = materialize(now.mapInPandas(_run, f"{_CHUNK}, before array<long>"), "ran")
    discard(now)
    w = Window.partitionBy("conv").orderBy("chunk")
    while True:
        real = ran.withColumn("real", F.when(F.col("last"), F.col("after")).otherwise(F.lead("before").over(w)))
        wrong = real.where("real <> after")
        if not wrong.limit(1).count():
            return ran.drop("before")
        mended = wrong.drop("before").withColumn("after", F.col("real")).drop("real").mapInPandas(_run, f"{_CHUNK}, before array<long>")
        before, ran = ran, materialize(real.where("real = after").drop("real").unionByName(mended), "ran")
        discard(before)


def _illegal(codes: str, prior: str | None) -> int:
    """Neighbouring rows whose initials are not su, ua or au."""
    x = np.frombuffer(((prior or "") + codes).encode(), np.uint8) - ord("a")
    x = x % 4
    pair = x[:-1] * 4 + x[1:]
    return int((~np.isin(pair, [1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2])).sum())


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    viterbi = Viterbi()
    for pdf in batches:
        own = [[viterbi.trace(codes, tuple(map(int, after)), q, last)[2] for q in range(4)] for codes, after, last in zip(pdf["codes"], pdf["after"], pdf["last"], strict=True)]
        yield pdf[["conv", "chunk"]].assign(exits=own)


def _entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which each chunk is entered; the chunks of a conversation come one after another."""
    conv, q = None, START
    for pdf in batches:
        states = []
        for c, exits in zip(pdf["conv"], pdf["exits"], strict=True):
            conv, q = c, (q if c == conv else START)
            states.append(q)
            q = int(exits[q])
        yield pdf[["conv", "chunk"]].assign(entry=states)


def _traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    viterbi = Viterbi()
    for pdf in batches:
        found = [viterbi.trace(codes, tuple(map(int, after)), int(q), last)[:2] for codes, after, q, last in zip(pdf["codes"], pdf["after"], pdf["entry"], pdf["last"], strict=True)]
        illegal = [_illegal(codes, prior) for codes, prior in zip(pdf["codes"], pdf["prior"], strict=True)]
        yield pdf[["conv", "chunk", "turn", "role", "k"]].assign(audit=[e for e, _ in found], cost=[c for _, c in found], illegal=illegal)


def audits(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, turn, role, k, audit, cost, illegal) of stitched chunks: the least of the cheapest edits."""
    long = chunks.where("not last").select("conv").distinct()
    exits = chunks.join(long, "conv", "left_semi").select("conv", "chunk", "codes", "after", "last").mapInPandas(_exits, "conv string, chunk long, exits array<long>")
    entry = exits.repartition("conv").sortWithinPartitions("conv", "chunk").mapInPandas(_entered, "conv string, chunk long, entry long")
    known = chunks.join(entry, ["conv", "chunk"], "left").withColumn("entry", F.coalesce("entry", F.lit(START)))
    return known.mapInPandas(_traced, "conv string, chunk long, turn long, role string, k string, audit string, cost long, illegal long")


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of each repaired conversation: its edits and rows come in order, and only what is to be applied is held."""
    conv, state, q, edits, at, empty = None, hashlib.sha256(), START, "", 0, True

    def line(text: str) -> None:
        nonlocal empty
        state.update(text.encode("utf-8", "surrogatepass") if empty else b"\n" + text.encode("utf-8", "surrogatepass"))
        empty = False

    def insert() -> None:
        nonlocal at, q
        while at < len(edits) and edits[at] == "I":
            q, at = NEXT[q], at + 1
            line(f"{_ROLE[q]}:")

    for pdf in batches:
        done = []
        for c, role, text, audit in zip(pdf["conv"], pdf["role"], pdf["text"], pdf["audit"], strict=True):
            if c != conv:
                if conv is not None:
                    insert()
                    done.append((conv, state.hexdigest()))
                conv, state, q, edits, at, empty = c, hashlib.sha256(), START, "", 0, True
            if audit is not None:
                edits, at = edits[at:] + audit, 0
                continue
            insert()
            edit, at = edits[at], at + 1
            if edit == "K":
                q = KEPT[q, _INITIAL[role[:1]]]
                line(f"{role}:{text}")
            elif edit == "R":
                q = NEXT[q]
                line(f"{_ROLE[q]}:{text}")
        yield pd.DataFrame(done, columns=["conv", "repaired"])
    if conv is not None:
        insert()
        yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv", "repaired"])


_INITIAL = {"s": 1, "u": 2, "a": 3}


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `conversations` needs conv_id, turn, role and text; other columns are not looked at. Null roles and texts are one space
    (a null text is blank), a null conv_id is a conversation of its own; null turns come first, equal turns are ordered by role, then by the
    hash of role and text. A role without an initial s, u or a can't be kept. Repeated rows are duplicates. Long texts are hashed as they pass; the audit is one string a conversation.
    A conversation of which no row is left has zeros; an empty table gives an empty result.
    """
    rows = damaged(conversations)
    found = materialize(faults(rows), "faults")
    traced = materialize(audits(stitched(_chunks(found, chunk))), "audits")
    turn = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = found.groupBy("conv").agg(F.coalesce(turn, F.lit(0)).alias("gaps"), *(F.count_if(F.col("fault") == i).alias(name) for i, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))))
    whole = traced.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.sort_array(F.collect_list(F.struct("chunk", "audit")))["audit"], "").alias("audit"))
    lines = rows.select("conv", "turn", "role", _key().alias("k"), "text", F.lit(None).cast("string").alias("audit"))
    both = lines.unionByName(traced.select("conv", "turn", "role", "k", F.lit(None).cast("string").alias("text"), "audit"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "k", F.col("audit").isNull()]
    digests = both.repartition("conv").sortWithinPartitions(*order).select("conv", "role", "text", "audit").mapInPandas(_repaired, "conv string, repaired string")
    convs = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")).distinct()
    out = convs.join(counts, "conv", "left").join(whole, "conv", "left").join(digests, "conv", "left")
    return out.select(
        F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
