"""Live transcripts by event time: partial hypotheses in, confirmed segments out, with timers for cycles and silence.

Hypotheses may come out of order within the watermark: they wait in state until it has passed them, and are then taken in time order,
so neither batches nor arrival order change the result. Later ones are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkgrain.streaming import live
from talkgrain.streaming.live import commits, is_repeat

#: fixed values: a recogniser is restarted after so many milliseconds; segments and words that it is given as context
CYCLE_MS, TAIL, CONTEXT = 55_000, 3, 100
#: silence after which what is open is confirmed, as at a pause
IDLE_MS = 600_000
#: time without a hypothesis after which a session is forgotten; one that is heard again begins anew
FORGET_MS = 24 * 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "session long, seq long, cycle long, at timestamp, text string, context string"
_NEVER = 1 << 62


class Line(NamedTuple):
    """Where a session stands; times in milliseconds, -1 for none. `tail` is the last confirmed segments, one a line; `seen` outlives silence."""

    partial: str = ""
    last: int = -1
    began: int = -1
    cycle: int = 0
    seq: int = 0
    tail: str = ""
    seen: int = -1


def context(tail: str) -> str:
    """The last words of the last segments."""
    return " ".join(tail.split()[-CONTEXT:])


def due(line: Line) -> int:
    """When the next timer goes off: the end of the cycle, or silence."""
    return min(line.began + CYCLE_MS if line.began >= 0 else _NEVER, line.last + IDLE_MS if line.last >= 0 else _NEVER)


def _confirmed(line: Line, text: str, at: int, out: list[tuple]) -> Line:
    text = " ".join(text.split())
    segments = line.tail.split("\n") if line.tail else []
    if not text or is_repeat(segments[-1] if segments else "", text):
        return line
    tail = "\n".join([*segments, text][-TAIL:])
    out.append((line.seq, line.cycle, at, text, context(tail)))
    return line._replace(seq=line.seq + 1, tail=tail)


def fired(line: Line, out: list[tuple]) -> Line:
    """After the next timer: what is open is confirmed; a cycle's end begins another, silence stops the recogniser."""
    at = due(line)
    line = _confirmed(line, line.partial, at, out)._replace(partial="")
    if line.began >= 0 and at == line.began + CYCLE_MS and (line.last < 0 or at < line.last + IDLE_MS):
        return line._replace(began=at, cycle=line.cycle + 1)
    return line._replace(began=-1, last=-1)


def heard(line: Line, at: int, text: str, final: bool, out: list[tuple]) -> Line:
    """After a hypothesis; timers that are due before it go off first."""
    while due(line) <= at:
        line = fired(line, out)
    if line.seen >= 0 and at >= line.seen + FORGET_MS:
        line = Line()
    silence = (at - line.last) / 1000 if line.partial else 0.0
    if commits(line.partial, text, silence):
        line = _confirmed(line, line.partial, at, out)
    line = line._replace(partial=text, last=at, seen=at, began=at if line.began < 0 else line.began)
    return _confirmed(line, text, at, out)._replace(partial="") if final else line


def _table(session, out: list[tuple]) -> pd.DataFrame:
    rows = [(session, seq, cycle, pd.Timestamp(at, unit="ms"), text, tail) for seq, cycle, at, text, tail in out]
    return pd.DataFrame(rows, columns=["session", "seq", "cycle", "at", "text", "context"]).astype({"session": "int64", "seq": "int64", "cycle": "int64", "at": "datetime64[ns]"})


class Recogniser(StatefulProcessor):
    """State by session: its line, and hypotheses that the watermark has not passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", "partial string, last long, began long, cycle long, seq long, tail string, seen long")
        self.waiting = handle.getListState("waiting", "at long, text string, final boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            own = [(int(t.value // 1_000_000), x or "", bool(f)) for t, x, f in zip(pdf["ts"], pdf["text"], pdf["final"], strict=True)]
            own = [r for r in own if r[0] > passed]
            if own:
                self.waiting.appendList(own)
                for at in {r[0] for r in own}:
                    self.handle.registerTimer(at)
        yield _table(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, out = timerValues.getCurrentWatermarkInMs(), []
        line = Line(*self.line.get()) if self.line.exists() else Line()
        waiting = sorted((int(a), x, bool(f)) for a, x, f in self.waiting.get()) if self.waiting.exists() else []
        for at, text, final in waiting:
            if at <= passed:
                line = heard(line, at, text, final, out)
        while due(line) <= passed:
            line = fired(line, out)
        left = [r for r in waiting if r[0] > passed]
        if left:
            self.waiting.put(left)
        elif waiting:
            self.waiting.clear()
        forget = line.seen + FORGET_MS
        if forget <= passed and not left:
            self.line.clear()
        else:
            self.handle.registerTimer(min(due(line), max(forget, passed + 1)))
            self.line.update(tuple(line))
        yield _table(key[0], out)

    def close(self) -> None:
        pass


def transcribe(partials: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Confirmed segments of a stream of hypotheses (session, ts, text, final): session, seq, cycle, at, text, context.

    `context` is the end of what is confirmed, as the next cycle's recogniser gets it. Needs the RocksDB state store, which this sets for the session.
    """
    partials.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = partials.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("session").transformWithStateInPandas(statefulProcessor=Recogniser(), outputStructType=OUTPUT, outputMode="Append", timeMode="eventTime")


def transcribed(partials: DataFrame) -> DataFrame:
    """The same over a finished table, of which nothing is late; every session ends in silence.

    A session's rows come in time order and only its line is held, however long it is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, line, begun = None, Line(), False

        def ended() -> Iterator[pd.DataFrame]:
            nonlocal line
            out: list[tuple] = []
            while due(line) < _NEVER:
                line = fired(line, out)
            yield _table(session, out)

        for pdf in batches:
            for key, own in pdf.groupby("session", sort=False):
                if begun and key != session:
                    yield from ended()
                    line = Line()
                session, begun = key, True
                out: list[tuple] = []
                for at, text, final in zip(own["at"], own["text"], own["final"], strict=True):
                    line = heard(line, int(at), text, bool(final), out)
                yield _table(session, out)
        if begun:
            yield from ended()

    rows = partials.where("session is not null and ts is not null").select("session", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("final", F.lit(False)).alias("final"))
    return rows.repartition("session").sortWithinPartitions("session", "at", "text", "final").mapInPandas(run, OUTPUT)


def live_state(segments: DataFrame, partial: DataFrame) -> DataFrame:
    """session, text, context: the confirmed segments in order with what is open, and the end of what is confirmed."""
    return live.live_text(segments, partial).join(live.context_tail(segments), "session", "left")


