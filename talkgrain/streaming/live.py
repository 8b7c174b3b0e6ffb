"""Live transcripts as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def minute_windows(events: DataFrame, length: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """Chunks of fixed length by event time: session, start, end, n, total. events: session, ts, value.

    The watermark, which bounds the state, is this engine's own; what comes later than `late` is left out.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy("session", F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def session_activity(events: DataFrame, gap: str = "120 seconds", late: str = "2 minutes") -> DataFrame:
    """Stretches of activity without a stall of `gap`: session, start, end, n."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def commits(before: str, now: str, silence: float) -> bool:
    """Whether a new partial text starts afresh, so that the one before it is confirmed."""
    before, now = " ".join(before.split()), " ".join(now.split())
    if not before or not now or now.startswith(before):
        return False
    n, size, share = _shared(before, now), len(before), len(now) / len(before)
    if n == 0 and size >= 6:
        return True
    shrink = size - len(now)
    if before.startswith(now) and (shrink >= 10 or (silence >= 1.2 and shrink >= 4)):
        return True
    if size < 8:
        return False
    common = n / size
    return (silence >= 1.2 and common < 0.60 and share < 0.95) or (common < 0.35 and share < 0.85)


def is_repeat(last: str, text: str) -> bool:
    """Whether a confirmed text only says again what was confirmed last."""
    if not last:
        return False
    return text == last or ((text.startswith(last) or last.startswith(text)) and abs(len(text) - len(last)) <= 4)


OUTPUT = "session long, seq long, text string"
STATE = "partial string, last_at double, confirmed string, seq long"


def _advance(partial: str, at: float, confirmed: str, seq: int, rows: list[tuple]) -> tuple[tuple, list[tuple[int, str]]]:
    """State and confirmed texts after more (at, text, final) rows in time order."""
    out = []

    def confirm(text: str) -> None:
        nonlocal confirmed, seq
        text = " ".join(text.split())
        if text and not is_repeat(confirmed, text):
            out.append((seq, text))
            confirmed, seq = text, seq + 1

    for now, text, final in rows:
        if commits(partial, text, now - at if partial else 0.0):
            confirm(partial)
        partial, at = text, now
        if final:
            confirm(partial)
            partial = ""
    return (partial, at, confirmed, seq), out


def assemble(partials: DataFrame) -> DataFrame:
    """Confirmed segments (session, seq, text) from partial hypotheses (session, ts, text, final), state by session.

    Rows of one batch are taken in time order; a session without news for ten minutes is flushed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = state.get if state.exists else ("", 0.0, "", 0)
        if state.hasTimedOut:
            _, out = _advance(*own, [(own[1], own[0], True)])
            state.remove()
        else:
            rows = sorted((t.timestamp(), x or "", bool(f)) for b in batches for t, x, f in zip(b["ts"], b["text"], b["final"], strict=True))
            own, out = _advance(*own, rows)
            state.update(own)
            state.setTimeoutDuration(600_000)
        yield pd.DataFrame({"session": [key[0]] * len(out), "seq": [s for s, _ in out], "text": [t for _, t in out]}).astype({"session": "int64", "seq": "int64"})

    return partials.groupBy("session").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def assemble_batch(partials: DataFrame) -> DataFrame:
    """The same over a finished table; every session is flushed at its end."""

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((t.timestamp(), x or "", bool(f)) for t, x, f in zip(pdf["ts"], pdf["text"], pdf["final"], strict=True))
        own, out = _advance("", 0.0, "", 0, rows)
        out += _advance(*own, [(own[1], own[0], True)])[1]
        return pd.DataFrame({"session": [key[0]] * len(out), "seq": [s for s, _ in out], "text": [t for _, t in out]}).astype({"session": "int64", "seq": "int64"})

    return partials.groupBy("session").applyInPandas(whole, OUTPUT)


def live_text(confirmed: DataFrame, partial: DataFrame) -> DataFrame:
    """session, text: confirmed segments in order, then the open partial text."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ")
    joined = confirmed.groupBy("session").agg(listed.alias("done")).join(partial.select("session", F.col("text").alias("open")), "session", "full_outer")
    return joined.select("session", F.concat_ws(" ", "done", F.nullif("open", F.lit(""))).alias("text"))


def context_tail(confirmed: DataFrame, segments: int = 3, words: int = 100) -> DataFrame:
    """session, context: the last words of the last segments."""
    last = F.slice(F.array_sort(F.collect_list(F.struct("seq", "text")), lambda a, b: (b["seq"] - a["seq"]).cast("int")), 1, segments)
    said = confirmed.groupBy("session").agg(last.alias("l")).select("session", F.split(F.array_join(F.transform(F.reverse("l"), lambda s: s["text"]), " "), " ").alias("w"))
    return said.select("session", F.array_join(F.slice("w", F.greatest(F.size("w") - words + 1, F.lit(1)), words), " ").alias("context"))
