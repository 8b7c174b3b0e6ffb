"""Facet filters, sorting and paging of sessions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilter:
    """What a search asks for; None or "" means no restriction. The sort order is no filter."""

    query: str = ""
    date_from: str | None = None
    date_to: str | None = None
    language: str | None = None
    folder: str | None = None
    audio_kept: bool | None = None
    highlights_only: bool = False
    tag: str | None = None
    sort: str = "newest"

    @property
    def is_active(self) -> bool:
        return any([self.date_from, self.date_to, self.language, self.folder, self.audio_kept is not None, self.highlights_only, self.tag])

    @property
    def is_empty(self) -> bool:
        return not self.query.strip() and not self.is_active

    def predicates(self) -> list[Column]:
        out = []
        if self.date_from:
            out.append(F.col("started_at") >= F.lit(self.date_from).cast("timestamp"))
        if self.date_to:
            out.append(F.col("started_at") <= F.lit(self.date_to).cast("timestamp"))
        if self.language:
            out.append(F.col("language") == self.language)
        if self.folder:
            out.append(F.col("folder") == self.folder)
        if self.audio_kept is not None:
            out.append(F.col("audio_kept") == self.audio_kept)
        return out


#: a stored filter; keys that are missing ask for nothing
STORED = "query string, date_from string, date_to string, language string, folder string, audio_kept boolean, highlights_only boolean, tag string, sort string"


def stored_states(json: Column) -> tuple[Column, Column]:
    """(is_empty, is_active) of a filter that is stored as JSON; null and broken JSON is a filter that asks for nothing."""
    f = F.from_json(json, STORED)
    said = lambda c: F.coalesce(f[c], F.lit("")) != ""
    facets = [said(c) for c in ("date_from", "date_to", "language", "folder", "tag")] + [f["audio_kept"].isNotNull(), F.coalesce(f["highlights_only"], F.lit(False))]
    active = reduce(lambda a, b: a | b, facets)
    return ~active & (F.trim(F.coalesce(f["query"], F.lit(""))) == ""), active


def all_of(predicates: list[Column]) -> Column:
    """AND of any number of predicates; none at all lets everything pass."""
    return reduce(and_, predicates, F.lit(True))


def contains_folded(text: Column, query: str) -> Column:
    """Substring search that ignores case and accents."""
    return F.contains(F.collate(text, "UNICODE_CI_AI"), F.collate(F.lit(query), "UNICODE_CI_AI"))


def faceted(sessions: DataFrame, wanted: SearchFilter, highlights: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Sessions that pass all facets; highlights and tags are semi joins on session_id."""
    out = sessions.where(all_of(wanted.predicates()))
    if wanted.highlights_only:
        out = out.join(highlights.select("session_id").distinct(), "session_id", "left_semi")
    if wanted.tag:
        out = out.join(tags.where(F.col("tag") == wanted.tag).select("session_id"), "session_id", "left_semi")
    return out


def in_order(sessions: DataFrame, sort: str = "newest") -> DataFrame:
    """Newest or oldest first, ties by id; relevance without a query means newest."""
    first = F.asc("started_at") if sort == "oldest" else F.desc("started_at")
    return sessions.orderBy(first, F.asc("session_id"))


def page(ordered: DataFrame, number: int, size: int = 20) -> DataFrame:
    return ordered.offset(number * size).limit(size)


def has_more(total: Column, number: int, size: int = 20) -> Column:
    return F.lit(number * size + size) < total


def older_than(sessions: DataFrame, now: str, days: int) -> DataFrame:
    """Sessions with audio that started over `days` days before `now`."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return sessions.where(F.col("audio_kept") & (F.col("started_at") < cutoff))
