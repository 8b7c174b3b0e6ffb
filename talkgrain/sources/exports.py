"""Exports: JSON with sorted keys, Markdown and plain text, and nested backups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
MANIFEST = "manifest string"


@dataclass(frozen=True)
class ExportOptions:
    metadata: bool = True
    summary: bool = True
    transcript: bool = True
    highlights: bool = True


FULL, MINIMAL = ExportOptions(), ExportOptions(summary=False, highlights=False)
#: what an exported session has; nulls and empty strings and arrays are left out
MODEL = (
    "title string, started_at timestamp, ended_at timestamp, language string, audio_kept boolean, folder string, tags array<string>, location string, body string, "
    "summary string, highlights array<struct<at_ms:bigint,label:string>>, segments array<struct<start_ms:bigint,speaker:int,name:string,text:string>>, transcript string"
)


def as_json(fields: dict[str, Column]) -> Column:
    """An object with its keys in alphabetical order; nulls are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]))


def markdown(title: Column, started: Column, language: Column, summary: Column, transcript: Column, options: ExportOptions = ExportOptions()) -> Column:
    parts = [F.concat(F.lit("# "), title)]
    if options.metadata:
        parts += [F.concat(F.lit("- Date: "), F.date_format(started, "yyyy-MM-dd HH:mm"), F.lit("\n- Language: "), language)]
    if options.summary:
        parts += [F.concat(F.lit("## Summary\n\n"), summary)]
    if options.transcript:
        parts += [F.concat(F.lit("## Transcript\n\n"), transcript)]
    return F.concat_ws("\n\n", *parts)


def plain(markdown_text: Column) -> Column:
    """Markdown without its marks; longer ones first, so that no part of a mark stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(markdown_text, "(?m)^#{1,6} ", ""), "\\*\\*|__|`", ""), "(?m)^- ", "  * ")


def clock(ms: Column) -> Column:
    """Minutes and seconds."""
    return F.format_string("%02d:%02d", F.floor(ms / 60_000), F.floor(ms / 1000) % 60)


def _said(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _filled(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def _facts(lead: str, after: str) -> list[Column]:
    """Lines about the session; `lead` and `after` stand around a fact's name."""
    line = lambda name, value: F.concat(F.lit(f"{lead}{name}{after}"), value)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return [
        line("Started", stamp("started_at")),
        F.when(F.col("ended_at").isNotNull(), line("Ended", stamp("ended_at"))),
        line("Language", F.col("language")),
        line("Audio", F.when(F.col("audio_kept"), "kept").otherwise("deleted")),
        F.when(_said("folder"), line("Folder", F.col("folder"))),
        F.when(_filled("tags"), line("Tags", F.array_join("tags", ", "))),
        F.when(_said("location"), line("Location", F.col("location"))),
    ]


def _name(x: Column) -> Column:
    return F.coalesce(x["name"], F.concat(F.lit("Speaker "), x["speaker"] + 1))


def markdown_document(options: ExportOptions = FULL) -> Column:
    """A session (columns of MODEL) as Markdown; the parts that `options` names. The format is fixed."""
    none = F.lit("")
    parts = [F.concat(F.lit("# "), F.coalesce("title", none), F.lit("\n\n"))]
    if options.metadata:
        parts.append(F.concat(F.array_join(F.array_compact(F.array(*_facts("- **", "**: "))), "\n"), F.lit("\n\n")))
    parts.append(F.when(_said("body"), F.concat(F.lit("## Notes\n\n"), "body", F.lit("\n\n"))).otherwise(none))
    if options.summary:
        parts.append(F.when(_said("summary"), F.concat("summary", F.lit("\n\n"))).otherwise(none))
    if options.highlights:
        line = lambda h: F.concat(F.lit("- `"), clock(h["at_ms"]), F.lit("`"), F.when(h["label"].isNotNull(), F.concat(F.lit(" - "), h["label"])).otherwise(none), F.lit("\n"))
        parts.append(F.when(_filled("highlights"), F.concat(F.lit("## Highlights\n\n"), F.array_join(F.transform("highlights", line), ""), F.lit("\n"))).otherwise(none))
    if options.transcript:
        told = lambda x: F.concat(F.lit("**"), _name(x), F.lit("** ["), clock(x["start_ms"]), F.lit("]: "), F.coalesce(x["text"], none), F.lit("\n\n"))
        text = F.when(_filled("segments"), F.array_join(F.transform("segments", told), "")).when(_said("transcript"), F.concat("transcript", F.lit("\n"))).otherwise(none)
        parts.append(F.concat(F.lit("## Transcript\n\n"), text))
    return F.concat(*parts)


def text_document(options: ExportOptions = FULL) -> Column:
    """The same as plain text, without Markdown's marks in the summary."""
    lines = lambda *cols: F.array(*[F.lit(c) if isinstance(c, str) else c for c in cols])
    none = F.expr("cast(array() as array<string>)")
    title = F.coalesce("title", F.lit(""))
    parts = [lines(title, F.repeat(F.lit("="), F.length(title)), "")]
    if options.metadata:
        parts.append(F.concat(F.array_compact(F.array(*_facts("", ": "))), lines("")))
    parts.append(F.when(_said("body"), lines("--- Notes ---", F.col("body"), "")).otherwise(none))
    if options.summary:
        parts.append(F.when(_said("summary"), lines("--- Summary ---", plain(F.col("summary")), "")).otherwise(none))
    if options.highlights:
        line = lambda h: F.concat(F.lit("  ["), clock(h["at_ms"]), F.lit("] "), F.coalesce(h["label"], F.lit("")))
        parts.append(F.when(_filled("highlights"), F.concat(lines("--- Highlights ---"), F.transform("highlights", line), lines(""))).otherwise(none))
    if options.transcript:
        told = lambda x: F.concat(F.lit("["), _name(x), F.lit("] ["), clock(x["start_ms"]), F.lit("] "), F.coalesce(x["text"], F.lit("")))
        text = F.when(_filled("segments"), F.transform("segments", told)).when(_said("transcript"), lines(F.col("transcript"))).otherwise(none)
        parts.append(F.concat(lines("--- Transcript ---"), text))
    return F.array_join(F.concat(*parts), "\n")


def manifest(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """session_id, manifest: a session with its segments as one JSON document."""
    listed = segments.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "ordinal", "end_ms", "speaker", "text"))).alias("segments"))
    whole = sessions.join(listed, "session_id", "left")
    empty = F.expr("cast(array() as array<struct<start_ms:bigint,ordinal:bigint,end_ms:bigint,speaker:int,text:string>>)")
    body = F.struct(F.coalesce("segments", empty).alias("segments"), F.struct("session_id", "language", "folder").alias("session"), F.lit(3).alias("version"))
    return whole.select("session_id", F.to_json(body).alias("manifest"))


SCHEMA = "segments array<struct<start_ms:bigint,ordinal:bigint,end_ms:bigint,speaker:int,text:string>>, session struct<session_id:bigint,language:string,folder:string>, version int"


def restored(manifests: DataFrame, newest: int = 3) -> DataFrame:
    """session_id and its segments' columns; documents of a newer version are refused, a missing speaker is -1."""
    read = manifests.select(F.from_json("manifest", SCHEMA).alias("m")).where(F.col("m.version") <= newest)
    each = read.select(F.col("m.session.session_id").alias("session_id"), F.explode("m.segments").alias("s"))
    return each.select("session_id", "s.*").withColumn("speaker", F.coalesce("speaker", F.lit(-1)))


def write_texts(named: DataFrame, path: str) -> None:
    """name, body: one line-preserving text per row, partitioned by name."""
    named.select("name", F.col("body").alias("value")).write.partitionBy("name").mode("overwrite").text(path)


def folder_bytes(spark: SparkSession, path: str, by: str) -> DataFrame:
    """by, files, bytes below each folder `by`=... of a tree; no file is opened, as the column with its content is not asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    named = files.withColumn(by, F.url_decode(F.regexp_replace(F.regexp_extract("path", f"/{by}=([^/]*)/", 1), "\\+", "%2B")))
    return named.groupBy(by).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
