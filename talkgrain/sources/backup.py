"""Backups as a Spark data source of framed files.

A file is a frame: the manifest's length (eight bytes, little-endian), the manifest as JSON, and the audio one after another. The
manifest lists its version, the sessions, and for each audio its path, its offset after the manifest and its length. Every
task writes files of its own, of about FRAME_BYTES at most (or one session), so a backup is a folder that is written
and read in parallel. The folder must be one that the driver and all executors mount.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

VERSION = 3
FORMAT, SUFFIX = "session_backup", ".backup"
FRAME_BYTES = 64 << 20
SCHEMA = "session string, audio array<struct<relativePath:string,data:binary>>"
_LENGTH = struct.Struct("<Q")


class BackupError(ValueError):
    """A file that is no backup, or one of a newer version."""


def folder(path: str) -> Path:
    if "://" in path and not path.startswith("file://"):
        raise BackupError(f"backups need a mounted folder, not {path}")
    return Path("/" + path.removeprefix("file:").lstrip("/"))


def read_manifest(file, size: int, newest: int) -> tuple[dict, int]:
    """The manifest of an open frame of `size` bytes, and where the audio begins."""
    head = file.read(_LENGTH.size)
    length = _LENGTH.unpack(head)[0] if len(head) == _LENGTH.size else size
    if _LENGTH.size + length > size:
        raise BackupError(f"{file.name}: not a backup")
    try:
        manifest = json.loads(file.read(length))
    except ValueError as e:
        raise BackupError(f"{file.name}: not a backup") from e
    if manifest.get("version", 0) > newest:
        raise BackupError(f"{file.name}: version {manifest['version']} is newer than {newest}")
    return manifest, _LENGTH.size + length


def referenced(session: dict) -> set[str]:
    return {c["relativePath"] for c in session.get("chunks") or [] if c.get("relativePath")}


class _Frame:
    """A frame that is being written: the audio goes to a file at once, the manifest before it when the frame is closed."""

    def __init__(self, target: Path):
        self.target = target
        self.blobs = Path(f"{target}.audio")
        self.out, self.offset, self.sessions, self.audio = self.blobs.open("wb"), 0, [], []

    def add(self, session: dict, audio: list) -> None:
        self.sessions.append(session)
        for a in audio:
            data = bytes(a["data"] or b"")
            self.audio.append({"relativePath": a["relativePath"], "offset": self.offset, "length": len(data)})
            self.offset += self.out.write(data)

    def close(self) -> str:
        self.out.close()
        manifest = json.dumps({"version": VERSION, "sessions": self.sessions, "audioFiles": self.audio}, ensure_ascii=False, sort_keys=True).encode()
        with open(f"{self.target}.part", "wb") as out, self.blobs.open("rb") as audio:
            out.write(_LENGTH.pack(len(manifest)) + manifest)
            while piece := audio.read(1 << 20):
                out.write(piece)
        self.blobs.unlink()
        return f"{self.target}.part"


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.limit = int(options.get("frameBytes", FRAME_BYTES))

    def write(self, rows: Iterator[Row]) -> _Written:
        top = folder(self.folder)
        top.mkdir(parents=True, exist_ok=True)
        files, frame, held = [], None, 0
        for row in rows:
            frame = frame or _Frame(top / f"{uuid.uuid4().hex}{SUFFIX}")
            audio = row["audio"] or []
            frame.add(json.loads(row["session"]), audio)
            held += len(row["session"]) + sum(len(a["data"] or b"") for a in audio)
            if held >= self.limit:
                files.append(frame.close())
                frame, held = None, 0
        if frame:
            files.append(frame.close())
        return _Written(files)

    def commit(self, messages: list) -> None:
        """Only what successful tasks wrote gets its name; that of failed and repeated ones never does."""
        top = folder(self.folder)
        if self.overwrite and top.exists():
            for old in top.glob(f"*{SUFFIX}"):
                old.unlink()
        for f in (f for m in messages if m for f in m.files):
            os.replace(f, f.removesuffix(".part"))

    def abort(self, messages: list) -> None:
        for f in (f for m in messages if m for f in m.files):
            Path(f).unlink(missing_ok=True)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.newest = options["path"], int(options.get("newestVersion", VERSION))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(f)) for f in sorted(folder(self.folder).glob(f"*{SUFFIX}"))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        with open(partition.value, "rb") as file:
            size = os.fstat(file.fileno()).st_size
            manifest, begin = read_manifest(file, size, self.newest)
            places: dict[str, tuple[int, int]] = {}
            for a in manifest.get("audioFiles", []):
                places.setdefault(a["relativePath"], (begin + a["offset"], a["length"]))
            for session in manifest.get("sessions", []):
                audio = []
                for path in sorted(referenced(session) & places.keys()):
                    at, length = places[path]
                    if at + length <= size:  # audio that a cut file lacks is left out
                        file.seek(at)
                        audio.append((path, file.read(length)))
                yield json.dumps(session, ensure_ascii=False, sort_keys=True), audio


class BackupSource(DataSource):
    """Options: path; newestVersion when reading; frameBytes when writing."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


#: what a manifest has of a session; keys that an older one lacks are null
SESSION = (
    "id bigint, languageModeRaw string, folder string, chunks array<struct<index:bigint,relativePath:string,sizeBytes:bigint>>, "
    "segments array<struct<index:bigint,startMs:bigint,endMs:bigint,speakerIndex:int,text:string>>, highlights array<struct<atMs:bigint,label:string>>, tags array<string>"
)


def write_backup(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows (session: JSON of a session, audio) as a backup."""
    rows.sparkSession.dataSource.register(BackupSource)
    rows.select("session", "audio").write.format(FORMAT).option("path", path).mode(mode).save()


def read_backup(spark: SparkSession, path: str, newest: int = VERSION) -> DataFrame:
    """session (a struct) and audio of a backup's sessions; fails on a file of a version that is newer than `newest`.

    Lists that an older backup lacks are empty, as is a speaker that it does not name -1. An empty folder gives no rows.
    """
    spark.dataSource.register(BackupSource)
    read = spark.read.format(FORMAT).option("path", path).option("newestVersion", newest).load()
    s = F.from_json("session", SESSION)
    full = s.withField("segments", F.transform(F.coalesce(s["segments"], F.array()), lambda x: x.withField("speakerIndex", F.coalesce(x["speakerIndex"], F.lit(-1)))))
    for name in ("chunks", "highlights", "tags"):
        full = full.withField(name, F.coalesce(s[name], F.array()))
    return read.select(full.alias("session"), "audio")


def new_sessions(read: DataFrame, present: DataFrame) -> DataFrame:
    """Those of a backup's sessions whose id is not among `present` (session_id)."""
    known = present.select(F.col("session_id").alias("_id")).distinct()
    return read.join(known, F.col("session.id") == F.col("_id"), "left_anti")
