"""File trees as a data source of their own: ``format("media_tree")``, for batches and for streams.

Spark's file listing passes over names that start with ``_`` or ``.`` and ends with an error at a folder it may not read. This
source lists every name, does not enter linked or ignored folders, and reports a folder that cannot be read as a row with an
``error``. The driver only expands folders until there is enough work to deal out; each task then walks its folders and hands on
small batches, so neither holds the listing.

As a stream, every batch holds the files changed between two points in time. The time of change is set by the file system
whenever a file is written, copied or moved in, also where the modification time is carried over.
"""

from __future__ import annotations

import json
import os
import stat
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "media_tree"
_BATCH = 4_096
#: Folders dealt out to tasks, as a multiple of the tasks asked for.
_SPLIT = 4

_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("size_bytes", pa.int64()),
        ("last_modified", pa.timestamp("us", tz="UTC")),
        ("error", pa.string()),
    ]
)


@dataclass
class Entry:
    path: str
    is_dir: bool
    size: int
    modified_ns: int
    changed_ns: int


@dataclass
class Folders(InputPartition):
    """Folders for one task: those to walk and those of which only the direct files are wanted."""

    deep: list[str]
    flat: list[str]
    start_ns: int = 0
    end_ns: int | None = None


def file_system(path: str) -> tuple:
    """Arrow's file system for a path, and the path within it. Names are taken as they are, without any URI escapes."""
    from pyarrow import fs

    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file:").removeprefix("//")
    scheme, rest = path.split("://", 1)
    authority, _, inner = rest.partition("/")
    system, start = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{start.rstrip('/')}/{inner}"


def entries(folder: str) -> Iterator[Entry]:
    """What lies directly in a folder; linked folders are left out. Raises OSError if it cannot be read."""
    if "://" not in folder or folder.startswith("file://"):
        with os.scandir(folder.removeprefix("file://")) as found:
            for item in found:
                try:
                    facts = item.stat()
                except OSError:  # a dead link, or gone meanwhile
                    continue
                is_dir = stat.S_ISDIR(facts.st_mode)
                if not (is_dir and item.is_symlink()):
                    yield Entry(item.path, is_dir, facts.st_size, facts.st_mtime_ns, max(facts.st_ctime_ns, facts.st_mtime_ns))
        return
    from pyarrow import fs

    system, inner = file_system(folder)
    prefix = folder[: len(folder) - len(inner)]
    for item in system.get_file_info(fs.FileSelector(inner)):
        modified = item.mtime_ns or 0
        yield Entry(prefix + item.path, item.type == fs.FileType.Directory, item.size or 0, modified, modified)


class _Walk:
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"
        self.ignored = frozenset(json.loads(options.get("ignored", "[]")))
        self.tasks = int(options.get("tasks", "32"))

    def _enters(self, entry: Entry) -> bool:
        return entry.is_dir and entry.path.rsplit("/", 1)[-1] not in self.ignored

    def plan(self, start_ns: int = 0, end_ns: int | None = None) -> list[Folders]:
        """Folders dealt to tasks. A folder with more subfolders than wanted is left whole to one task."""
        wanted = self.tasks * _SPLIT
        deep, flat = [self.root], []
        while deep and len(deep) + len(flat) < wanted:
            below, whole = [], []
            for folder in deep:
                inside = []
                try:
                    for entry in entries(folder):
                        if self._enters(entry):
                            inside.append(entry.path)
                            if len(inside) > 16 * wanted:
                                break
                except OSError:
                    inside = []  # the task that lists its files reports it
                if len(inside) > 16 * wanted:
                    whole.append(folder)
                else:
                    flat.append(folder)
                    below += inside
            if whole:
                deep = below + whole
                break
            deep = below
        n = min(self.tasks, max(1, len(deep) + len(flat)))
        parts = [Folders(sorted(deep)[k::n], sorted(flat)[k::n], start_ns, end_ns) for k in range(n)]
        return parts

    def rows(self, part: Folders) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = [(folder, True) for folder in part.deep] + [(folder, False) for folder in part.flat]
        while waiting:
            folder, enter = waiting.pop()
            try:
                for entry in entries(folder):
                    if entry.is_dir:
                        if enter and self._enters(entry):
                            waiting.append((entry.path, True))
                    elif entry.changed_ns >= part.start_ns and (part.end_ns is None or entry.changed_ns < part.end_ns):
                        held.append((entry.path, entry.size, datetime.fromtimestamp(entry.modified_ns / 1e9, timezone.utc), None))
                    if len(held) >= _BATCH:
                        yield self._batch(held)
                        held = []
            except OSError as error:
                if part.start_ns == 0:  # once in a stream, not with every batch
                    held.append((folder, None, None, error.strerror or str(error)))
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.walk = _Walk(options)

    def partitions(self) -> list[Folders]:
        return self.walk.plan()

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return self.walk.rows(partition)


class TreeStreamReader(DataSourceStreamReader):
    """Offsets are times in nanoseconds; a batch is what changed from one up to the next, and stays the same when replayed
    unless a file changed again, which then is in a later batch."""

    def __init__(self, options: dict):
        self.walk = _Walk(options)
        #: Files younger than this wait for the next batch, as they may still be written.
        self.settle_ns = int(float(options.get("settleSeconds", "1")) * 1e9)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - self.settle_ns}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return self.walk.plan(start["until"], end["until"]) if end["until"] > start["until"] else []

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return self.walk.rows(partition)


class TreeSource(DataSource):
    """Options: ``path``; ``ignored``, a JSON list of folder names not to enter; ``tasks``; ``settleSeconds`` for streams."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, size_bytes long, last_modified timestamp, error string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)


def _options(spark: SparkSession, root: str, ignored: tuple[str, ...]) -> dict:
    spark.dataSource.register(TreeSource)
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    return {"path": root, "ignored": json.dumps(list(ignored)), "tasks": str(tasks)}


def read_tree(spark: SparkSession, root: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Files below ``root`` (``error`` is null) and folders that could not be read."""
    return spark.read.format(FORMAT).options(**_options(spark, root, ignored)).load()


def stream_tree(spark: SparkSession, root: str, ignored: tuple[str, ...] = (), settle_seconds: float = 1) -> DataFrame:
    options = _options(spark, root, ignored) | {"settleSeconds": str(settle_seconds)}
    return spark.readStream.format(FORMAT).options(**options).load()
