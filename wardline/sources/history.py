"""History files that are rewritten whole, as a stream.

A room's history is one JSON array, written anew with each message, so a file
stream, which takes each file once, would miss what comes later.  Here an
offset is the version (time of change and size) of every file: the driver lists
files and never opens them, a task reads a file that has changed.  It gives all
its entries; ``stream_history`` keeps the ids it has seen as state and lets
each through once, even if older entries were dropped from the file or changed.

A file that is not a whole JSON array (it may be half written) has no entries
until its next version.  Entries that are no objects, or have no id, are left
out.  A JSON array cannot be split, so a file is read by one task; a task takes
many small files, as many as make up ``TASK_BYTES``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from wardline import schemas
from wardline.functions import text as tx

NAME = "rewritten_history"
ROWS = 4096
# What a task reads if there are more files than tasks wanted, and what opening a file counts for.
TASK_BYTES = 32 << 20
OPEN_BYTES = 128 << 10
_SCHEMA = "file string, place long, id string, entry string"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; a path without a scheme is a local one, as for the reader of files."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Changed(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files

    @property
    def file(self) -> str:
        """The first of the files."""
        return self.files[0]


def _tasks(sizes: dict[str, int], wanted: int) -> list[list[str]]:
    """Files in order of their names, cut into tasks of about ``TASK_BYTES``; smaller ones if that gives less than ``wanted``."""
    costs = {file: size + OPEN_BYTES for file, size in sorted(sizes.items())}
    most, found, own = min(TASK_BYTES, sum(costs.values()) / wanted), [], 0
    for file, cost in costs.items():
        if not found or own + cost > most:
            found.append([])
            own = 0
        found[-1].append(file)
        own += cost
    return found


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str = ".json", tasks: int = 1):
        self.path, self.suffix, self.tasks = path, suffix, tasks

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Version of every file under the path, by name."""
        system, path = _system(self.path)
        files = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
        seen = (f for f in files if f.is_file and f.path.endswith(self.suffix))
        # Names with _ or . in front are what a writer has not finished.
        return {f.path: f"{f.mtime_ns}/{f.size}" for f in seen if not re.search(r"/[_.]", f.path[len(path.rstrip("/")) :])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        changed = {file: int(version.split("/")[1]) for file, version in end.items() if start.get(file) != version}
        return [_Changed(files) for files in _tasks(changed, self.tasks)]

    def read(self, partition: _Changed):
        system, _ = _system(self.path)
        for file in partition.files:
            yield from _entries(system, file)


def _entries(system: fs.FileSystem, file: str) -> Iterator[pa.RecordBatch]:
    try:
        with system.open_input_stream(file) as f:
            entries = json.loads(f.read())
    except (ValueError, FileNotFoundError):  # half written, or gone since it was listed
        return
    if not isinstance(entries, list):
        return
    found = [(i, e) for i, e in enumerate(entries) if isinstance(e, dict) and e.get("id") is not None]
    for low in range(0, len(found), ROWS):
        part = found[low : low + ROWS]
        columns = [
            pa.array([file] * len(part), pa.string()),
            pa.array([i for i, _ in part], pa.int64()),
            pa.array([str(e["id"]) for _, e in part], pa.string()),
            pa.array([json.dumps(e, ensure_ascii=False) for _, e in part], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "place", "id", "entry"])


class RewrittenHistory(DataSource):
    """``spark.readStream.format("rewritten_history").load(folder)``: all entries of files that have changed."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], self.options.get("suffix", ".json"), int(self.options.get("tasks", 1)))


def stream_history(
    spark: SparkSession, path: str, schema: T.StructType = schemas.MESSAGE, per_file: bool = True, suffix: str = ".json"
) -> DataFrame:
    """Each message of the files under a folder once, with its ``file`` and ``place`` when first seen.

    Ids are compared within a file, or, if they are unique over all files, without it: then a message
    that moves to another file is no new one.  State is one digest a message.
    """
    spark.dataSource.register(RewrittenHistory)
    cores = spark.sparkContext.defaultParallelism
    entries = spark.readStream.format(NAME).options(suffix=suffix, tasks=2 * cores).load(path)
    key = tx.digest(F.to_json(F.struct("file", "id")) if per_file else F.col("id"))
    once = entries.withColumn("_key", key).dropDuplicates(["_key"])
    message = F.from_json("entry", schema)
    return once.select("file", "place", message.alias("m")).select("file", "place", "m.*")
