"""Folders as a source of Spark's: a table of the files and folders below a root, listed by tasks, and a stream of what changed among them.

Python workers reach the files, so a root is a path that all of them mount or a store that pyarrow knows (``s3://``, ``gs://``, ``hdfs://``); ``files.scan_folder`` goes through Hadoop's
client instead. The source gives names, times and sizes; ``contents`` reads the files of what is left of the rows, so nothing is read that a filter or a join takes away.

The driver lists folders level by level, one at a time, until a level has ``least_folders`` or there are no more; what is below such a level is walked by tasks. It keeps names of
folders, not of files. A large folder of a listed level is dealt to several tasks by a hash of its files' names.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarry.sources.files import FileSystem

SCHEMA = "path string, modificationTime timestamp, length long, is_folder boolean"
BATCH_BYTES = 32 << 20


@dataclass
class Part(InputPartition):
    """What a task lists: a folder and its files (of them one share by a hash of their names), or all that is below it; changed after ``start`` and not after ``end``, in nanoseconds."""

    folder: str
    deep: bool
    share: int = 0
    shares: int = 1
    start: int = -1
    end: int = 1 << 62


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it. Hadoop writes local paths with one slash."""
    return pafs.FileSystem.from_uri(root[5:] if root.startswith("file:/") and not root.startswith("file://") else root)


class Tree:
    """Listing below a root; paths are given as Hadoop writes them, below the root's own name."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.hidden = options.get("include_hidden", "false").lower() == "true"
        self.least_folders, self.files_a_part = int(options.get("least_folders", 256)), int(options.get("files_a_part", 10_000))
        self.fs, self.base = opened(self.root)

    def _below(self, folder: str) -> tuple[list[pafs.FileInfo], list[str]]:
        """(files, folders) directly in a folder; none if it is gone."""
        found = [x for x in self.fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if self.hidden or not x.base_name.startswith(".")]
        return [x for x in found if x.type == pafs.FileType.File], [x.path for x in found if x.type == pafs.FileType.Directory]

    def parts(self, start: int = -1, end: int = 1 << 62) -> list[Part]:
        level, out = [self.base], []
        while level and len(level) < self.least_folders:
            inner = []
            for folder in level:
                files, folders = self._below(folder)
                shares = max(1, -(-len(files) // self.files_a_part))
                out += [Part(folder, False, k, shares, start, end) for k in range(shares)]
                inner += folders
            level = inner
        return out + [Part(folder, True, 0, 1, start, end) for folder in level]

    def read(self, part: Part) -> Iterator[tuple]:
        todo = [part.folder]
        while todo:
            folder = todo.pop()
            files, folders = self._below(folder)
            shown = [x for x in files if part.shares == 1 or zlib.crc32(x.base_name.encode("utf-8", "surrogateescape")) % part.shares == part.share]
            own = self.fs.get_file_info(folder)
            for x in [*([own] if own.type == pafs.FileType.Directory and part.share == 0 else []), *shown]:
                # stores without folders have no time for them: such a folder is in no change
                changed = x.mtime_ns if x.mtime_ns is not None else 0
                if part.start < changed <= part.end:
                    at = datetime.fromtimestamp(changed / 1e9, timezone.utc)
                    yield self.root + x.path[len(self.base) :], at, x.size, x.type == pafs.FileType.Directory
            if part.deep:
                todo += folders


class Listing(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Part]:
        return Tree(self.options).parts()

    def read(self, partition: Part) -> Iterator[tuple]:
        return Tree(self.options).read(partition)


class Changes(DataSourceStreamReader):
    """An offset is a time. A batch has what was changed after one and not after the next, so an edited file comes again, and so does a folder when a file in it, or a folder, is new or
    gone. The present is read up to ``settle`` seconds ago, which must be more than clocks differ and writes take. A file that is moved in with an older time isn't noticed."""

    def __init__(self, options: dict[str, str]):
        self.options, self.settle = options, float(options.get("settle", 5))

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return Tree(self.options).parts(start["ns"], end["ns"]) if start["ns"] < end["ns"] else []

    def read(self, partition: Part) -> Iterator[tuple]:
        return Tree(self.options).read(partition)

    def commit(self, end: dict) -> None:
        pass


class Folders(DataSource):
    """Options: ``path``, ``include_hidden`` (names that begin with a dot), ``least_folders``, ``files_a_part`` and, of streams, ``settle``."""

    @classmethod
    def name(cls) -> str:
        return "quarry_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Listing:
        return Listing(dict(self.options))

    def streamReader(self, schema) -> Changes:
        return Changes(dict(self.options))


def listed(spark: SparkSession, root: str, *, stream: bool = False, **options: object) -> DataFrame:
    """Files and folders below a root (``SCHEMA``), the root itself included, or the stream of their changes. Raises if the root isn't a folder; an empty one is a row."""
    fs = FileSystem(spark)
    if not fs.is_folder(root):
        raise NotADirectoryError(f"{root} is not a folder")
    spark.dataSource.register(Folders)
    source = (spark.readStream if stream else spark.read).format("quarry_folders").option("path", fs.qualified(root))
    for name, value in options.items():
        source = source.option(name, str(value))
    return source.load()


def contents(rows: DataFrame) -> DataFrame:
    """Files of ``listed`` with their ``content``. Folders aren't files, and a file that is gone by now isn't given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, data, size, roots = [], [], 0, {}
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                scheme = path[: path.find("/", path.find("://") + 3)] if "://" in path else ""
                if scheme not in roots:
                    roots[scheme] = opened(path)[0]
                try:
                    with roots[scheme].open_input_file(opened(path)[1]) as file:
                        data.append(file.read())
                except FileNotFoundError:
                    continue
                at.append(k)
                size += len(data[-1])
                if size >= BATCH_BYTES:
                    yield _with(batch, at, data)
                    at, data, size = [], [], 0
            yield _with(batch, at, data)
            at, data, size = [], [], 0

    def _with(batch: pa.RecordBatch, at: list[int], data: list[bytes]) -> pa.RecordBatch:
        found = batch.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*found.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "content"])

    files = rows.where("NOT is_folder").select("path", "modificationTime", "length")
    return files.mapInArrow(run, "path string, modificationTime timestamp, length long, content binary")
