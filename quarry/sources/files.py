"""Small files on any file system that Spark reaches, through Hadoop's client; and scans of folders."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators.parse import SUPPORTED


MOST_HIDDEN_BYTES = 64 << 20


class FileSystem:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def qualified(self, path: str) -> str:
        fs, p = self._at(path)
        return fs.makeQualified(p).toString()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_bytes(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def modified(self, path: str) -> float:
        """Seconds since 1970."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def replace(self, path: str, text: str) -> None:
        """Write beside the file, then rename over it: readers see the old or the new one."""
        fs, p = self._at(path)
        new = self.jvm.org.apache.hadoop.fs.Path(f"{path}.new")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        option = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(option.getClass(), 1)
        options[0] = option
        context.rename(fs.makeQualified(new), fs.makeQualified(p), options)

    def publish(self, path: str, text: str) -> bool:
        """Write beside the path, then rename to it; false if there is a file already. Readers see no part of it. As atomic as the file system's rename."""
        fs, p = self._at(path)
        new = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        option = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(option.getClass(), 1)
        options[0] = option
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(p), options)
        except Exception as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def names(self, path: str) -> list[str]:
        """What is directly in a folder, by name; nothing if there is none."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        """Bytes of all files below."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def tree(self, root: str, include_hidden: bool) -> list[tuple[str, int]]:
        """(path, size) of files below a folder, by name; hidden ones begin with a dot."""
        fs, p = self._at(root)
        out: list[tuple[str, int]] = []

        def walk(folder) -> None:
            for s in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
                if s.getPath().getName().startswith(".") and not include_hidden:
                    continue
                if s.isDirectory():
                    walk(s.getPath())
                else:
                    out.append((s.getPath().toString(), s.getLen()))

        walk(p)
        return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a run's own tables, in that which the cluster shares (``spark.checkpoint.dir``), or a temporary one where that is unset and the session is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    shared = shared or tempfile.mkdtemp(prefix="quarry-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def scan_folder(spark: SparkSession, root: str, *, source: str = "local", include_hidden: bool = False) -> tuple[DataFrame, int]:
    """(files, how many were skipped as unsupported). Files have source, uri, content, content_hash, last_modified and size_bytes.

    Raises if the root isn't a folder. The driver lists names and the executors read contents. Spark's readers leave out files whose names begin with an
    underscore or a dot; the driver reads these few itself, and raises if they have more than ``MOST_HIDDEN_BYTES``.
    """
    fs = FileSystem(spark)
    if not fs.is_folder(root):
        raise NotADirectoryError(f"{root} is not a folder")
    found = fs.tree(root, include_hidden)
    name = lambda path: path.rsplit("/", 1)[-1]
    wanted = [(p, n) for p, n in found if name(p)[1:].rpartition(".")[2].lower() in SUPPORTED and "." in name(p)[1:]]
    hidden = [(p, n) for p, n in wanted if name(p)[0] in "_."]
    shown = [p for p, _ in wanted if name(p)[0] not in "_."]
    if sum(n for _, n in hidden) > MOST_HIDDEN_BYTES:
        raise ValueError(f"files with hidden names have more than {MOST_HIDDEN_BYTES} bytes")
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.schema(schema).format("binaryFile").load(shown) if shown else spark.createDataFrame([], schema)
    if hidden:
        files = files.union(spark.createDataFrame([(p, datetime.fromtimestamp(fs.modified(p)), n, bytearray(fs.read_bytes(p))) for p, n in hidden], schema))
    return described(files, source), len(found) - len(wanted)


def described(files: DataFrame, source: str = "local") -> DataFrame:
    """Rows of a binaryFile scan under the engine's names."""
    return files.select(F.lit(source).alias("source"), F.col("path").alias("uri"), "content", C.content_hash("content").alias("content_hash"), F.col("modificationTime").alias("last_modified"), F.col("length").alias("size_bytes"))


def uri_prefix(spark: SparkSession, root: str) -> str:
    return FileSystem(spark).qualified(root).rstrip("/") + "/"


def table_as_files(rows: DataFrame, *, source: str, uri: str, content: str, extension: str = "txt") -> DataFrame:
    """Rows of a table as files, named by a column."""
    return rows.select(F.lit(source).alias("source"), F.concat(F.col(uri).cast("string"), F.lit(f".{extension}")).alias("uri"), F.col(content).cast("binary").alias("content"), C.content_hash(content).alias("content_hash"), F.lit(None).cast("timestamp").alias("last_modified"), F.octet_length(content).cast("long").alias("size_bytes"))
