"""A folder of source files as a Spark data source: the driver plans, tasks list and read.

`spark.read.format("repository").option("path", folder)` gives a row for each entry below the
folder but in folders that are never scanned: path, size, status (read, link or unreadable) and
content. A filter on the suffix is pushed down: other files get no row. Links are told apart and
not followed. Tasks open the files themselves, so the folder must be one that executors see under
the same path (an object store goes through `scan.repository_files`, Spark's own reader).
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from cairn.schema import SKIPPED_DIRECTORIES, GraphError

SCHEMA = "path string, suffix string, size long, status string, content binary"
#: Listed folders that are worth a task, and content bytes of a batch.
FOLDERS, BATCH = 64, 16 << 20


class Folders(InputPartition):
    """Folders from the root: those to walk with all below them, and those of which only the direct entries count."""

    def __init__(self, whole: list[str], flat: list[str]):
        super().__init__((tuple(whole), tuple(flat)))
        self.whole, self.flat = whole, flat


class RepositoryReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.suffixes = root, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of the suffix decide which files are opened; Spark checks all others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("suffix",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.suffixes = wanted if self.suffixes is None else self.suffixes & wanted
            else:
                yield f

    def partitions(self) -> list[Folders]:
        """Names of folders alone are listed here, level by level until there are enough for the tasks."""
        flat, level = [], [""]
        while level and len(level) < FOLDERS and len(flat) < FOLDERS:
            below = [os.path.join(d, e.name) for d in level for e in _entries(self.root, d) if e.is_dir(follow_symlinks=False) and e.name not in SKIPPED_DIRECTORIES]
            flat, level = flat + level, below
        parts = [Folders([d], []) for d in level]
        return parts + [Folders([], flat[i : i + FOLDERS]) for i in range(0, len(flat), FOLDERS)] or [Folders([], [])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for folder in [*partition.flat, *partition.whole]:
            for row in self._files(folder, folder in partition.whole):
                rows.append(row)
                size += len(row[4] or b"")
                if size > BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _files(self, folder: str, deep: bool) -> Iterator[tuple]:
        for entry in _entries(self.root, folder):
            path = os.path.join(folder, entry.name)
            if entry.is_dir(follow_symlinks=False):
                if deep and entry.name not in SKIPPED_DIRECTORIES:
                    yield from self._files(path, True)
                continue
            suffix = os.path.splitext("x" + entry.name)[1]
            if self.suffixes is not None and suffix not in self.suffixes:
                continue
            yield (path, suffix, *_read(entry))


def _entries(root: str, folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _read(entry: os.DirEntry) -> tuple[int | None, str, bytes | None]:
    """(size, status, content) of an entry that is no folder."""
    try:
        if not stat.S_ISREG(entry.stat(follow_symlinks=False).st_mode):
            return None, "link", None  # a link, a socket or a device: not a regular file
        with open(entry.path, "rb") as f:
            content = f.read()
        return len(content), "read", content
    except OSError:
        return None, "unreadable", None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["path", "suffix", "size", "status", "content"])


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        root = self.options["path"]
        if not os.path.isdir(root):
            raise GraphError("bad_request", f"{root} is no folder")
        return RepositoryReader(root)


def repository(spark: SparkSession, root: str) -> DataFrame:
    """SCHEMA of the entries below a folder."""
    # plain filters reach a Python source only where this is set
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositorySource)
    if not os.path.isdir(root):
        raise GraphError("bad_request", f"{root} is no folder")
    return spark.read.format("repository").option("path", os.path.abspath(root)).load()


def current_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, readable) of the files below a folder as they are now; links count as unreadable."""
    return repository(spark, root).select("path", "content", (F.col("status") == "read").alias("readable"))


def counters(entries: DataFrame, control: str) -> dict[str, int]:
    """discovered and skipped: all entries but the control file, and those of them that are no regular or readable files."""
    row = entries.where(F.col("path") != control).agg(F.count("*").alias("discovered"), F.count_if(F.col("status") != "read").alias("skipped")).first()
    return row.asDict()
