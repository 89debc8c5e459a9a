"""What the text operators share: lineage cuts, word spans and word fingerprints.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A word's fingerprint is a 64-bit
polynomial over a fixed random byte table, mixed once; two given words collide with a
probability near 2**-64.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the numpy helpers take at a time.
SLICE = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
U = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a local one is made only for a local master without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the cluster's shared folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables in the cluster's shared folder, compressed; each is deleted when all that reads it has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.home, self.paths = spark, f"{folder(spark)}/tables-{uuid.uuid4().hex}", {}

    def table(self, df: DataFrame) -> DataFrame:
        """The same rows from a written table."""
        path = f"{self.home}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[out] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, self.paths[t])


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(df: DataFrame) -> DataFrame:
    """The same rows from a table written to the cluster's shared folder; it stays with the folder."""
    return Scratch(df.sparkSession).table(df)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (multiply and xor-shift)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(col: pa.Array, limit: int = 4 * SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `limit` bytes together (one long text may hold more)."""
    _, offsets = text_bytes(col)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the index of each text's first word (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Fingerprints of the given words; with lower, A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    table = _BYTE_LOWER if lower else _BYTE
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, "right")))
        lens = ends[a:b] - starts[a:b]
        first = np.cumsum(lens) - lens
        total = int(lens.sum())
        at = np.arange(total)
        place = at - np.repeat(first, lens)
        power = np.cumprod(np.full(int(lens.max()), _BASE))
        value = table[raw[place + np.repeat(starts[a:b], lens)]] * power[place]
        out[a:b] = mix(np.add.reduceat(value, first) + lens.astype(np.uint64) * U(0xD6E8FEB86659FD93))
        a = b
    return out


def windows_of(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every run of `size` consecutive entries (runs across texts included)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, U(size * 0xA0761D6478BD642F % (1 << 64)))
    for j in range(size):
        out = out * U(0xE7037ED1A0B428DB) + words[j : j + n]
    return mix(out)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over slices of a few MB of text, so that a task's memory does not follow the batch."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                yield from fn(batch.slice(a, b - a))

    return df.mapInArrow(run, schema)


def ints(col: pa.Array) -> np.ndarray:
    """An integer column without nulls as numpy."""
    return np.asarray(col.to_numpy(zero_copy_only=False))
