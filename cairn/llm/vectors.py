"""What the integer vector operators share: whole vectors as integers, blocks of rows, and blocks of queries that meet them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest integer component; with up to 4096 dimensions every sum of products is then exact in doubles and longs.
MOST = 1 << 20
DIMENSIONS = 4096


def whole(e: Column) -> Column:
    """Whether a vector is there with all its components finite."""
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(e.isNotNull() & fine, F.lit(False))


def integer_vectors(rows: DataFrame, *columns: str, scale: int = 256) -> DataFrame:
    """(vec_id long, x array<int>, dim int, and the named columns) of the whole vectors of rows(vec_id, embedding, ..).

    A component v becomes floor(scale * v), v as double. Vectors null or with null or non-finite
    components are left out; a component beyond MOST, or a vector longer than DIMENSIONS, is refused.
    An empty vector gets one component, zero, as its only product is zero, and keeps dimension 0.
    """
    e = F.col("embedding").cast("array<double>")
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), *columns).where(whole(F.col("e")))
    refuse = F.raise_error(F.lit(f"a vector component is beyond {MOST}")).cast("int")
    value = lambda v: F.when(F.abs(scale * v) > MOST, refuse).otherwise(F.floor(scale * v).cast("int"))
    long = F.raise_error(F.lit(f"a vector has more than {DIMENSIONS} components")).cast("int")
    dim = F.when(F.size("e") > DIMENSIONS, long).otherwise(F.size("e"))
    return found.select("vec_id", F.when(F.size("e") == 0, F.array(F.lit(0))).otherwise(F.transform("e", value)).alias("x"), dim.alias("dim"), *columns)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A column of integer vectors as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), max(1, dim))


def lists(a: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))


def least_rows(ids: np.ndarray, x: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ids, x, ..) with one row for each id, by id: the one with the least values of `more`, then the least vector."""
    order = np.lexsort((*x.T[::-1], *more[::-1], ids))
    ids, first = np.unique(ids[order], return_index=True)
    return ids, x[order][first], *(m[order][first] for m in more)


def cell(a: np.ndarray) -> pa.Array:
    """One binary value."""
    return pa.array([a.tobytes()], pa.binary())


def longs(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts).astype(np.int64) if parts else [], pa.int64())


def block_count(n: int, most: int, least: int, tasks: int) -> int:
    """Blocks of n rows: at most `most` rows each, and so many that all tasks have one of `least` rows."""
    return max(1, -(-n // most), min(tasks, n // least))


def block_of(blocks: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")


def meet(index: DataFrame, blocks: int, queries: DataFrame, asks: int, run, schema: str) -> DataFrame:
    """run((dim, block, ask), index rows, queries) for every block of the index and every block of the stated query set of its dimension.

    index(dim, block, ..) has one row a block; queries(dim, vec_id, ..). Queries are dealt by vec_id.
    """
    own = index.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    asked = queries.withColumn("ask", block_of(asks, "vec_id")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "block", "ask"]
    return own.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, schema)
