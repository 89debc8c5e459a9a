"""Exact top-k inner products by an impact-ordered index, a score at a time.

Per block of vectors, the index has for each dimension the rows by descending quantised
magnitude of their component: segments of rows of one dimension, sign and level, the level kept
once. A query takes segments of all dimensions in descending order of what they can add,
|query component| times level: all those that can add more than a falling bound. A row's score
is at most its accumulator plus the bound for each dimension it has not been met in. The rows
with the largest accumulators are scored exactly, which gives a score that the kth best cannot
fall below; once few rows can still reach it, those are all scored exactly and the rest are
proven out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch
from cairn.llm.vectors import block_count, block_of, cell, integer_vectors, least_rows, longs, matrix, meet

#: Levels of a quantised magnitude.
LEVELS = 255
#: Rows (under 2**16) and queries of a block at most, and rows that are worth a block.
ROWS, QUERIES, LEAST = 16384, 1024, 1024
#: The bound's first share of the largest product, and how it falls from step to step.
FIRST, FALL = 0.2, 0.7
#: Rows are scored exactly once no more than this share of the block (and 4 k rows) can be members.
FEW = 1 / 24
INDEX = "dim int, block int, ids binary, x binary, rows binary, levels binary, width long"


class Postings:
    """The segments of a block: per dimension its rows by descending level, with the signed level of each and where each level ends."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray, levels: np.ndarray, width: int):
        self.ids, self.x, self.rows, self.levels, self.width = ids, x, rows, levels, width
        n, d = x.shape
        sizes = np.bincount((np.arange(d)[:, None] * (LEVELS + 2) + np.abs(levels)).ravel(), minlength=d * (LEVELS + 2)).reshape(d, LEVELS + 2)
        # ends[i, l]: postings of dimension i at level l or above
        self.ends = np.cumsum(sizes[:, ::-1], 1)[:, ::-1].astype(np.int64)
        self.read = self.scored = 0

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> Postings:
        width = max(1, -(-int(np.abs(x).max(initial=0)) // LEVELS))
        level = (np.sign(x) * (np.abs(x) // width)).T.astype(np.int16)
        order = np.lexsort((level, -np.abs(level)), axis=1)
        return cls(ids, x, order.astype(np.uint16), np.take_along_axis(level, order, 1), width)

    def search(self, name: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best of the block but `name`, ties to smaller ids."""
        n, w = len(self.ids), self.width
        size = np.abs(q)
        used = np.flatnonzero(size)
        own = np.flatnonzero(self.ids == name)
        total, met = np.zeros(n), np.zeros(n, np.int64)
        at = np.zeros(len(q), np.int64)
        most = int((size * np.abs(self.x).max(0, initial=0)).max(initial=0))
        bound, best, fewest = int(most * FIRST), -np.inf, max(4 * k, int(n * FEW))
        while True:
            # a level l of dimension i adds at most |q| * (l * w + w - 1): all that add more than the bound are taken
            lowest = -(-(bound // size[used].astype(np.int64) + 2) // w) - 1
            ends = self.ends[used, np.minimum(lowest, LEVELS + 1)]
            spans = [(i, at[i], e) for i, e in zip(used.tolist(), ends.tolist()) if e > at[i]]
            at[used] = np.maximum(at[used], ends)
            if spans:
                rows = np.concatenate([self.rows[i, a:b] for i, a, b in spans])
                level = np.concatenate([self.levels[i, a:b] for i, a, b in spans])
                weight = np.repeat(q[[i for i, _, _ in spans]], [b - a for _, a, b in spans])
                adds = weight * level * w
                if w > 1:  # a level stands for w values: the most that they add
                    adds += np.where(adds >= 0, np.abs(weight) * (w - 1), 0)
                    adds = np.where((level == 0) & (weight != 0), np.abs(weight) * (w - 1), adds)
                total += np.bincount(rows, adds, n)
                met += np.bincount(rows, minlength=n)
                self.read += len(rows)
            reach = total + bound * (len(used) - met)
            reach[own] = -np.inf
            if bound == 0 or n <= fewest:
                break
            if n - len(own) > k:
                top = np.argpartition(np.where(reach == -np.inf, -np.inf, total), n - 2 * k)[n - 2 * k :]
                top = top[reach[top] > -np.inf]
                self.scored += len(top)
                if len(top) >= k:
                    best = max(best, np.partition(self.x[top] @ q, len(top) - k)[len(top) - k])
            if np.count_nonzero(reach >= best) <= fewest:
                break
            bound = int(bound * FALL)
        found = np.flatnonzero((reach >= best) & (reach > -np.inf))
        self.scored += len(found)
        score = self.x[found] @ q
        order = np.lexsort((self.ids[found], -score))[:k]
        return found[order], score[order].astype(np.int64)


def _build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    dim, block = (v.as_py() for v in key)
    ids, x = least_rows(rows.column("vec_id").to_numpy(), matrix(rows.column("x"), dim))
    p = Postings.build(ids, x)
    return pa.table([pa.array([dim], pa.int32()), pa.array([block], pa.int32()), cell(p.ids), cell(p.x.astype(np.int32)), cell(p.rows), cell(p.levels), pa.array([p.width])], ["dim", "block", "ids", "x", "rows", "levels", "width"])


def _search(k: int):
    def run(key, index: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if index.num_rows and queries.num_rows:
            dim, part = key[0].as_py(), index.to_pylist()[0]
            load = lambda name, kind: np.frombuffer(part[name], kind)
            ids = load("ids", np.int64)
            shape = lambda a: a.reshape(-1, len(ids))
            p = Postings(ids, load("x", np.int32).reshape(len(ids), max(1, dim)).astype(np.float64), shape(load("rows", np.uint16)), shape(load("levels", np.int16)), part["width"])
            for name, q in zip(*least_rows(queries.column("vec_id").to_numpy(), matrix(queries.column("x"), dim))):
                found, score = p.search(name, q, k)
                out[0].append(np.full(len(found), name))
                out[1].append(ids[found])
                out[2].append(score)
        return pa.table([longs(c) for c in out], ["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query, ties to smaller vec_id.

    Both inputs are (vec_id, embedding); a query's own vec_id is no candidate, and only vectors of
    its dimension are. Rows with a null vec_id, and vectors null or with null or non-finite
    components, take no part. Repeated rows of a vec_id count once, by the least vector of each
    dimension. Fewer than k candidates are all returned; empty tables give no rows. Other columns
    are not read.
    """
    scratch = Scratch(rows.sparkSession)
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    own, asked = (integer_vectors(r).where("vec_id is not null").select("vec_id", "x", "dim") for r in (rows, queries))
    own, asked = scratch.table(own), scratch.table(asked)
    blocks = block_count(own.count(), ROWS, LEAST, tasks)
    asks = max(1, -(-asked.count() // QUERIES))
    index = scratch.table(own.withColumn("block", block_of(blocks, "vec_id")).groupBy("dim", "block").applyInArrow(_build, INDEX))
    found = meet(index, blocks, asked, asks, _search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = scratch.table(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    scratch.drop(own, asked, index)
    return out
