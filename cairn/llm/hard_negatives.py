"""Hard negatives by Fagin's threshold algorithm.

Per block of vectors, the index has for each dimension the rows sorted by their component, over
all rows and over the rows of each label. An anchor reads the lists from the end that its
component's sign makes the best, all to the same depth. Every row that is met is scored at once
from its whole vector (random access, in integers). No row that has not been met can score more
than the threshold: the sum over the dimensions of the anchor's component times the last value
read. Reading stops once the threshold is strictly below each window's kth score (or, where a
window holds fewer, below its lower end), so that ties are met too.

Positives come first, from the lists of the anchor's label; they give the windows in which the
negatives are looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch
from cairn.llm.vectors import block_count, block_of, cell, integer_vectors, least_rows, longs, matrix, meet

#: Rows (under 2**16) and anchors of a block at most, and rows that are worth a block.
ROWS, ANCHORS, LEAST = 8192, 1024, 1024
#: Entries of each list read first, and by what the depth grows.
FIRST, GROWTH = 32, 1.6
INDEX = "dim int, block int, ids binary, labels binary, x binary, lists binary, own binary"


class Lists:
    """Rows of a block by label and id, with the sorted lists over all rows (lists) and over each label's run of rows (own)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, lists: np.ndarray, own: np.ndarray):
        self.ids, self.labels, self.x, self.lists, self.own = ids, labels, x, lists, own
        self.read = self.scored = 0

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Lists:
        order = np.lexsort((ids, labels))
        ids, labels, x = ids[order], labels[order], x[order]
        lists = np.argsort(x.T, axis=1, kind="stable").astype(np.uint16)
        own = np.lexsort((x.T, np.broadcast_to(labels, x.T.shape)), axis=1).astype(np.uint16)
        return cls(ids, labels, x, lists, own)

    def label(self, label: int) -> tuple[int, int]:
        """The run of rows of a label."""
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def access(self, q: np.ndarray, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(rows met for the first time, their scores, the threshold for all others), step by step; the last threshold is minus infinity."""
        used = np.flatnonzero(q)
        high, low = used[q[used] > 0], used[q[used] < 0]
        n, depth = lists.shape[1], 0
        met = np.zeros(len(self.ids), bool)
        while depth < n:
            until = min(n, max(FIRST, int(depth * GROWTH))) if len(used) else n
            # an anchor of zeros scores zero with all rows, which any list names
            ends = [lists[high, n - until : n - depth].ravel(), lists[low, depth:until].ravel()] if len(used) else [lists[0]]
            new = np.zeros(len(met), bool)
            for part in ends:
                new[part] = True
                self.read += len(part)
            new &= ~met
            met |= new
            rows = np.flatnonzero(new)
            self.scored += len(rows)
            last = np.concatenate([lists[high, n - until], lists[low, until - 1]])
            threshold = float(self.x[last, np.concatenate([high, low])] @ q[np.concatenate([high, low])])
            depth = until
            yield rows, self.x[rows] @ q, threshold if until < n else -np.inf

    def positives(self, name: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows of the label but the anchor's own."""
        a, b = self.label(label)
        rows, scores = [], []
        if a == b:
            return np.zeros(0, np.int64), np.zeros(0)
        for new, score, threshold in self.access(q, self.own[:, a:b]):
            other = self.ids[new] != name
            rows.append(new[other])
            scores.append(score[other])
            all_scores = np.concatenate(scores)
            if len(all_scores) >= k and threshold < np.partition(all_scores, len(all_scores) - k)[len(all_scores) - k]:
                break
        rows, scores = np.concatenate(rows), np.concatenate(scores)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best]

    def negatives(self, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of the k best rows of other labels in each window (least, most score)."""
        least, most = min((a for a, _ in windows), default=0), max((b for _, b in windows), default=-1)
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        if least > most:
            return [(rows, scores) for _ in windows]
        for new, score, threshold in self.access(q, self.lists):
            fit = (score >= least) & (score <= most) & (self.labels[new] != label)
            rows, scores = np.concatenate([rows, new[fit]]), np.concatenate([scores, score[fit]])
            if threshold < min(self._open(scores, a, b, k) for a, b in windows if a <= b):
                break
        out = []
        for a, b in windows:
            inside = np.flatnonzero((scores >= a) & (scores <= b))
            best = inside[np.lexsort((self.ids[rows[inside]], -scores[inside]))[:k]]
            out.append((rows[best], scores[best]))
        return out

    @staticmethod
    def _open(scores: np.ndarray, least: int, most: int, k: int) -> float:
        """What the threshold must fall below for a window: its kth score, or its lower end."""
        inside = scores[(scores >= least) & (scores <= most)]
        return float(np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else float(least)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The integers s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    dim, block = (v.as_py() for v in key)
    ids, x, labels = least_rows(rows.column("vec_id").to_numpy(), matrix(rows.column("x"), dim), rows.column("label").to_numpy())
    p = Lists.build(ids, labels, x)
    return pa.table([pa.array([dim], pa.int32()), pa.array([block], pa.int32()), *map(cell, (p.ids, p.labels, p.x.astype(np.int32), p.lists, p.own))], ["dim", "block", "ids", "labels", "x", "lists", "own"])


def _load(dim: int, index: pa.Table) -> Lists:
    part = index.to_pylist()[0]
    load = lambda name, kind: np.frombuffer(part[name], kind)
    ids = load("ids", np.int64)
    lists, own = (load(name, np.uint16).reshape(-1, len(ids)) for name in ("lists", "own"))
    return Lists(ids, load("labels", np.int64), load("x", np.int32).reshape(len(ids), max(1, dim)).astype(np.float64), lists, own)


def _find_positives(k: int):
    def run(key, index: pa.Table, anchors: pa.Table) -> pa.Table:
        out = ([], [], [])
        if index.num_rows and anchors.num_rows:
            dim = key[0].as_py()
            p = _load(dim, index)
            for name, q, label in zip(*least_rows(anchors.column("vec_id").to_numpy(), matrix(anchors.column("x"), dim), anchors.column("label").to_numpy())):
                rows, scores = p.positives(name, label, q, k)
                for c, v in zip(out, (np.full(len(rows), name), p.ids[rows], scores)):
                    c.append(v)
        return pa.table([longs(c) for c in out], ["anchor_id", "positive_id", "positive_score"])

    return run


def _find_negatives(k: int, low: int, high: int):
    def run(key, index: pa.Table, anchors: pa.Table) -> pa.Table:
        out = ([], [], [], [], [])
        if index.num_rows and anchors.num_rows:
            dim = key[0].as_py()
            p = _load(dim, index)
            x = matrix(anchors.column("x"), dim)
            for row, q in zip(anchors.drop_columns(["x"]).to_pylist(), x):
                windows = [window(v["score"], low, high) for v in row["positives"]]
                for v, (rows, scores) in zip(row["positives"], p.negatives(row["label"], q, windows, k)):
                    n = len(rows)
                    for c, value in zip(out, (np.full(n, row["vec_id"]), np.full(n, v["id"]), p.ids[rows], np.full(n, v["score"]), scores)):
                        c.append(value)
        return pa.table([longs(c) for c in out], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each anchor's hard negatives for each of its positives.

    Both inputs are (vec_id, embedding, label); anchors are rows of `rows`. Scores are integer inner
    products with the anchor, higher first, ties to smaller vec_id. An anchor's positives are its
    first other rows of its label; a positive's negatives the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Rows with a null vec_id
    or label, and vectors null or with null or non-finite components, take no part; only vectors of
    the anchor's dimension meet it. Repeated rows of a vec_id count once, by the least label and
    vector of each dimension. Fewer than are asked for are all returned; anchors without positives,
    and empty tables, give no rows. Other columns are not read.
    """
    scratch = Scratch(rows.sparkSession)
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    own, asked = (integer_vectors(r.where("label is not null").withColumn("label", F.col("label").cast("long")), "label").where("vec_id is not null") for r in (rows, anchors))
    own, asked = scratch.table(own), scratch.table(asked)
    # one row a vec_id and dimension, as in the index
    least = F.min(F.struct("label", "x")).alias("v")
    asked = scratch.table(asked.groupBy("vec_id", "dim").agg(least).select("vec_id", "dim", "v.*"))
    blocks = block_count(own.count(), ROWS, LEAST, tasks)
    asks = max(1, -(-asked.count() // ANCHORS))
    index = scratch.table(own.withColumn("block", block_of(blocks, "vec_id")).groupBy("dim", "block").applyInArrow(_build, INDEX))
    found = meet(index, blocks, asked, asks, _find_positives(positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    first = found.withColumn("place", place).where(F.col("place") <= positives)
    first = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    windows = scratch.table(asked.join(first, "vec_id"))
    found = meet(index, blocks, windows, asks, _find_negatives(negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    out = scratch.table(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    scratch.drop(own, asked, index, windows)
    return out
