"""Nearest neighbours by collision-counting hashing.

Every vector has its values under a set of single random projections. Per block of vectors,
each projection's rows are sorted by value. A query counts on those projections, of all, on
which its own value is most extreme: there a near row's value lies far out too, where few
others do. On each it opens a window from the far end inwards to a level, and moves all windows
together, level by level (virtual rehashing: a wider window is a coarser hash, without new
tables). Only rows inside the windows are read: a wider window adds its new rows to the counts,
a narrower one takes its lost ones off. A vector that falls into enough windows has exceeded the
collision threshold and is verified with its exact inner product. A query stops at its narrowest
level at which enough vectors are over the threshold: their number grows as the square root of
all vectors', so the share verified falls, the windows narrow, and the share read falls too.

Every block of vectors is searched by every query of the stated query set.

Largest inner product becomes nearest point in a block whose rows are moved by their mean, which
changes no query's order of them, by one more coordinate, sqrt(M^2 - |x|^2), with M the largest
norm, and queries scaled to norm M; all is then divided by M.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut

#: Projections, those of them that a query counts on, collisions that a candidate needs.
PROJECTIONS, COUNTED, COLLISIONS = 1024, 64, 16
#: Vectors verified for a query: this times the square root of their number, in each block its share of them and k more.
VERIFIED = 7.0
#: Where a level's windows end, in standard deviations of a projection, the narrowest first; the last hold all rows. The level that a block's first query begins at.
LEVELS, FIRST = np.append(np.arange(40, -41, -1) / 10, -np.inf), 25
#: Vectors (under 2**16) and queries of a block, about. A pair of blocks sorts its vectors anew, which pays for many queries.
ROWS, QUERIES = 16384, 8192
#: Partitions of the pairs, at least.
PARTITIONS = 32
#: Projections sorted, and queries projected, at a time.
SORTED, PROJECTED = 64, 1024


def _projections(dim: int) -> np.ndarray:
    return np.random.default_rng([20121, dim]).normal(size=(dim + 1, PROJECTIONS)).astype(np.float32)


def _lifted(x: np.ndarray) -> np.ndarray:
    """A block's rows, moved by their mean, with the coordinate that gives them one norm, which becomes 1."""
    x = x - x.mean(0)
    norm = np.sqrt((x * x).sum(1))[:, None]
    most = norm.max() or 1.0
    return np.column_stack([x / most, np.sqrt(np.fmax(1 - (norm / most) ** 2, 0))]).astype(np.float32)


def _directions(q: np.ndarray) -> np.ndarray:
    return np.column_stack([q / np.sqrt((q * q).sum(1))[:, None], np.zeros(len(q))]).astype(np.float32)


class Block:
    """The rows of a block in the order of each projection's values, and where every level's windows end in it.

    A window at the upper end begins at place high[level], one at the lower end stops before low[level].
    read counts the rows read in windows.
    """

    def __init__(self, lifted: np.ndarray, project: np.ndarray):
        self.n, m = len(lifted), project.shape[1]
        lines = np.empty((m, self.n), np.uint16)
        self.high, self.low = np.empty((2, len(LEVELS), m), np.int64)
        for at in range(0, m, SORTED):
            own = np.ascontiguousarray((lifted @ project[:, at : at + SORTED]).T)
            lines[at : at + SORTED] = order = np.argsort(own, axis=1)
            for j, line in enumerate(np.take_along_axis(own, order, 1), at):
                self.high[:, j] = np.searchsorted(line, LEVELS)
                self.low[:, j] = np.searchsorted(line, -LEVELS, "right")
        self.lines, self.read = list(lines), 0

    def candidates(self, places: np.ndarray, want: int, guess: int) -> tuple[np.ndarray, int]:
        """(rows over the threshold, level) at the narrowest level that has `want` of them, or the last; the guess only tells where to begin."""
        on = np.argpartition(-np.abs(places), COUNTED - 1)[:COUNTED]
        up, lines = places[on] > 0, [self.lines[j] for j in on.tolist()]

        def ends(level):
            return np.where(up, self.high[level, on], self.low[level, on])

        def between(a, b):  # how often each row lies between the windows' ends at a and at b
            rows = np.concatenate([line[i:j] for line, i, j in zip(lines, np.minimum(a, b).tolist(), np.maximum(a, b).tolist())])
            self.read += len(rows)
            return np.bincount(rows, minlength=self.n)

        level, end = guess, ends(guess)
        count = between(np.where(up, self.n, 0), end)
        found = np.flatnonzero(count >= COLLISIONS)
        while len(found) < want and level < len(LEVELS) - 1:
            level, last = level + 1, end
            end = ends(level)
            count += between(last, end)
            found = np.flatnonzero(count >= COLLISIONS)
        while level > 0 and level <= guess:
            last, end = end, ends(level - 1)
            count -= between(last, end)
            fewer = np.flatnonzero(count >= COLLISIONS)
            if len(fewer) < want:
                break
            found, level = fewer, level - 1
        return found, level


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return rows.column("vec_id").to_numpy(), flat.reshape(rows.num_rows, -1)


def _search(k: int, total: int):
    def run(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if vectors.num_rows and queries.num_rows:
            ids, x = _matrix(vectors)
            names, q = _matrix(queries)
            # in one order, whatever order they came in, as a product's last bits follow a row's place
            order, asked = np.lexsort((*x.T[::-1], ids)), np.argsort(names)
            ids, x, names, q = ids[order], x[order], names[asked], q[asked]
            project = _projections(x.shape[1])
            block = Block(_lifted(x), project)
            want = min(len(ids), k + 1 + int(np.ceil(VERIFIED * len(ids) / np.sqrt(total))))
            level = FIRST
            for i, name in enumerate(names.tolist()):
                if i % PROJECTED == 0:
                    places = _directions(q[i : i + PROJECTED]) @ project
                found, level = block.candidates(places[i % PROJECTED], want, level)
                found = found[ids[found] != name]
                score = (x[found] * q[i]).sum(1)
                best = np.lexsort((ids[found], -score))
                _, kept = np.unique(ids[found][best], return_index=True)  # of rows with one vec_id the best
                best = best[np.sort(kept)[:k]]
                out[0].extend([name] * len(best))
                out[1].extend(ids[found][best].tolist())
                out[2].extend(score[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, largest inner product first.

    Both inputs are (vec_id, embedding). Blocks of queries meet blocks of vectors, each pair in one
    task; a pair hands on k rows a query. Ties go to the smaller vec_id; a query's own vec_id is no
    candidate. Rows with a null vec_id, and vectors null, empty, zero or with null or non-finite
    components, take no part. Only vectors of a query's dimension are its candidates. Repeated rows
    count once (of rows with one vec_id, the best score); of queries with one vec_id, the least vector.
    """

    def clean(df):
        e = F.col("embedding").cast("array<double>")
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id is not null and size(embedding) > 0")
        whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
        return df.where(whole).withColumn("norm", norm).where("norm > 0").withColumn("dim", F.size("embedding"))

    # repeated rows count once; the rest of the work is the same for any order of the rows
    rows = cut(clean(vectors).groupBy("vec_id", "embedding", "dim").agg(F.lit(1).alias("one")).drop("one"))
    n = rows.count()
    asked = clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    asked = cut(asked)
    blocks, asks = max(1, -(-n // ROWS)), max(1, -(-asked.count() // QUERIES))
    own = rows.withColumn("b", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)))
    own = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(asks - 1)))).select("dim", "b", "q", "vec_id", "embedding")
    asked = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(asks)).cast("int"))
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select("dim", "b", "q", "vec_id", "embedding")
    key = ["dim", "b", "q"]
    # a pair of blocks is much work in few bytes: twice as many partitions, and not few, so that pairs seldom share one
    parts = max(PARTITIONS, 2 * blocks * asks)
    own, asked = (df.repartition(parts, *key) for df in (own, asked))
    found = own.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search(k, max(1, n)), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) if blocks > 1 else found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
