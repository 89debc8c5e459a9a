"""The stored search index of a snapshot: which nodes hold each run of three characters.

nodes has the nodes in folders (blocks) by a hash of their path's directory, so that what is found
together lies together, each with its place, a number of its own. postings has the places of the
nodes with each trigram of their lower-cased names, paths and ids, many to a row: those of one
block and batch, as numbers of 32 bits above a base. It lies in folders by a hash of the trigram,
sorted by trigram. lists has each trigram's number of nodes, in the same folders. Rows are dealt
by ranges of the sort keys, so that a trigram that most nodes have, or a directory with very many,
spans several files.

A search reads the numbers of its text's trigrams, intersects the lists of the rarest of them and
reads the blocks of the nodes that are left. These nodes may include some without the text, so
the operators of `queries` verify what they are given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.graph import NODE_COLUMNS
from cairn.schema import NODES, GraphError
from cairn.session import cut, stored, sweep
from cairn.sources.view_index import folder_of

#: Postings that are worth a folder, nodes that are worth a block, and folders of each at most.
POSTINGS, BLOCK, FOLDERS = 1 << 22, 1 << 16, 4096
#: Lists that a search intersects at most.
LISTS = 3


def trigrams(text: Column) -> Column:
    """The runs of three characters of a text; none of a null or shorter one."""
    some = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, 3))
    return F.when(F.length(text) >= 3, some).otherwise(F.array().cast("array<string>"))


def write_search_index(nodes: DataFrame, path: str) -> None:
    """Write the index of nodes under path/folders=N/blocks=M. A null name or path has no trigrams."""
    spark, number = nodes.sparkSession, nodes.count()
    blocks = min(FOLDERS, -(-number // BLOCK) or 1)
    directory = F.regexp_replace(F.coalesce("path", F.lit("")), "[^/]*$", "")
    placed = nodes.select(*NODE_COLUMNS, folder_of(directory, blocks).alias("block")).repartitionByRange("block", "path", "id").sortWithinPartitions("block", "path", "id")
    placed = stored(placed.withColumn("place", F.monotonically_increasing_id()))
    lower = placed.select("block", "place", *(F.lower(c).alias(c) for c in ("name", "path", "id")))
    found = stored(lower.mapInArrow(_postings, _FOUND))
    size = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings")).first()
    folders = min(FOLDERS, -(-size.postings // POSTINGS) or 1)
    home = f"{path}/folders={folders}/blocks={blocks}"

    def write(rows, name, *order):
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy(order[0]).parquet(f"{home}/{name}")

    write(placed, "nodes", "block", "path", "id")
    found = found.withColumn("folder", folder_of(F.col("gram"), folders))
    write(found.drop("n"), "postings", "folder", "gram", "node_block", "base")
    # the empty run stands for all nodes
    whole = spark.range(1).select(F.lit("").alias("gram"), F.lit(number).cast("long").alias("n")).withColumn("folder", folder_of(F.col("gram"), folders))
    write(found.groupBy("gram", "folder").agg(F.sum("n").alias("n")).select("gram", "n", "folder").union(whole), "lists", "folder", "gram")
    sweep(spark)


#: Bytes of text whose trigrams are looked for at a time.
SLICE = 4 << 20
#: Bits of a place that a row of postings holds for each node.
HIGH = 31


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _FOUND of (block, place, name, path, id), their texts in lower case."""
    for batch in batches:
        texts = [batch.column(c).cast(pa.large_string()).fill_null("") for c in ("name", "path", "id")]
        ends = np.cumsum(sum(pc.binary_length(t).to_numpy() for t in texts)) if len(batch) else np.zeros(0)
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
            yield _slice_postings([t.slice(a, b - a) for t in texts], batch.column("block").to_numpy()[a:b], batch.column("place").to_numpy()[a:b])
            a = b


def _slice_postings(texts: list[pa.Array], block: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    grams, rows = zip(*map(_codes, texts))
    known, gram = np.unique(np.concatenate(grams), return_inverse=True)
    # a base is the bits of a place above 31
    base, home = np.unique(np.stack([block.astype(np.int64), place >> HIGH]), axis=1, return_inverse=True)
    order = np.argsort(home.ravel(), kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    pairs = np.unique(gram.ravel().astype(np.int64) * len(block) + at[np.concatenate(rows)])
    row = order[pairs % len(block)]
    key = pairs // len(block) * base.shape[1] + home.ravel()[row]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(first, len(key)).astype(np.int32)
    names = ["".join(map(chr, ((k >> 42) & 0x1FFFFF, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF))) for k in known.tolist()]
    own = key[first] % base.shape[1]
    columns = {
        "gram": pa.array([names[k] for k in (key[first] // base.shape[1]).tolist()], pa.string()), "node_block": pa.array(base[0][own].astype(np.int32)), "base": pa.array(base[1][own] << HIGH),
        "rows": pa.ListArray.from_arrays(pa.array(ends), pa.array((place[row] & ((1 << HIGH) - 1)).astype(np.int32))), "n": pa.array(np.diff(ends).astype(np.int64)),
    }
    return pa.RecordBatch.from_pydict(columns)


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the trigrams of all texts, 21 bits for each character; their rows)."""
    try:
        text = "".join(texts.to_pylist())
        lengths = pc.utf8_length(texts).to_numpy()
    except UnicodeDecodeError:  # what is no text is in no search
        own = [t.decode(errors="replace") for t in texts.cast(pa.large_binary()).to_pylist()]
        text, lengths = "".join(own), np.array([len(t) for t in own])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    whole = row[2:] == row[:-2]
    return ((code[:-2] << 42) | (code[1:-1] << 21) | code[2:])[whole], row[:-2][whole]


_POSTING = "gram string, node_block int, base bigint, rows array<int>, folder int"
_FOUND = "gram string, node_block int, base bigint, rows array<int>, n bigint"


class SearchIndex:
    """Candidates of searches from one snapshot's stored index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, home, numbers = spark, path, []
        for name in ("folders", "blocks"):
            where = spark._jvm.org.apache.hadoop.fs.Path(home)
            system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            found = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
            part = next((f for f in found if f.startswith(f"{name}=")), None)
            if part is None:
                raise GraphError("not_found", f"no search index in {path}")
            home = f"{home}/{part}"
            numbers.append(int(part.split("=")[1]))
        self.folders, self.blocks = numbers
        of = lambda table, schema: spark.read.schema(schema).option("basePath", f"{home}/{table}").parquet(f"{home}/{table}")
        self.nodes = of("nodes", NODES + ", place bigint, block int")
        self.postings = of("postings", _POSTING)
        self.lists = of("lists", "gram string, n bigint, folder int")

    def rarest(self, text: str) -> list | None:
        """(gram, folder, n) of the lists that a search intersects, rarest first; None where a scan is no dearer, empty where a trigram is in no node."""
        grams = F.explode(F.array_distinct(F.concat(trigrams(F.lower(F.lit(text))), F.array(F.lit("")))))
        asked = self.spark.range(1).select(grams.alias("gram")).withColumn("folder", folder_of(F.col("gram"), self.folders)).collect()
        if len(asked) == 1:  # shorter than a trigram
            return None
        own = self.lists.where(F.col("folder").isin(sorted({a.folder for a in asked})) & F.col("gram").isin([a.gram for a in asked]))
        numbers = {r.gram: r for r in own.collect()}  # as many as the text has trigrams
        if len(numbers) < len(asked):
            return []
        nodes = numbers.pop("").n
        found = sorted(numbers.values(), key=lambda r: (r.n, r.gram))[:LISTS]
        return found if 2 * found[0].n < nodes else None

    def candidates(self, text: str) -> DataFrame:
        """The nodes (columns of NODES) that can hold the text in name, path or id, any case: at least all that do."""
        lists = self.rarest(text)
        if lists is None:
            return self.nodes.select(NODE_COLUMNS)
        if not lists:
            return self.nodes.where("false").select(NODE_COLUMNS)
        rows = self.postings.where(F.col("folder").isin(sorted({r.folder for r in lists})) & F.col("gram").isin([r.gram for r in lists]))
        rows = rows.select(F.col("node_block").alias("block"), "base", F.explode("rows").alias("row")).select("block", (F.col("base") + F.col("row")).alias("place"))
        held = cut(rows.groupBy("block", "place").agg(F.count("*").alias("k")).where(F.col("k") == len(lists)).drop("k"))
        blocks = sorted(r.block for r in held.select("block").distinct().collect())  # FOLDERS at most
        return self.nodes.where(F.col("block").isin(blocks)).join(held, ["block", "place"], "left_semi").select(NODE_COLUMNS)
