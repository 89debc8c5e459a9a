"""The stored view index of a snapshot: what each node has beside it, ready to be paged.

One row for each node and relation to another: child, parent, out and in (every relation but
containment), to and from (the projected package edges), with the other node's columns, and one
`self` row for each node with its counts. Rows lie in folders by a hash of the id and are sorted
by id, relation, path and other id, so a page reads one folder and needs no shuffle. Rows are
dealt by ranges of the sort key, so that a node with very many relations spans several files.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.graph import NODE_COLUMNS, CodeGraph
from cairn.operators.hierarchy import parents, validate
from cairn.operators.projection import project_packages
from cairn.schema import PAGE, GraphError
from cairn.session import few, stored, sweep

COUNTS = ("children", "files", "out", "in", "to", "from")
ROW = "id string, relation string, path string, other string, node struct<id:string,kind:string,path:string,name:string,language:string,import_count:int,export_count:int>, counts struct<" + ",".join(f"`{c}`:bigint" for c in COUNTS) + ">"
#: Rows that are worth a folder, and folders of a snapshot at most.
ROWS, FOLDERS = 1 << 20, 4096


def folder_of(node_id: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(node_id), F.lit(folders)).cast("int")


def relations_of(graph: CodeGraph) -> Iterator[tuple[str, DataFrame]]:
    """(relation, its distinct pairs of id and other); a graph that breaks containment is refused."""
    validate(graph)
    held = stored(parents(graph).select(F.col("parent").alias("a"), F.col("child").alias("b")))
    yield from _both("child", "parent", held)
    del held
    rest = graph.edges.where("kind <> 'CONTAINS'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    yield from _both("out", "in", stored(rest.distinct()))
    yield from _both("to", "from", stored(project_packages(graph).graph.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))))


def _both(name: str, back: str, pairs: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    yield name, pairs.select(F.col("a").alias("id"), F.col("b").alias("other"))
    yield back, pairs.select(F.col("b").alias("id"), F.col("a").alias("other"))


def write_index(graph: CodeGraph, path: str) -> None:
    """Write a graph's index under path/folders=N/folder=K, a relation at a time, and then the counts of what was written."""
    n = graph.edges.count() * 2 + graph.nodes.count()
    folders = min(FOLDERS, -(-n // ROWS) or 1)
    home = f"{path}/folders={folders}"
    node = graph.nodes.select(F.col("id").alias("other"), F.struct(*NODE_COLUMNS).alias("node"))
    counts = F.lit(None).cast("struct<" + ",".join(f"`{c}`:bigint" for c in COUNTS) + ">")

    def write(rows, relation, counts):
        """rows(id, node); what follows from the node is not shuffled."""
        order = ["folder", "id", "node.path", "node.id"]
        rows = rows.withColumn("folder", folder_of(F.col("id"), folders)).repartitionByRange(*order).sortWithinPartitions(*order)
        rows = rows.select("id", F.lit(relation).alias("relation"), F.col("node.path").alias("path"), F.col("node.id").alias("other"), "node", counts.alias("counts"), "folder")
        rows.write.mode("append").option("compression", "zstd").partitionBy("folder").parquet(home)
        sweep(graph.nodes.sparkSession)

    for relation, pairs in relations_of(graph):
        ends = few(node.join(pairs.select("other").distinct(), "other", "left_semi"), "other", "node.path", "node.name")
        write(pairs.join(ends, "other").select("id", "node"), relation, counts)
    of = lambda name: F.count_if(F.col("relation") == name)
    found = graph.nodes.sparkSession.read.schema(ROW + ", folder int").option("basePath", home).parquet(home).select("id", "relation", "node.kind")
    counted = found.groupBy("id").agg(F.struct(of("child").alias("children"), F.count_if((F.col("relation") == "child") & (F.col("kind") == "FILE")).alias("files"), *(of(c).alias(c) for c in COUNTS[2:])).alias("counts"))
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS))
    own = graph.nodes.select("id", F.struct(*NODE_COLUMNS).alias("node")).join(stored(counted), "id", "left")
    write(own, "self", F.coalesce("counts", zero))


class ViewIndex:
    """Pages and counts of one snapshot's nodes from its stored index."""

    def __init__(self, spark: SparkSession, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(where):
            raise GraphError("not_found", f"no view index in {path}")
        name = next(s.getPath().getName() for s in system.listStatus(where) if s.getPath().getName().startswith("folders="))
        self.folders = int(name.split("=")[1])
        self.rows = spark.read.schema(ROW + ", folder int").option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")

    def of(self, node_id: str, relation: str) -> DataFrame:
        """The rows of a node's relation, from its folder alone."""
        folder = self.rows.sparkSession.range(1).select(folder_of(F.lit(node_id), self.folders)).first()[0]
        return self.rows.where((F.col("folder") == folder) & (F.col("id") == node_id) & (F.col("relation") == relation))

    def node(self, node_id: str) -> dict:
        """A node's columns and counts; unknown ids are refused."""
        row = self.of(node_id, "self").select("node", "counts").first()
        if row is None:
            raise GraphError("node_not_found", f"no node {node_id}")
        return row.node.asDict() | {"counts": row.counts.asDict()}

    def parent(self, node_id: str) -> str | None:
        row = self.of(node_id, "parent").select("other").first()
        return row.other if row else None

    def page(self, node_id: str, relation: str, offset: int) -> DataFrame:
        """A page of a node's relation as nodes, by path and id."""
        if offset < 0:
            raise GraphError("bad_request", "offset must not be negative")
        return self.of(node_id, relation).orderBy("path", "other").offset(offset).limit(PAGE).select("node.*")

    def children_page(self, node_id: str, offset: int = 0) -> tuple[DataFrame, int]:
        """(a page of the children, their number)."""
        return self.page(node_id, "child", offset), self.node(node_id)["counts"]["children"]

    def related_page(self, node_id: str, incoming: bool, offset: int = 0) -> tuple[DataFrame, int]:
        """(a page of a node's neighbours, their number): a package's in the projection, others' by every relation but containment."""
        own = self.node(node_id)
        relation = ("from" if incoming else "to") if own["kind"] == "PACKAGE" else ("in" if incoming else "out")
        return self.page(node_id, relation, offset), own["counts"][relation]

    def counts(self) -> DataFrame:
        """(id, kind and COUNTS) of every node."""
        return self.rows.where("relation = 'self'").select("id", "node.kind", "counts.*")
