"""The typed property graph: building, validation and roles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.schema import DECLARATIONS, ROLE_DECLARATIONS, ROLES, GraphError

NODE_COLUMNS = ["id", "kind", "path", "name", "language", "import_count", "export_count"]
EDGE_COLUMNS = ["kind", "from_id", "to_id"]


@dataclass(frozen=True)
class CodeGraph:
    """nodes(id, kind, path, name, language, import_count, export_count) and edges(kind, from_id, to_id)."""

    nodes: DataFrame
    edges: DataFrame

    def imports(self) -> DataFrame:
        return self.edges.where("kind = 'IMPORTS'")

    def contains(self) -> DataFrame:
        return self.edges.where("kind = 'CONTAINS'")


def node_conflicts(nodes: DataFrame) -> DataFrame:
    """(id, variants): ids whose rows differ in any attribute."""
    rows = nodes.select("id", F.struct(*NODE_COLUMNS[1:]).alias("v")).repartition("id")  # serves both groupings
    return rows.distinct().groupBy("id").agg(F.count("*").alias("variants")).where("variants > 1")


def lost_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): ends of edges that are no node."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    ids = nodes.select("id").distinct()
    lost = edges.join(ids, edges.from_id == ids.id, "left_anti").union(edges.join(ids, edges.to_id == ids.id, "left_anti"))
    return lost.select(EDGE_COLUMNS).distinct()


def build(fragments: list[tuple[DataFrame, DataFrame]], check: bool = True) -> CodeGraph:
    """One graph of all fragments: identical rows collapse; conflicts, empty ids and dangling edges are refused."""
    nodes = reduce(DataFrame.unionByName, (n.select(NODE_COLUMNS) for n, _ in fragments)).distinct()
    edges = reduce(DataFrame.unionByName, (e.select(EDGE_COLUMNS) for _, e in fragments)).distinct()
    if check:
        for bad, code in ((nodes.where("id is null or id = ''"), "empty node id"), (node_conflicts(nodes), "conflicting node"), (dangling_edges(nodes, edges), "dangling edge")):
            if row := bad.first():
                raise GraphError("invalid_graph", f"{code}: {row.asDict()}")
    return CodeGraph(nodes, edges)


def is_declaration(kind: Column) -> Column:
    return kind.isin(*DECLARATIONS)


def role_of(language: Column, kind: Column) -> Column:
    """ROOT, CONTAINER, SOURCE or DECLARATION; null where the pair has no role."""
    out = F.lit(None).cast("string")
    for name, roles in ROLES.items():
        for k, role in roles.items():
            out = F.when((language == name) & (kind == k), role).otherwise(out)
        out = F.when((language == name) & kind.isin(*ROLE_DECLARATIONS[name]), "DECLARATION").otherwise(out)
    return out


def source_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def require_node(nodes: DataFrame, node_id: str, kinds: tuple[str, ...] = ()) -> None:
    """Refuse ids that are no node, or none of the kinds."""
    row = nodes.where(F.col("id") == node_id).select("kind").first()
    if row is None:
        raise GraphError("node_not_found", f'node "{node_id}" not found')
    if kinds and row.kind not in kinds:
        raise GraphError("wrong_node_kind", f'node "{node_id}" is a {row.kind}')
