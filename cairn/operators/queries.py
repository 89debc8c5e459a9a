"""Direct queries: dependencies, three searches, related nodes and neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.graph import EDGE_COLUMNS, CodeGraph, require_node
from cairn.operators.hierarchy import page
from cairn.operators.projection import Projection
from cairn.schema import NODE_KINDS, GraphError


def dependencies(graph: CodeGraph, node_id: str) -> DataFrame:
    """(id) of what the node imports, by id."""
    require_node(graph.nodes, node_id)
    return graph.imports().where(F.col("from_id") == node_id).select(F.col("to_id").alias("id")).distinct().orderBy("id")


def dependents(graph: CodeGraph, node_id: str) -> DataFrame:
    """(id) of what imports the node, by id."""
    require_node(graph.nodes, node_id)
    return graph.imports().where(F.col("to_id") == node_id).select(F.col("from_id").alias("id")).distinct().orderBy("id")


def _matches(text: str):
    t = F.lower(F.lit(text))
    return F.lower("name").contains(t) | F.lower("path").contains(t) | F.lower("id").contains(t)


def search(nodes: DataFrame, text: str, kinds: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """At most `limit` nodes that have the text in name, path or id, any case, by name and id."""
    if not 1 <= limit <= 100:
        raise GraphError("invalid_argument", "limit must be from 1 to 100")
    if unknown := set(kinds) - set(NODE_KINDS):
        raise GraphError("invalid_argument", f"unknown kinds {sorted(unknown)}")
    found = nodes.where(_matches(text))
    found = found.where(F.col("kind").isin(*kinds)) if kinds else found
    return found.orderBy("name", "id").limit(limit)


def search_page(nodes: DataFrame, term: str, offset: int) -> tuple[DataFrame, int]:
    """A page of the matching nodes but modules, by path and id."""
    return page(nodes.where("kind <> 'MODULE'").where(_matches(term.strip())), ["path", "id"], offset)


def client_search(nodes: DataFrame, term: str) -> DataFrame:
    """The first 40 matching nodes but modules, by name and id; nothing for an empty term."""
    found = nodes.where("kind <> 'MODULE'").where(_matches(term.strip()))
    return (found if term.strip() else found.where("false")).orderBy("name", "id").limit(40)


def related_page(graph: CodeGraph, projection: Projection, node_id: str, incoming: bool, offset: int) -> tuple[DataFrame, int]:
    """A page of a node's neighbours, by path and id: a package's in the projection, others' by every relation but containment. Unknown ids are refused."""
    require_node(graph.nodes, node_id)
    kind = graph.nodes.where(F.col("id") == node_id).select("kind").first()
    edges = projection.graph.edges if kind and kind.kind == "PACKAGE" else graph.edges.where("kind <> 'CONTAINS'")
    own, other = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    ids = edges.where(F.col(own) == node_id).select(F.col(other).alias("id")).distinct()
    return page(graph.nodes.join(ids, "id", "left_semi"), ["path", "id"], offset)


@dataclass(frozen=True)
class Neighborhood:
    """Two pages of neighbours with their totals, and the graph of the node, the listed ones and the imports between."""

    dependencies: DataFrame
    dependents: DataFrame
    dependencies_total: int
    dependents_total: int
    graph: CodeGraph


def neighborhood(graph: CodeGraph, projection: Projection, node_id: str, scope: str = "canonical", dependency_offset: int = 0, dependent_offset: int = 0) -> Neighborhood:
    """The pages of distinct import neighbours in both directions, each by path and id; a self import appears once in the graph."""
    if scope not in ("canonical", "package"):
        raise GraphError("invalid_argument", f"unknown scope {scope}")
    used = projection.graph if scope == "package" else graph
    require_node(used.nodes, node_id, ("FILE", "PACKAGE"))
    imports = used.imports()
    out = imports.where(F.col("from_id") == node_id)
    back = imports.where(F.col("to_id") == node_id)
    listed = lambda ids: used.nodes.join(ids.distinct(), "id", "left_semi")
    a, total_a = page(listed(out.select(F.col("to_id").alias("id"))), ["path", "id"], dependency_offset)
    b, total_b = page(listed(back.select(F.col("from_id").alias("id"))), ["path", "id"], dependent_offset)
    edges = out.join(a.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(EDGE_COLUMNS).union(back.join(b.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(EDGE_COLUMNS))
    nodes = used.nodes.where(F.col("id") == node_id).union(a).union(b).distinct()
    return Neighborhood(a, b, total_a, total_b, CodeGraph(nodes, edges.distinct()))
